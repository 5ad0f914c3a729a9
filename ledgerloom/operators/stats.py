"""Profiles of results: constants, distinct values, overlap of populations, coverage, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taxid import is_cut


def constant_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for every column whether it has at most one value, null counting as ''.
    Smallest and largest are compared, which needs no distinct counts. No rows: all constant."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.agg(*[F.min(text(c)).eqNullSafe(F.max(text(c))).alias(c) for c in columns])


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, distinct, total): distinct values, null counting as '', and the sum of what is numeric."""
    long = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).unpivot([], columns, "name", "value")
    counted = long.groupBy("name", "value").agg(F.count("*").alias("n"))
    number = F.when(F.trim("value") == "", F.lit(0).cast("decimal(20,6)")).otherwise(F.col("value").try_cast("decimal(20,6)"))
    return counted.groupBy("name").agg(F.count("*").alias("distinct"), F.coalesce(F.sum(number * F.col("n")), F.lit(0)).cast("decimal(38,6)").alias("total"))


def first_of_each(rows: DataFrame, keys: list[str], order: list[str], most: int, name: str = "n") -> DataFrame:
    """The first rows of every group by order, with their place from 1 on. A group is cut into 64
    parts, of each of which only the first `most` go on, so none is sorted as a whole."""
    place = [F.col(c) for c in order]
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(64)))
    local = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*place))).where(F.col(name) <= most)
    return local.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*place))).where(F.col(name) <= most).drop("_part")


def histogram_with_details(rows: DataFrame, kind: str, detail: str, order: list[str], most: int = 8) -> DataFrame:
    """(kind, count, first, details): groups by size, each with its first details."""
    per = rows.groupBy(kind).agg(F.count("*").alias("count"), F.min(F.struct(*order)).alias("first"))
    top = first_of_each(rows.select(kind, *order, F.col(detail).alias("_d")), [kind], [*order, "_d"], most)
    details = top.groupBy(kind).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "_d"))), lambda p: p["_d"].cast("string")), "|").alias("details"))
    return per.join(details, kind)


def overlap(rows: DataFrame, who: str, group: str, first: str, second: str) -> DataFrame:
    """One row: persons in all, only in the first group, in both of two groups."""
    seen = rows.groupBy(who).agg(F.bool_or(F.col(group) == first).alias("a"), F.bool_or(F.col(group) == second).alias("b"), F.bool_or(F.col(group) != first).alias("other"))
    return seen.agg(F.count("*").alias("everyone"), F.count_if(F.col("a") & ~F.col("other")).alias("only_first"), F.count_if(F.col("a") & F.col("b")).alias("in_both"))


def population_sets(rows: DataFrame, who: str, group: str, first: str, second: str) -> DataFrame:
    """(kind, n): persons in either of two groups (union), in both, and in the first alone; one
    aggregation instead of three set operations."""
    seen = rows.groupBy(who).agg(F.coalesce(F.bool_or(F.col(group) == first), F.lit(False)).alias("a"), F.coalesce(F.bool_or(F.col(group) == second), F.lit(False)).alias("b"))
    n = seen.agg(F.count_if(F.col("a") | F.col("b")).alias("union"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("first"))
    return n.unpivot([], ["union", "both", "first"], "kind", "n")


def without_partner(rows: DataFrame, partners: DataFrame, key: str) -> DataFrame:
    """The rows whose key no partner has."""
    return rows.join(partners.select(key), key, "left_anti")


def cut_names(mine: DataFrame, theirs: DataFrame, key: str, name: str) -> DataFrame:
    """(n, shorter): of the keys that both sides have, how many names of mine are cut short."""
    both = mine.select(key, F.col(name).alias("_mine")).join(theirs.select(key, F.col(name).alias("_theirs")), key)
    return both.agg(F.count("*").alias("n"), F.count_if(is_cut(F.col("_mine"), F.col("_theirs"))).alias("shorter"))


def field_profile(values: DataFrame, keys: list[str], filled: Column, number: Column) -> DataFrame:
    """(keys, with_value, total): filled values and the sum of the numbers; null without numbers."""
    return values.groupBy(*keys).agg(F.count_if(filled).alias("with_value"), F.sum(number).alias("total"))


def missing_coverage(can_fill: DataFrame, present: DataFrame, filled: DataFrame) -> DataFrame:
    """(source, items): what nobody filled and only absent sources could. can_fill has
    (source, item), present (source), filled (item)."""
    empty = can_fill.join(filled, "item", "left_anti")
    explained = empty.join(present, "source", "left_semi").select("item").distinct()
    lacking = empty.join(explained, "item", "left_anti").join(present, "source", "left_anti")
    return lacking.groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("item")), ",").alias("items"))


def reconcile(mine: DataFrame, theirs: DataFrame, key: str, fields: list[str], kind: str = "decimal(20,6)") -> DataFrame:
    """(field, compared, different, example): two tables with a row for each key, field by field;
    what one side lacks counts as zero. example is the smallest key that differs."""
    side = lambda df, name: df.select(key, *[F.coalesce(F.col(f).cast(kind), F.lit(0).cast(kind)).alias(f) for f in fields]).unpivot([key], fields, "field", name)
    both = side(mine, "a").join(side(theirs, "b"), [key, "field"])
    return both.groupBy("field").agg(F.count("*").alias("compared"), F.count_if(F.col("a") != F.col("b")).alias("different"), F.min(F.when(F.col("a") != F.col("b"), F.col(key))).alias("example"))


def flat_json(text: Column) -> Column:
    """A flat JSON object as array<struct<path, value>>, values as their text."""
    return F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value")))


def differences(expected: DataFrame, actual: DataFrame, keys: list[str], ignored: tuple[str, ...] = ()) -> DataFrame:
    """(keys, path, kind, expected, actual) of (keys, path, value) tables: what is absent or
    changed is a difference, what only the actual side has is new."""
    e = expected.select(*keys, "path", F.col("value").alias("expected"), F.lit(True).alias("_e"))
    a = actual.select(*keys, "path", F.col("value").alias("actual"), F.lit(True).alias("_a"))
    both = e.join(a, [*keys, "path"], "full_outer")
    kind = F.when(F.col("_e").isNull(), "new").when(F.col("_a").isNull(), "absent").when(~F.col("expected").eqNullSafe(F.col("actual")), "changed")
    out = both.withColumn("kind", kind).where("kind is not null")
    return (out.where(~F.col("path").isin(*ignored)) if ignored else out).select(*keys, "path", "kind", "expected", "actual")


def privacy_hits(texts: DataFrame, row: str, text: str, pattern: str) -> DataFrame:
    """(row, hits): how many matches of a personal pattern each output text has."""
    return texts.select(row, F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long").alias("hits"))
