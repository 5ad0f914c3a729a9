"""Merging many rows of a key into one, each field by its own rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import date_key

RULES = ("sum", "max", "first", "earliest", "latest", "longest")


def merged(rule: str, value: Column, order: list[Column], sign: list[Column]) -> Column:
    """The aggregate of one field. order makes rows' sequence total; sign is order descending
    (for rules that look for a maximum but keep the first of equals).

    sum       of what is there; null without a value
    max       never below zero; null without a value
    first     by order
    earliest  smallest date key, dates that can't be read last
    latest    largest date key, dates that can't be read first
    longest   most characters, first of equals
    """
    here = value.isNotNull()
    if rule == "sum":
        return F.sum(value)
    if rule == "max":
        return F.when(F.count(value) > 0, F.greatest(F.max(value), F.lit(0).cast("decimal(20,6)")))
    if rule == "first":
        return F.min_by(value, F.when(here, F.struct(*order)))
    if rule == "earliest":
        return F.min_by(value, F.when(here, F.struct(F.coalesce(date_key(value), F.lit(2**31 - 1)).alias("k"), *order)))
    if rule == "latest":
        return F.max_by(value, F.when(here, F.struct(F.coalesce(date_key(value), F.lit(-1)).alias("k"), *sign)))
    if rule == "longest":
        return F.max_by(value, F.when(here, F.struct(F.length(value).alias("k"), *sign)))
    raise ValueError(f"no such merge rule: {rule}")


def kinds_of(kind: Column) -> Column:
    """The distinct kinds of a group's rows, sorted."""
    return F.sort_array(F.collect_set(kind))


def first_where(value: Column, where: Column, order: list[Column]) -> Column:
    """The value of the first row, by order, that qualifies."""
    return F.min_by(value, F.when(where, F.struct(*order)))


def merge_rows(rows: DataFrame, key: list[str], fields: dict[str, str], order: list[str], extra: tuple[Column, ...] = ()) -> DataFrame:
    """One row for each key with every field merged by its rule; order holds numeric columns."""
    up, down = [F.col(c) for c in order], [(-F.col(c)).alias(c) for c in order]
    return rows.groupBy(*key).agg(*[merged(rule, F.col(name), up, down).alias(name) for name, rule in fields.items()], *extra)


def merged_fields(values: DataFrame, key: list[str], fields: dict[str, str], order: list[str]) -> DataFrame:
    """One row for each key with every field merged by its rule, like merge_rows, of values(key, field, num, txt,
    order): sums and maxima are of num, the others of txt. Each value meets the rule of its own field only."""
    rule, up = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])[F.col("field")], [F.col(c) for c in order]
    numeric = [f for f, r in fields.items() if r in ("sum", "max")]
    numbers = values.where(F.col("field").isin(*numeric)).groupBy(*key, "field").agg(F.sum("num").alias("s"), F.max("num").alias("m"))
    least = F.when(F.col("m").isNotNull(), F.greatest("m", F.lit(0).cast("decimal(20,6)")))
    numbers = numbers.select(*key, "field", "s", least.alias("m"), F.lit(None).cast("string").alias("txt"))
    # the place of a text by its rule: the smallest one, the first of equals
    day = date_key(F.col("txt"))
    place = F.when(rule == "first", F.lit(0)).when(rule == "earliest", F.coalesce(day, F.lit(2**31 - 1))).when(rule == "latest", -F.coalesce(day, F.lit(-1))).when(rule == "longest", -F.length("txt"))
    texts = values.where(F.col("field").isin(*[f for f in fields if f not in numeric]) & F.col("txt").isNotNull())
    texts = texts.select(*key, "field", "txt", *order, place.alias("_at")).groupBy(*key, "field").agg(F.min_by("txt", F.struct("_at", *up)).alias("txt"))
    both = numbers.unionByName(texts, allowMissingColumns=True)
    mine = F.map_from_entries(F.collect_list(F.struct("field", F.struct("s", "m", "txt").alias("v"))))
    own = {"sum": "s", "max": "m"}
    return both.groupBy(*key).agg(mine.alias("_v")).select(*key, *[F.col("_v")[f][own.get(r, "txt")].alias(f) for f, r in fields.items()])


def long_values(rows: DataFrame, keys: list[str], fields: list[str], kind: str = "decimal(20,6)") -> DataFrame:
    """(keys, field, value): numeric columns as rows."""
    return rows.select(*keys, *[F.col(f).cast(kind).alias(f) for f in fields]).unpivot(keys, fields, "field", "value")


def fold_repeated(values: DataFrame, keys: list[str], additive: tuple[str, ...] = ()) -> DataFrame:
    """Values of one record that share a field are added up, whatever the field's merge rule;
    repeated is true if that happened to a field that isn't declared additive."""
    folded = values.where("value is not null").groupBy(*keys, "field").agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    return folded.withColumn("repeated", (F.col("n") > 1) & ~F.col("field").isin(*additive) if additive else F.col("n") > 1)
