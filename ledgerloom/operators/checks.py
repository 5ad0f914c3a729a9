"""Reconciliation: declared totals against extracted sums, and what can be said of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERIFIED, UNVERIFIED, MISMATCH = "verificado", "sin verificar", "no cuadra"
_ORDER = {VERIFIED: 0, UNVERIFIED: 1, MISMATCH: 2}


def field_sums(values: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, field, total): every field's sum by document, worked out once for all totals."""
    return values.groupBy(doc, "field").agg(F.sum("value").alias("total"))


def column_sums(rows: DataFrame, fields: list[str], doc: str = "doc_id") -> DataFrame:
    """field_sums of fields that are columns: a document's sums move as one row and become rows afterwards."""
    return rows.groupBy(doc).agg(*[F.sum(f).alias(f) for f in fields]).unpivot([doc], fields, "field", "total")


def signed_sums(pairs: DataFrame, sums: DataFrame, terms: list[tuple[str, str, int]], doc: str, pair: list[str]) -> DataFrame:
    """(pair, extracted) of totals that add and subtract fields: terms are literals (name, field, sign),
    pairs names one by `name`. A field that a document lacks counts as zero."""
    table = pairs.sparkSession.createDataFrame(terms, "name string, field string, sign int")  # of literals
    known = {name for name, _, _ in terms}
    # sums take their signs and are added up before they move to the pairs
    added = sums.join(F.broadcast(table), "field").groupBy(doc, "name").agg(F.sum(F.col("sign") * F.col("total")).alias("_sum"))
    wide = pairs.where(F.col("name").isin(*known)).select(doc, *[c for c in pair if c not in (doc, "name")], "name").join(added, [doc, "name"], "left")
    return wide.select(*pair, F.coalesce("_sum", F.lit(0).cast("decimal(20,6)")).cast("decimal(20,6)").alias("extracted"))


def any_alternative(pairs: DataFrame, sums: DataFrame, options: list[tuple[str, str, int]], doc: str, pair: list[str]) -> DataFrame:
    """(pair, hit, extracted) of totals that may be any of several fields, literals (name, field, ord):
    hit is the first field whose sum equals `declared`; without one, extracted is the first field's sum."""
    table = pairs.sparkSession.createDataFrame(options, "name string, field string, ord int")  # of literals
    wide = pairs.select(doc, *[c for c in pair if c != doc], "name", "declared").join(F.broadcast(table), "name").join(sums, [doc, "field"], "left")
    total = F.coalesce("total", F.lit(0).cast("decimal(20,6)"))
    got = wide.groupBy(*pair).agg(F.min_by("field", F.when(total == F.col("declared"), F.col("ord"))).alias("hit"), F.min_by(total, "ord").alias("first_sum"), F.first("declared").alias("declared"))
    return got.select(*pair, "hit", F.when(F.col("hit").isNotNull(), F.col("declared")).otherwise(F.col("first_sum")).alias("extracted"))


def distinct_where(rows: DataFrame, keys: list[str], what: str, where: Column | None = None) -> DataFrame:
    """(keys, n): distinct values of `what`, of the rows that qualify; exact."""
    picked = F.col(what) if where is None else F.when(where, F.col(what))
    return rows.groupBy(*keys).agg(F.count_distinct(picked).alias("n"))


OUTCOMES = ("compared", "note", "uncompared")


def coverage(compared: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_pairs, n_compared, n_note, n_uncompared): how many declared totals had which outcome."""
    return compared.groupBy(*keys).agg(F.count("*").alias("n_pairs"), *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES])


def unbacked_fields(sums: DataFrame, backed: DataFrame, excused: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, field) of amounts that differ from zero in some row, and that neither a comparison
    nor a declared excuse covers. sums has any_amount."""
    return sums.where("any_amount").select(doc, "field").join(backed, [doc, "field"], "left_anti").join(excused, [doc, "field"], "left_anti")


def severity(state: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in _ORDER.items() for x in kv]), state)


def worst(state: Column) -> Column:
    """The worst state of a group's documents; verified for none."""
    return F.get(F.array(*map(F.lit, _ORDER)), F.coalesce(F.max(severity(state)), F.lit(0)))


def state_of(failed: Column, reasons: Column) -> Column:
    """Three states, not two: a document that nothing could contradict isn't verified."""
    return F.when(failed, MISMATCH).when(F.size(reasons) > 0, UNVERIFIED).otherwise(VERIFIED)
