"""Bounded samples of labelled rows, for the operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(folds: int, at: int, id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(F.col(id_col), folds) == at, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, limit: int) -> DataFrame:
    """docs(doc_id, text) of at most `limit` labelled ids outside the held-out fold, with label.

    The ids with the smallest hashes are taken, so the same ids for the same labels. An id with
    several labels gets the largest. The ids' table has at most `limit` rows of two numbers and
    may be broadcast for that reason.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    chosen = known.where(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
