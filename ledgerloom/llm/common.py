"""Helpers shared by the corpus operators: cuts and Arrow batch plumbing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cuts import cut as materialize
from ..plans.cuts import into, keep, release, scope, shared_dir

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "SPACE", "WORD", "batch", "documents", "id_text", "into", "keep", "materialize", "release", "scope", "shared_dir", "small_batches", "texts"]

#: Words are maximal runs of anything but these characters (space and \t \n \v \f \r).
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts(column: pa.Array) -> Iterator[str]:
    """The strings of an Arrow column, a few hundred at a time; null counts as empty."""
    for at in range(0, len(column), 250):
        for t in column.slice(at, 250).to_pylist():
            yield t or ""


#: What one Arrow batch between the JVM and a Python worker holds at most.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches for rows of whole documents; smaller settings of the session are left.

    The session's defaults are made for narrow rows. Spark reads these settings when a result is
    worked out, not when it is declared, so they stay with the session: every operator of this
    package that runs Python lowers maxRecordsPerBatch and maxBytesPerBatch of the session that
    it is called in, for good. Use a session of its own where that matters.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(name)).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), whatever else df carries, so clashing extra columns cannot matter."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
