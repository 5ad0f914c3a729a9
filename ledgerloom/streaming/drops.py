"""Vouchers dropped into a folder over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import config as C
from ..sources.archive import is_document, junk, unpacked

FILES = "path string, modificationTime timestamp, length bigint, content binary"
LINES = "person string, field string, value decimal(20,6), at timestamp"


def arriving_entries(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """A stream of the entries of ZIP archives as they are dropped into a folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "*.zip").load(folder)
    return unpacked(files).where(F.col("path").isNull() | ~junk(F.col("path"))).withColumn("is_document", F.col("path").isNull() | is_document(F.col("path")))


def running_sums(lines: DataFrame) -> DataFrame:
    """(person, field, total, n): summed fields of voucher lines, kept up to date."""
    summed = [f for f, (rule, _) in C.FIELDS.items() if rule == "sum"]
    return lines.where(F.col("field").isin(*summed)).groupBy("person", "field").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def monthly_sums(lines: DataFrame, late: str = "40 days") -> DataFrame:
    """(month, field, total) over event time; lines later than the watermark are dropped."""
    month = F.window("at", "30 days").alias("w")
    return lines.withWatermark("at", late).groupBy(month, "field").agg(F.sum("value").alias("total")).select(F.col("w.start").alias("month"), "field", "total")


def each_batch(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a whole plan on every micro-batch; the checkpoint makes a restart go on where it was."""
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).start()
