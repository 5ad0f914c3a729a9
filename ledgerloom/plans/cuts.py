"""Written tables that end a lineage, and numbering in one sequence."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where the cuts of the run that is being worked out are listed; a run in another thread has its own.
_listed: ContextVar[list[str] | None] = ContextVar("cuts", default=None)

#: Rows of a range that one task sorts and numbers, where there are partitions enough.
RANGE = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where the session
    names none, a temporary folder is made, but only in local mode, where all are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


@contextmanager
def into(listed: list[str]):
    """Cuts that are made inside are added to this list instead of an outer one."""
    token = _listed.set(listed)
    try:
        yield listed
    finally:
        _listed.reset(token)


@contextmanager
def scope(spark: SparkSession):
    """Cuts that are made inside are deleted at the end. Results are lazy and read their cuts, so
    they have to be written or collected inside."""
    made: list[str] = []
    try:
        with into(made):
            yield made
    finally:
        release(spark, made)


def keep(paths: Iterable[str]) -> None:
    """List cuts with those of the run around, for a result that still reads them."""
    if (listed := _listed.get()) is not None:
        listed.extend(paths)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete cuts that no result still to be worked out reads from."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, compact: bool = False) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: later steps start from files
    that outlive any executor.

    compact is for results of a shuffle with a few numbers a row: at most two files for each core,
    so that a small table doesn't become a file for every shuffle partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    (df.coalesce(2 * spark.sparkContext.defaultParallelism) if compact else df).write.parquet(path)
    if (listed := _listed.get()) is not None:
        listed.append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str = "line") -> DataFrame:
    """df with 1, 2, ... in order. Rows are written, ranged and sorted over partitions and written again;
    then every partition's numbers go on where the one before ended, so no task sorts all rows.

    There are as many partitions as the written rows need: ranging sends the driver a sample of keys for each
    partition, and each task its report, so a table of few rows mustn't take a large session's number."""
    rows = cut(df)
    n = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE)))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", "_first", before.alias("_before"))  # a row for each partition
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")
