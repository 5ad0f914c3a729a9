"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

1. quality classifier: documents that it rejects go
2. SimHash near-dedup: one document of each group stays
3. secret scans: what is found is masked in the text
4. mixing: documents are taken, once or in several epochs, to the target weights
5. BPE: encoding and decoding, as counts and digests
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, mixing, quality, secrets, simhash
from ledgerloom.llm.common import documents, into, keep, materialize, release, scope


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_representatives(docs)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_documents(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digest(bpe.round_trip(docs, path))


STAGES = [
    ("quality classifier", _quality),
    ("simhash near-dedup", _near_dedup),
    ("secret scans", _secrets),
    ("mixing sources to target weights", _mixing),
    ("bpe encoding and decoding", _bpe),
]

#: SQL can't express the learned, linked and encoded stages; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all of documents.

    Each stage's rows are written and read again. What a stage had written besides goes once its rows
    are there, and those once the next stage's are; the last stage's input stays for the lazy result.
    """
    docs, before = documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        now: list[str] = []
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            with into(now):
                docs = materialize(out)
        release(spark, before)
        before = now
    keep(before)
    return STAGES[-1][1](spark, docs, sf_dir)
