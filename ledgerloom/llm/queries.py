"""The registered queries over the corpus operators, each a thin digest of its operator's rows."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, mixing, pii, quality, rules, secrets, sentencepieces, simhash, spotsigs, token_counts, toxicity, tries, whitening
from .common import documents


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the session's key, or else a new one: pseudonyms are then linked within this result only."""
    key = pii.session_key(spark) or os.urandom(32).hex()
    return pii.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), key)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.withColumn("over_limit", F.col("n_tokens") > token_counts.CONTEXT_LIMIT)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_rules(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_documents(documents(spark, sf_dir)))


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digest(bpe.round_trip(documents(spark, sf_dir), path))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_neighbours(documents(spark, sf_dir))


def spotsigs_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over op9's fingerprints: every document with its group of near-duplicates."""
    return spotsigs.near_duplicates(documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select_tokens(documents(spark, sf_dir))


def op11_sentencepiece_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(sentencepieces.round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith(("op", "spotsigs_")) and callable(f)}


#: The quality rules in DuckDB's SQL; WINDOWS and thresholds are written out again on purpose.
OP6_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
starts AS (SELECT rid, unnest(generate_series(1, len(w) - 4)) AS i, w FROM words WHERE len(w) >= 5),
windows AS (SELECT rid, i, w[i:i + 4] AS x FROM starts),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY rid),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines,
    length(text) - length(replace(text, '!', '')) AS n_exclamations,
    len(regexp_extract_all(text, '\p{L}')) AS n_letters,
    len(regexp_extract_all(text, '\p{Lu}')) AS n_upper,
    len(list_filter(w, lambda x: list_contains(STOP, lower(x)))) AS n_stop_words
  FROM words LEFT JOIN covered c USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND word_chars BETWEEN 2 * n_words AND 20 * n_words
  AND n_symbols <= 0.25 * n_words
  AND n_exclamations <= 0.3 * n_words
  AND n_upper <= 0.4 * n_letters
  AND n_letters >= 0.5 * word_chars
  AND (n_words < 60 OR n_stop_words >= 0.02 * n_words)
  AND n_dup_lines <= 0.4 * n_lines AS kept
FROM judged
"""


def oracle_sql() -> dict[str, str]:
    stop = "[" + ", ".join(f"'{w}'" for w in sorted(set(rules.STOP_WORDS))) + "]"
    return {"op6_quality_rules": OP6_SQL.replace("STOP", stop)}
