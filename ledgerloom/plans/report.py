"""The analytic model of a run, its regression fixture and the privacy gate: aggregates only."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import config as C
from ..operators import stats
from .ledger import Ledger

#: fixed value: fields that identify a line and are no concept of their own
IDENTIFYING = ("rut", "nombre", "dias", "codMov", "fechaDesde", "fechaHasta", "rutSubs")
PERSONAL = r"(?<![A-Za-z0-9_])\d{1,3}(?:\.\d{3})+-[\dkK](?![A-Za-z0-9_])"
SHORTEST_NAME = 5


def sections(result: Ledger) -> DataFrame:
    """(file, section, columns, first_page, last_page)."""
    return result.columns.groupBy("file", "section").agg(F.count("*").alias("columns"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"))


def concepts(result: Ledger) -> DataFrame:
    """(file, fields, groups): the fields and top headings of each document."""
    top = F.when(F.col("label").contains(" > "), F.split_part("label", F.lit(" > "), F.lit(1)))
    fields = F.when(F.col("field").isNotNull() & ~F.col("field").isin(*IDENTIFYING), F.col("field"))
    return result.columns.groupBy("file").agg(F.sort_array(F.collect_set(fields)).alias("fields"), F.sort_array(F.collect_set(top)).alias("groups"))


def populations(result: Ledger) -> DataFrame:
    """One row: persons in all, only in the first document, in the first two; duplicates left out."""
    used = result.documents.where("duplicate_of is null and profile is not null").select("doc_id", "doc_ord")
    names = [r["doc_id"] for r in used.orderBy("doc_ord", "doc_id").limit(2).collect()] + ["", ""]
    rows = result.records.where("field = 'rut'").join(used.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("id.body").alias("body"))
    return stats.overlap(rows, "body", "doc_id", *names[:2])


def coverage(result: Ledger) -> DataFrame:
    """(source, items): layout columns without a value that only absent institutions could fill."""
    spark = result.ledger.sparkSession
    with C.using(result.config):
        return _coverage(spark, result)


def _coverage(spark: SparkSession, result: Ledger) -> DataFrame:
    can = sorted({(C.PROFILES[C.SECTIONS[s][0]][0], C.FIELDS[f][1]) for s in C.SECTIONS for b, _, f in C.LABELS if b in (s, "common") and C.FIELDS[f][1]})
    names = {p: spec[0] for p, spec in C.PROFILES.items()}
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    present = result.documents.where("duplicate_of is null and profile is not null").select(label[F.col("profile")].alias("source")).distinct()
    has = lambda c: F.bool_or((F.col(c.name) != 0) if c.kind == "N" else (F.col(c.name) != "")).alias(c.header)
    columns = {C.column(col).at: C.column(col) for _, col in can}
    filled = result.ledger.agg(*[F.coalesce(has(c), F.lit(False)).alias(c.header) for c in columns.values()])
    filled = filled.unpivot([], [c.header for c in columns.values()], "item", "has").where("has").select("item")
    return stats.missing_coverage(spark.createDataFrame(can, "source string, item string"), present, filled)


def with_value(result: Ledger, header: str) -> DataFrame:
    return result.ledger.agg(F.count_if(F.col(C.column(header).name) > 0).alias("n"))


def field_profile(result: Ledger) -> DataFrame:
    """(file, field, with_value, total): total is null for text fields."""
    rows = result.records.join(result.documents.select("doc_id", "file"), "doc_id")
    return stats.field_profile(rows, ["file", "field"], F.lit(True), F.col("num"))


def column_profile(result: Ledger) -> DataFrame:
    """(name, distinct, total) of every output column."""
    return stats.column_profile(result.ledger, [c.name for c in C.LAYOUT])


def warning_histogram(result: Ledger) -> DataFrame:
    return stats.histogram_with_details(result.warnings, "kind", "detail", ["prio", "ord"])


def fixture(result: Ledger) -> DataFrame:
    """(path, value) of everything a regression run compares; no row-level data."""
    flat = lambda df, path, value: df.select(path.alias("path"), value.cast("string").alias("value"))
    at = lambda *parts: F.concat_ws(".", *[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]) if isinstance(p, str) else p for p in parts])
    docs, fields, columns = result.documents, field_profile(result), column_profile(result)
    parts = [flat(docs, at("documents", "$file", name), F.col(name)) for name in ("pages", "profile", "institution", "folio", "state", "n_records", "read", "dropped", "outside", "colliding")]
    parts += [flat(fields, at("fields", "$file", "$field", name), F.col(name)) for name in ("with_value", "total")]
    parts += [flat(columns, at("columns", "$name", name), F.col(name)) for name in ("distinct", "total")]
    parts += [flat(result.control, at("control", "$file", "$label", name), F.col(name)) for name in ("amount", "extracted", "ok")]
    parts += [flat(result.warnings.groupBy("kind").count(), at("warnings", "$kind"), F.col("count"))]
    return reduce(DataFrame.unionByName, parts)


def load_fixture(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, value string").json(path)


def save_fixture(rows: DataFrame, path: str, update: bool = False) -> str:
    """Writes a fixture as JSON lines and returns where: an accepted one is replaced only on
    request, otherwise the proposal goes beside it."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    target = path if update or not there else f"{path}.new"
    rows.repartitionByRange(1, "path").sortWithinPartitions("path").write.mode("overwrite").json(target)
    return target


def compare_fixtures(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, kind, expected, actual): absent and changed values are differences, others are new."""
    one = F.lit(0).alias("run")
    return stats.differences(expected.select(one, "path", "value"), actual.select(one, "path", "value"), ["run"], ("sha256",)).drop("run")


class Leak(Exception):
    """Personal data in what was to be handed over; nothing was."""


def publish(result: Ledger, write: Callable[[str], None], texts: Callable[[str], DataFrame], target: str) -> str:
    """Hands output over only if it has no personal data, and returns where: all of it or none.

    write puts the output into a folder that it is given, beside the target. texts gives it back as
    (text_id, text), as it was written; if the gate finds nothing, the folder is renamed to the target,
    which only ever holds output that was looked through. An output that is there stays until then. What a
    run that was stopped left beside the target is deleted by the next one.
    """
    spark = result.records.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for left in fs.globStatus(at.suffix(".staged-*")) or ():
        fs.delete(left.getPath(), True)
    staged = f"{target}.staged-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(staged)
    write(staged)
    try:
        leaks = privacy_gate(result, texts(staged)).where("ids > 0 or names > 0").agg(F.count("*"), F.sum("ids"), F.sum("names")).first()
        if leaks[0]:
            raise Leak(f"{leaks[0]} texts with {leaks[1]} tax ids and {leaks[2]} names")
    except Exception:
        fs.delete(path, True)
        raise
    fs.delete(at, True)
    if not fs.rename(path, at):
        raise OSError(f"{staged} can't be renamed to {target}")
    return target


def privacy_gate(result: Ledger, texts: DataFrame) -> DataFrame:
    """(text_id, ids, names): personal data in texts(text_id, text) that are to leave: tax ids, and
    the distinct first words of all names in every document's records that the text contains. A
    report is handed over only if all are zero.

    A first word has no white space, so it lies within one word of the text; the two are joined by
    five characters at which they agree before the whole word is looked for.
    """
    hits = stats.privacy_hits(texts, "text_id", "text", PERSONAL).withColumnRenamed("hits", "ids")
    first = result.records.where("field = 'nombre'").select(F.regexp_extract("txt", r"(?U)\S+", 0).alias("w")).where(F.length("w") >= SHORTEST_NAME).distinct()
    first = first.select("w", F.substring("w", 1, SHORTEST_NAME).alias("part"))
    words = texts.select(F.col("text_id").alias("id"), F.explode(F.split("text", r"(?U)\s+")).alias("word")).where(F.length("word") >= SHORTEST_NAME).distinct()
    at = F.sequence(F.lit(1), F.length("word") - SHORTEST_NAME + 1)
    parts = words.select("id", "word", F.explode(F.array_distinct(F.transform(at, lambda i: F.col("word").substr(i, F.lit(SHORTEST_NAME))))).alias("part"))
    found = parts.join(first, "part").where(F.col("word").contains(F.col("w"))).groupBy("id").agg(F.count_distinct("w").cast("int").alias("n"))
    return hits.join(found, hits["text_id"].eqNullSafe(found["id"]), "left").select("text_id", "ids", F.coalesce("n", F.lit(0)).alias("names"))
