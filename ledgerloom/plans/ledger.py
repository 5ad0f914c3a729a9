"""The whole plan: positioned text and drawn boxes of many documents to ledger, control and warnings.

Inputs are tables. cells and boxes hold all pages of all documents (see operators.geometry);
files has doc_id, doc_ord (documents in the order of their file names), file and error (why a
document couldn't be read, null if it could). Every step is declared over the tables as a whole:
documents are rows, not iterations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, classify, consolidate, cover, geometry, records, stats, verify
from ..operators import config as C
from ..sources import archive, pdf
from .cuts import cut, into, numbered, release
from .progress import Watch


def _configured(cls):
    """Every result of a class is declared under the configuration of its own."""

    def under(f):
        @wraps(f)
        def declared(self, *args, **named):
            with C.using(self.config):
                return f(self, *args, **named)

        return declared

    for name, attribute in list(vars(cls).items()):
        if isinstance(attribute, cached_property):
            attribute.func = under(attribute.func)
        elif isinstance(attribute, property):
            setattr(cls, name, property(under(attribute.fget), doc=attribute.__doc__))
    cls.state = under(cls.state)
    return cls


@_configured
class Ledger:
    """The results for all documents. Every table is worked out when it is first asked for and
    written once, so what isn't asked for costs nothing and nothing is read twice.

    ignored: file, file_ord of entries of the archives that aren't documents. Once the results that
    are wanted are written elsewhere, release() deletes the tables that were written on the way.
    """

    def __init__(self, files: DataFrame, cells: DataFrame, boxes: DataFrame, ignored: DataFrame | None = None, config: C.Config = C.BASE):
        self.config = config
        self._files, self._cells, self._boxes = files, cells, boxes
        self._made: list[str] = []
        self._ignored = ignored if ignored is not None else files.sparkSession.createDataFrame([], "file string, file_ord long")

    def _cut(self, df: DataFrame) -> DataFrame:
        with into(self._made):
            return cut(df)

    def release(self) -> None:
        made, self._made = self._made, []
        release(self._files.sparkSession, made)

    @cached_property
    def pages(self) -> DataFrame:
        drawn, forms = geometry.page_forms(self._boxes, self._cut)
        return geometry.with_bands(self._cut(geometry.drawn_pages(geometry.page_rows(self._cells), drawn)), forms)

    @cached_property
    def _docs(self) -> DataFrame:
        covers = self._files.join(cover.covers(self.pages, self._cut), "doc_id", "left").withColumn("folio", F.coalesce("folio", F.lit("")))
        return self._cut(mark_duplicates(self._cut(classify.classified(covers))))

    @property
    def _used(self) -> DataFrame:
        return self._docs.where("duplicate_of is null")

    @cached_property
    def tables(self) -> DataFrame:
        """The detail pages with their section, table and lines."""
        section, others = classify.section_of(F.col("profile"), F.col("title"))
        detail = self.pages.where("page > 1").join(self._docs.where("profile is not null").select("doc_id", "profile"), "doc_id")
        detail = detail.withColumns({"section": section, "other_sections": others})
        anchors = F.coalesce(classify.anchors_of(F.col("section")), F.array(F.lit("\0")))  # no section: nothing matches
        detail = detail.withColumn("anchors", anchors).drop("lines", "title")
        found = geometry.locate_tables(detail, ("section",), lambda layouts: self._cut(records.with_fields(layouts)), self._cut)
        return self._cut(geometry.read_rows(found))

    @cached_property
    def _mapped(self) -> DataFrame:
        return records.mapped_columns(self.tables)

    @cached_property
    def _values(self) -> DataFrame:
        return self._cut(records.record_values(self.tables))

    @cached_property
    def records(self) -> DataFrame:
        """(doc_id, page, row_no, field, num, txt, repeated, id) of every record, duplicates included."""
        return self._values.where(records.USABLE)

    @property
    def _mine(self) -> DataFrame:
        return self.records.join(self._used.select("doc_id"), "doc_id", "left_semi")

    @cached_property
    def columns(self) -> DataFrame:
        """The audit of every column read."""
        audit = records.audited(self._mapped, records.cell_values(self.tables))
        return self._cut(audit.join(self._docs.select("doc_id", "doc_ord", "file"), "doc_id"))

    @cached_property
    def people(self) -> DataFrame:
        """One row for each person, numbered by name; equal names by first appearance."""
        order = [F.collate(F.coalesce("nombre", F.lit("")), "es"), F.col("place.doc_ord"), F.col("place.page"), F.col("place.row_no")]
        with into(self._made):
            return cut(numbered(consolidate.people(self._mine, self._used), order))

    @cached_property
    def ledger(self) -> DataFrame:
        return consolidate.ledger(self.people)

    @cached_property
    def _compared(self) -> DataFrame:
        pairs = self._used.select("doc_id", F.posexplode("pairs").alias("pair_ord", "p")).select("doc_id", "pair_ord", "p.label", "p.amount", "p.y", "p.frame")
        return self._cut(verify.compare_covers(pairs, self._used, self._mine))

    @property
    def control(self) -> DataFrame:
        """Every comparison of a declared total with what was extracted."""
        return self._compared.where("outcome = 'compared'").join(self._docs.select("doc_id", "doc_ord", "file", "institution"), "doc_id")

    @cached_property
    def _read(self) -> DataFrame:
        """Documents with what was read of them and what wasn't."""
        empty, numbers = F.array().cast("array<string>"), F.array().cast("array<int>")
        lists = {c: F.coalesce(c, numbers if c in ("no_section", "no_table") else empty) for c in ("no_section", "no_table", "ambiguous_sections", "repeated", "paths")}
        counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("read", "dropped", "outside", "colliding", "n_records")}
        whole = self._docs.join(_reading(self.tables, self.records), "doc_id", "left").withColumns(lists | counts)
        return self._cut(whole.withColumn("lost", F.greatest(F.col("read") - F.col("dropped") - F.col("n_records"), F.lit(0))))

    @cached_property
    def _states(self) -> DataFrame:
        return self._cut(verify.states(self._read.where("duplicate_of is null"), self._compared, self._mine))

    @property
    def documents(self) -> DataFrame:
        """Every document with its institution, state, reasons and coverage; duplicates have no state."""
        return self._read.join(self._states, "doc_id", "left").join(checks.coverage(self._compared, ["doc_id"]), "doc_id", "left")

    @property
    def warnings(self) -> DataFrame:
        """(prio, ord, kind, file, detail): in the order (prio, ord)."""
        constant = stats.constant_columns(self.ledger, [c.name for c in C.LAYOUT])
        told = F.array_compact(F.array(*[F.when(F.col(c.name), F.lit(c.header)) for c in C.LAYOUT]))
        constants = constant.select(told.alias("h")).select(F.size("h").alias("n"), F.array_join("h", ", ").alias("names"))
        unread = records.unread_values(self.tables, self._values)
        audit = self.columns.join(self._used.select("doc_id"), "doc_id", "left_semi").drop("doc_ord", "file")
        own = verify.document_warnings(self._read.where("duplicate_of is null"), audit, self._compared, _first_per_document(unread, 20))
        return own.unionByName(verify.run_warnings(self._read, self._states, self._compared, self.people, constants, self._ignored))

    #: The tables of a run in the order in which they need each other.
    PHASES = ("pages", "_docs", "tables", "_mapped", "_values", "records", "columns", "people", "_compared", "_read", "_states")

    def worked_out(self, callback: Callable[[int, str], None]) -> "Ledger":
        """Works out all tables and calls back with (percent, phase) meanwhile (see plans.progress)."""
        with Watch(self._files.sparkSession, [p.strip("_") for p in self.PHASES], callback) as watch:
            for name in self.PHASES:
                watch.phase()
                getattr(self, name)
        return self

    def state(self) -> DataFrame:
        """One row: the worst state of the documents that were used."""
        return self._states.agg(checks.worst(F.col("state")).alias("state"))


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """docs with duplicate_of: the file of the first document with the same institution, folio
    and month, in whichever archive. A document without a folio is never a duplicate."""
    month = F.coalesce(F.col("period.text"), F.lit(""))
    key = ["institution", "folio", "month"]
    both = docs.withColumn("month", month)
    first = both.where("folio <> ''").groupBy(*key).agg(F.min(F.struct("doc_ord", "doc_id", "file")).alias("first"))
    later = (F.col("folio") != "") & (F.col("doc_id") != F.col("first.doc_id"))
    return both.join(first, key, "left").withColumn("duplicate_of", F.when(later, F.col("first.file"))).drop("first", "month")


def _reading(tables: DataFrame, values: DataFrame) -> DataFrame:
    """What was read and what wasn't, by document."""
    pages = lambda where: F.sort_array(F.collect_set(F.when(where, F.col("page"))))
    counts = tables.groupBy("doc_id").agg(
        pages(F.col("section").isNull()).alias("no_section"),
        pages(F.col("section").isNotNull() & F.col("path").isNull()).alias("no_table"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("other_sections").isNotNull(), F.struct("page", "other_sections")))), lambda s: s["other_sections"]).alias("ambiguous_sections"),
        F.sort_array(F.collect_set("path")).alias("paths"),
        *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("read", "dropped", "outside", "colliding")],
    )
    good = values.groupBy("doc_id").agg(F.count_if(F.col("field") == "rut").alias("n_records"), F.sort_array(F.collect_set(F.when(F.col("repeated"), F.col("field")))).alias("repeated"))
    return counts.join(good, "doc_id", "left")


def process(files: DataFrame, cells: DataFrame, boxes: DataFrame, ignored: DataFrame | None = None, config: C.Config = C.BASE) -> Ledger:
    """The run over these tables; config is what is known of institutions (see operators.config)."""
    return Ledger(files, cells, boxes, ignored, config)


def from_archives(spark: SparkSession, path: str, reader: Callable[[bytes], Iterator[tuple]] | None, config: C.Config = C.BASE) -> Ledger:
    """The whole way from ZIP archives at a path (any store and pattern that Spark reads): documents of
    all archives are numbered in one sequence by name, and a voucher that is in two archives counts
    once. reader turns a document's bytes into cells and boxes (see sources.pdf). What can't be read,
    archive or document, is a file with an error; the rest goes on."""
    made: list[str] = []
    with into(made):
        archives = archive.listed(spark, path)
        listed = cut(archive.entries(spark, archives, data=False))
        items = cut(pdf.drawn(archive.documents(archive.entries(spark, archives)), reader))
        files = archive.files(listed).join(pdf.errors(items).withColumnRenamed("error", "_error"), "doc_id", "left")
        files = files.select("doc_id", "doc_ord", "file", F.coalesce("error", "_error").alias("error"))
        run = process(cut(files), pdf.cells(items), pdf.boxes(items), archive.ignored(listed), config)
    run._made += made
    return run


def _first_per_document(bad: DataFrame, most: int) -> DataFrame:
    """At most so many values that can't be read for each document: a report, the count is kept elsewhere."""
    first = stats.first_of_each(bad, ["doc_id"], ["page", "row_no", "i", "label", "field", "raw"], most)
    return first.select("doc_id", (F.col("n") - 1).alias("n"), "label", "field", "raw")
