"""Covers: who pays, for which month, and every amount that the cover declares with its label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_match, period, spaced, squish, to_number
from . import config as C
from .geometry import containing, head, let

WRITTEN_PERIOD = spaced(rf"(?iu)(?<![A-Za-z0-9_])({'|'.join(C.MONTHS)})\s+(\d{{4}})(?![A-Za-z0-9_])")

PAIR = "struct<label:string,amount:decimal(20,6),y:double,frame:bigint,unlabelled:boolean>"


def _pair(label: Column, amount: Column, y: Column, frame: Column) -> Column:
    return F.struct(label.alias("label"), amount.alias("amount"), y.alias("y"), frame.cast("long").alias("frame"), (label == "").alias("unlabelled"))


def page_period(lines: Column) -> Column:
    """The month of a page: a labelled one before one written out. A bare nn/nnnn isn't one, for
    legal footers carry such numbers."""
    written = let(F.lower(F.regexp_extract(lines, WRITTEN_PERIOD, 1)), lambda m: F.array_position(F.array(*map(F.lit, C.MONTHS)), m).cast("int"))
    year = F.regexp_extract(lines, WRITTEN_PERIOD, 2)
    spelled = period(F.concat_ws("/", F.lpad(written.cast("string"), 2, "0"), year))
    return F.when(lines.rlike(C.LABELLED_PERIOD), period(F.regexp_extract(lines, C.LABELLED_PERIOD, 1))).when(lines.rlike(WRITTEN_PERIOD), spelled)


def value_below(rows: Column, heading: str) -> Column:
    """The text under a heading, in the range up to the middle between it and its neighbours."""

    def of(row, below):
        k = F.array_position(F.transform(row["cells"], lambda c: c["n"] == heading), True).cast("int") - 1

        def found(k):
            cells = row["cells"]
            at = F.get(cells, k)
            left = (F.get(cells, k - 1)["x1"] + at["x0"]) / 2
            right = (at["x1"] + F.get(cells, k + 1)["x0"]) / 2
            return head(F.filter(below["cells"], lambda c: (left.isNull() | (c["xc"] >= left)) & (right.isNull() | (c["xc"] <= right))))["text"]

        return F.when(k >= 0, let(k, found))

    texts = F.transform(rows, lambda r, i: let(F.get(rows, i + 1), lambda b: F.when(b.isNotNull(), of(r, b))))
    return squish(head(F.array_compact(texts)))


def _ruled_pairs(rows: Column, bands: Column) -> Column:
    """Pairs of the drawn boxes: the label stands in the box to the left, or above the amount."""

    def above(band, k):
        upper = F.reverse(F.filter(rows, lambda r: (r["y"] < band["y0"]) & (band["y0"] - r["y"] <= C.LABEL_ABOVE)))
        near = lambda r: F.filter(r["cells"], lambda c: c["number"].isNull() & (c["x1"] > k["x0"] - C.LABEL_SIDE) & (c["x0"] < k["x1"] + C.LABEL_SIDE))
        texts = F.transform(upper, lambda r: F.array_join(F.transform(near(r), lambda c: c["text"]), " "))
        return squish(head(F.filter(texts, lambda t: t != "")))

    def pairs(band):
        inside = F.flatten(F.transform(F.filter(rows, lambda r: (r["y"] >= band["y0"]) & (r["y"] <= band["y1"])), lambda r: r["cells"]))
        put = F.transform(inside, lambda c: F.struct(containing(band, c["xc"]).alias("k"), c["text"].alias("text")))
        texts = F.transform(band["cells"], lambda k: squish(F.array_join(F.transform(F.filter(put, lambda p: p["k"] == k), lambda p: p["text"]), " ")))

        def made(ts):
            def one(t, i):
                left = F.coalesce(F.get(ts, i - 1), F.lit(""))
                label = F.when(to_number(left).isNull() & (left != ""), left).otherwise(above(band, F.get(band["cells"], i)))
                frame = F.round(F.get(band["cells"], F.greatest(i - 1, F.lit(0)))["x0"])
                return F.when(to_number(t).isNotNull(), let(label, lambda x: F.when(x != "", _pair(x, to_number(t), band["y0"], frame))))

            return F.array_compact(F.transform(ts, one))

        return let(texts, made)

    return F.flatten(F.transform(F.filter(bands, lambda b: F.size(b["cells"]) >= 2), pairs))


def running_labels(cells: Column, kind: str, made) -> Column:
    """An element of a kind for each cell with a number, in order: made(label, cell), where the label is
    all text since the number before it. Text after the last number belongs to none."""
    start = F.struct(F.array().cast("array<string>").alias("label"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(s, c):
        label = squish(F.array_join(s["label"], " "))
        done = F.struct(F.array().cast("array<string>").alias("label"), F.array_append(s["out"], made(label, c).cast(kind)).alias("out"))
        return F.when(c["number"].isNull(), F.struct(F.array_append(s["label"], c["text"]).alias("label"), s["out"].alias("out"))).otherwise(done)

    return F.aggregate(cells, start, step, lambda s: s["out"])


def _row_pairs(rows: Column) -> Column:
    """Pairs of bare rows: the label of an amount is all text since the amount before it; without
    any, what stands above it in one of the three rows before."""

    def above(i, cell):
        upper = F.reverse(F.filter(F.transform(rows, lambda r, j: F.struct(j.alias("j"), r["cells"].alias("cells"))), lambda r: (r["j"] < i) & (r["j"] >= i - C.LABEL_ROWS)))
        near = lambda r: F.filter(r["cells"], lambda c: c["number"].isNull() & (c["x1"] > cell["x0"]) & (c["x0"] < cell["x1"]))
        return squish(head(F.filter(F.transform(upper, lambda r: F.array_join(F.transform(near(r), lambda c: c["text"]), " ")), lambda t: t != "")))

    def pairs(r, i):
        return running_labels(r["cells"], PAIR, lambda label, c: _pair(F.when(label != "", label).otherwise(above(i, c)), c["number"], r["y"], F.lit(None)))

    return F.flatten(F.transform(rows, pairs))


def _months(pages: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, pages, period): the last page, and the period of the first page that has one. Later pages are only
    searched where the first ones have none; keep writes which documents those are, so that without any nothing is
    read again. Place and month are one number, so that numbers alone are aggregated."""
    found = let(page_period(F.col("lines")), lambda p: F.col("page").cast("long") * 1_000_000 + p["month"] * 10_000 + p["year"])
    first = lambda pages, name: pages.select("doc_id", found.alias("at")).groupBy("doc_id").agg(F.min("at").alias(name))
    ends = keep(pages.groupBy("doc_id").agg(F.max("page").alias("pages")).join(first(pages.where("page <= 1"), "early"), "doc_id", "left"))
    late = first(pages.where("page > 1").join(ends.where("early is null").select("doc_id"), "doc_id", "left_semi"), "late")
    at = F.coalesce("early", "late")
    month = F.pmod(at, F.lit(1_000_000))
    parts = F.concat_ws("/", F.lpad(F.floor(month / 10_000).cast("string"), 2, "0"), F.lpad((month % 10_000).cast("string"), 4, "0"))
    return ends.join(late, "doc_id", "left").select("doc_id", "pages", F.when(at.isNotNull(), period(parts)).alias("period"))


def covers(pages: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(doc_id, folio, period, employer, pairs, lines): the first page of each document, with the
    period of the first page that has one. pages has doc_id, page, rows, bands, lines."""
    months = _months(pages, keep)
    rows, bands = F.col("rows"), F.col("bands")
    numbered = F.transform("rows", lambda r: F.struct(r["y"].alias("y"), F.transform(r["cells"], lambda c: F.struct(*[c[k].alias(k) for k in ("x0", "x1", "xc", "text", "n")], to_number(c["text"]).alias("number"))).alias("cells")))
    first = pages.where("page = 1").withColumn("rows", numbered).select(
        "doc_id", "lines",
        F.coalesce(first_match(F.col("lines"), C.FOLIO, 1), F.lit("")).alias("folio"),
        F.struct(value_below(rows, C.EMPLOYER_NAME).alias("name"), value_below(rows, C.EMPLOYER_ID).alias("id")).alias("employer"),
        _ruled_pairs(rows, bands).cast(f"array<{PAIR}>").alias("ruled"), _row_pairs(rows).alias("plain"),
    )
    pairs = F.when(F.size("ruled") > 0, F.col("ruled")).otherwise(F.col("plain"))
    return first.select("doc_id", "lines", "folio", "employer", pairs.alias("pairs")).join(months, "doc_id", "right")
