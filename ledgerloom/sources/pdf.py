"""PDF pages to cells and boxes: the place where a PDF library plugs in.

None is part of this package. A reader is a function from a document's bytes to an iterator of
("cell", page, order, x0, x1, y, text) and ("box", page, x0, x1, y0, y1) in visual points, with
the page's rotation undone. Everything after it works on the two tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id string, kind string, page int, item_ord int, x0 double, x1 double, y0 double, y1 double, text string, error string"


def drawn(documents: DataFrame, reader: Callable[[bytes], Iterator[tuple]] | None) -> DataFrame:
    """Cells, boxes and errors of documents(doc_id, data, error). A document that can't be read, or
    came with an error, gives one row with its error, and the others go on. Rows are passed on a few
    thousand at a time."""
    if reader is None:
        raise RuntimeError("reading PDF needs a reader function: no PDF library is bundled; pass cells and boxes as tables instead")

    def run(frames):
        import pandas as pd

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            for doc, data, error in zip(frame["doc_id"], frame["data"], frame["error"]):
                rows = []
                try:
                    if error is not None:
                        raise ValueError(error)
                    for kind, page, *rest in reader(bytes(data)):
                        if kind == "cell":
                            order, x0, x1, y, text = rest
                            rows.append((doc, kind, page, order, x0, x1, y, None, text, None))
                        else:
                            x0, x1, y0, y1 = rest
                            rows.append((doc, kind, page, None, x0, x1, y0, y1, None, None))
                except Exception as e:  # noqa: BLE001  a broken document must not stop the run
                    rows = [(doc, "error", None, None, None, None, None, None, None, str(e) or type(e).__name__)]
                for at in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[at : at + 5000], columns=names)

    error = F.col("error") if "error" in documents.columns else F.lit(None).cast("string").alias("error")
    return documents.select("doc_id", "data", error).mapInPandas(run, SCHEMA)


def cells(items: DataFrame) -> DataFrame:
    return items.where("kind = 'cell'").select("doc_id", "page", "item_ord", "x0", "x1", ((F.col("x0") + F.col("x1")) / 2).alias("xc"), F.col("y0").alias("y"), "text")


def boxes(items: DataFrame) -> DataFrame:
    return items.where("kind = 'box'").select("doc_id", "page", "x0", "x1", "y0", "y1")


def errors(items: DataFrame) -> DataFrame:
    return items.where("kind = 'error'").select("doc_id", "error")


def times(m: Column, n: Column) -> Column:
    """The product of two affine maps [a, b, c, d, e, f]: first n, then m."""
    at = lambda x, k: F.get(x, F.lit(k))
    row = lambda k, p, q: at(m, k) * p + at(m, k + 2) * q
    return F.array(
        row(0, at(n, 0), at(n, 1)), row(1, at(n, 0), at(n, 1)), row(0, at(n, 2), at(n, 3)), row(1, at(n, 2), at(n, 3)),
        row(0, at(n, 4), at(n, 5)) + at(m, 4), row(1, at(n, 4), at(n, 5)) + at(m, 5),
    )


def replayed(operators: DataFrame, views: DataFrame) -> DataFrame:
    """boxes (doc_id, page, x0, x1, y0, y1) of drawn paths, from pages' operator lists.

    operators has doc_id, page, seq, op and args: save, restore, transform (six numbers) and path (the
    corners x0, y0, x1, y1 of what is drawn); others are passed over. views has doc_id, page and view,
    the map from the page to visual points. A restore without a save leaves the map as it is. A page's
    operators are one row, whose size the printed page bounds.
    """
    pages = operators.where("op in ('save', 'restore', 'transform', 'path')").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "op", "args"))).alias("ops"))
    path = "array<struct<box:array<double>,map:array<double>>>"
    start = F.struct(F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))).alias("map"), F.array().cast("array<array<double>>").alias("saved"), F.array().cast(path).alias("out"))

    def step(s, o):
        state = lambda m, saved, out: F.struct(m.alias("map"), saved.alias("saved"), out.alias("out"))
        n = F.size(s["saved"])
        drawn_ = F.array_append(s["out"], F.struct(o["args"].alias("box"), s["map"].alias("map")))
        return (
            F.when(o["op"] == "save", state(s["map"], F.array_append(s["saved"], s["map"]), s["out"]))
            .when(o["op"] == "restore", state(F.coalesce(F.get(s["saved"], n - 1), s["map"]), F.slice(s["saved"], 1, F.greatest(n - 1, F.lit(0))), s["out"]))
            .when(o["op"] == "transform", state(times(s["map"], o["args"]), s["saved"], s["out"]))
            .otherwise(state(s["map"], s["saved"], F.when(F.size(o["args"]) >= 4, drawn_).otherwise(s["out"])))
        )

    paths = pages.select("doc_id", "page", F.explode(F.aggregate("ops", start, step, lambda s: s["out"])).alias("p")).join(views, ["doc_id", "page"])
    placed = paths.select("doc_id", "page", "p.box", times(F.col("view"), F.col("p.map")).alias("m"))
    at = lambda x, k: F.get(F.col(x), F.lit(k))
    x = lambda i: at("m", 0) * at("box", i) + at("m", 2) * at("box", i + 1) + at("m", 4)
    y = lambda i: at("m", 1) * at("box", i) + at("m", 3) * at("box", i + 1) + at("m", 5)
    return placed.select("doc_id", "page", F.least(x(0), x(2)).alias("x0"), F.greatest(x(0), x(2)).alias("x1"), F.least(y(0), y(2)).alias("y0"), F.greatest(y(0), y(2)).alias("y1"))


def transformed(a: float, b: float, c: float, d: float, e: float, f: float):
    """The affine map of points as columns: (x, y) to (a x + c y + e, b x + d y + f)."""
    return lambda x, y: (a * x + c * y + e, b * x + d * y + f)
