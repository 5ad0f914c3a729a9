"""Printed tables from positioned text and drawn boxes.

A page is one row: its visual rows and its bands of boxes are arrays, whose size a printed page
bounds. Headings, columns and data are then found by expressions over these arrays, and no Python runs.
What pages of one form share is worked out once: the bands of a drawing, the columns of a layout.

cells: doc_id, page, item_ord, x0, x1, xc, y, text     boxes: doc_id, page, x0, x1, y0, y1
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.taxid import looks_like_tax_id
from ..functions.text import is_value, norm, trimmed
from . import config as C
from .cluster import first_near, pair_anchors
from .edges import centre_index, cover_index, let, nearest_of, place_of
from .match import overlap

PAGE = ["doc_id", "page"]


def head(array: Column) -> Column:
    return F.get(array, F.lit(0))


def joined(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: c["text"]), " ")


def containing(band: Column, x: Column) -> Column:
    """The first of a band's boxes, left to right, with x0 <= x < x1; null for none."""
    return F.get(band["cells"], place_of(band["index"], x))


def before_stop(rows: Column, stops, number: str) -> Column:
    """The rows of a sorted array whose number is below that of the first one that stops; all without one."""
    return let(head(F.filter(rows, stops))[number], lambda stop: F.filter(rows, lambda r: stop.isNull() | (r[number] < stop)))


def widest_band(bands: Column, y: Column) -> Column:
    """Of the bands with y0 <= y <= y1 and more than one cell that with most cells, the topmost of equal ones."""
    fit = F.filter(bands, lambda b: (y >= b["y0"]) & (y <= b["y1"]) & (F.size(b["cells"]) > 1))
    return head(F.sort_array(F.transform(fit, lambda b: F.struct((-F.size(b["cells"])).alias("n"), b["y0"].alias("y0"), b["band_no"].alias("band_no"), b["cells"].alias("cells")))))


def last_levels(values: Column, n: int) -> Column:
    """The n largest distinct values of an array, the largest first."""
    return F.slice(F.reverse(F.array_sort(F.array_distinct(values))), 1, n)


def page_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, page, rows array<struct<row_no, y, cells, text>>): cells in visual rows, from the top; a row's y is
    that of its first cell, and cells within the tolerance of it belong to the row. Cells are sorted by place
    once for a page, so a row is a slice of them."""
    text = F.col("text")
    shown = cells.where(trimmed(text) != "")
    # worked out ahead of the grouping, where they are compiled and share their parts
    known = shown.withColumns({"n": norm(text), "id": looks_like_tax_id(text)})
    cell = F.struct("x0", "y", "item_ord", "x1", "xc", "text", "n", "id")
    placed = known.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(F.col("y").cast("double").alias("at"), cell.alias("cell")))).alias("_placed"))
    starts = F.transform("_placed", lambda c, i: F.struct(c["at"].alias("y"), i.alias("i")))

    def begun(kept, c):
        last = F.get(kept, F.size(kept) - 1)["y"]
        return F.when((F.size(kept) > 0) & (last.eqNullSafe(c["y"]) | (c["y"] - last <= C.ROW)), kept).otherwise(F.array_append(kept, c))

    def cut(starts):
        end = lambda k: F.coalesce(F.get(starts, k + 1)["i"], F.size("_placed"))
        own = lambda s, k: F.sort_array(F.transform(F.slice("_placed", s["i"] + 1, end(k) - s["i"]), lambda c: c["cell"]))
        return F.transform(starts, lambda s, k: let(own(s, k), lambda cs: F.struct((k + 1).alias("row_no"), s["y"].alias("y"), cs.alias("cells"), joined(cs).alias("text"))))

    return placed.select(*PAGE, let(F.aggregate(starts, F.slice(starts, 1, 0), begun), cut).alias("rows"))


def rows_of(cells: DataFrame) -> DataFrame:
    """(doc_id, page, row_no, y, cells, text): the visual rows of page_rows one by one."""
    return page_rows(cells).select(*PAGE, F.inline("rows"))


def _real(boxes: DataFrame) -> DataFrame:
    return boxes.where((F.col("x1") - F.col("x0") >= C.BOX_WIDTH) & (F.col("y1") - F.col("y0") >= C.BOX_HEIGHT))


def bands_of(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, band_no, y0, y1, cells array<struct<x0, x1>>, index of the cells' edges): boxes of equal
    top and bottom, from the top; lines are left out, and a cell that is drawn twice counts once."""
    real = _real(boxes)
    edges = real.groupBy(*PAGE, "y0", "y1").agg(F.min("x0").alias("o"))
    kept = edges.groupBy(*PAGE).agg(pair_anchors(F.sort_array(F.collect_list(F.struct(F.col("y0").alias("a"), "o", F.col("y1").alias("b")))), C.BAND).alias("kept"))
    at = real.join(kept, PAGE).withColumn("band_no", first_near(F.col("kept"), F.col("y0"), F.col("y1"), C.BAND))
    drawn = F.sort_array(F.collect_list(F.struct("y0", F.col("x0").alias("a"), F.col("x1").alias("b"))))
    found = at.groupBy(*PAGE, "band_no").agg(head(F.first(F.slice("kept", F.col("band_no").cast("int"), 1))).alias("k"), pair_anchors(drawn, C.SAME_CELL).alias("cells"))
    cells = F.sort_array(F.transform("cells", lambda c: F.struct(c["a"].alias("x0"), c["b"].alias("x1"))))
    found = found.select(*PAGE, "band_no", F.col("k")["a"].alias("y0"), F.col("k")["b"].alias("y1"), cells.alias("cells"))
    return found.withColumn("index", cover_index(F.col("cells"), "x0", "x1"))


def _listed(bands: DataFrame) -> DataFrame:
    return bands.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("y0", "band_no", "y1", "cells", "index"))).alias("bands"))


def page_bands(boxes: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(doc_id, page, bands array, form): the bands of bands_of. Pages of one form are drawn alike, so the bands of each
    distinct drawing are worked out once. A drawing is the text of its boxes, which is compared byte by byte, and
    form is that of its bands. keep writes a table that is read more than once."""
    drawn, known = page_forms(boxes, keep)
    return drawn.join(known, "drawing").select(*PAGE, "bands", "form")


def page_forms(boxes: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """page_bands as two tables, so that bands needn't move with their pages: (doc_id, page, drawing) and, of each
    drawing, (drawing, bands, form)."""
    sides, real = ("y0", "y1", "x0", "x1"), _real(boxes)
    # zeros lose their sign: as numbers they are equal
    text = F.concat_ws(" ", *[F.when(F.col(c) == 0, "0").otherwise(F.col(c).cast("string")) for c in sides])
    drawn = keep(real.groupBy(*PAGE).agg(F.array_join(F.sort_array(F.collect_set(text)), "|").alias("drawing")))
    first = drawn.select("drawing").distinct().withColumns({"doc_id": F.sha2("drawing", 256), "page": F.lit(1)})
    parts = first.select(*PAGE, F.explode(F.split("drawing", "[|]")).alias("b")).select(*PAGE, F.split("b", " ").alias("b"))
    again = parts.select(*PAGE, *[F.get("b", F.lit(n)).cast(real.schema[c].dataType).alias(c) for n, c in enumerate(sides)])
    return drawn, keep(first.join(_listed(bands_of(again)), PAGE).select("drawing", "bands", form_of(F.col("bands")).alias("form")))


def form_of(bands: Column) -> Column:
    """Bands without their indexes as a text."""
    return F.to_json(F.transform(bands, lambda b: F.struct(*[b[k].alias(k) for k in ("y0", "band_no", "y1", "cells")])))


def pages_of(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """One row for each page: rows and bands as arrays from the top."""
    return whole_pages(rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("row_no", "y", "cells", "text"))).alias("rows")), _listed(bands))


def whole_pages(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """The same of page_rows and page_bands."""
    title = F.array_join(F.transform(F.slice("rows", 1, 3), lambda x: x["text"]), "\n")
    both = rows.join(bands, PAGE, "left").withColumns({"title": title, "lines": F.array_join(F.transform("rows", lambda x: x["text"]), "\n")})
    return both.withColumn("bands", F.coalesce("bands", F.slice("bands", 1, 0), F.array().cast(both.schema["bands"].dataType)))


def drawn_pages(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """(doc_id, page, rows, drawing, title, front) of page_rows and the drawings of page_forms; front is the text of a first page."""
    text = lambda rows: F.array_join(F.transform(rows, lambda x: x["text"]), "\n")
    return rows.join(drawn, PAGE, "left").withColumns({"title": text(F.slice("rows", 1, 3)), "front": F.when(F.col("page") <= 1, text(F.col("rows")))})


def with_bands(pages: DataFrame, forms: DataFrame) -> DataFrame:
    """What whole_pages gives, of drawn_pages and the forms of page_forms."""
    both = pages.join(forms, "drawing", "left").withColumn("lines", F.coalesce("front", F.array_join(F.transform("rows", lambda x: x["text"]), "\n")))
    bands = F.coalesce("bands", F.slice("bands", 1, 0), F.array().cast(both.schema["bands"].dataType))
    return both.select(*PAGE, "rows", bands.alias("bands"), "form", "title", "lines")


def _ruled(page: dict[str, Column]) -> Column:
    """The columns that the drawn cells of the data band make, or null."""
    rows, bands = page["rows"], page["bands"]
    data = head(F.filter(bands, lambda b: b["band_no"] == page["band"]))
    inside = lambda b, r: (r["y"] >= b["y0"]) & (r["y"] <= b["y1"])
    holds = lambda b: F.exists(rows, lambda r: inside(b, r) & F.exists(r["cells"], lambda c: c["value"] & place_of(b["index"], c["xc"]).isNotNull()))
    marked = F.transform(bands, lambda b: F.struct(b["y0"].alias("y0"), b["y1"].alias("y1"), b["cells"].alias("cells"), b["index"].alias("index"), holds(b).alias("holds")))

    def climbed(d, marked):
        """The bands above the data band, level by level, up to one that holds a value."""
        start = F.struct(d["y0"].alias("top"), F.slice(marked, 1, 0).alias("zone"), F.lit(True).alias("go"))

        def step(s, _):
            def up(level):
                top = F.array_max(F.transform(level, lambda b: b["y0"]))
                goes = (top < s["top"]) & (d["y0"] - top <= C.HEADER_HEIGHT)
                more = F.struct(F.when(goes, top).otherwise(s["top"]).alias("top"), F.concat(s["zone"], level).alias("zone"), goes.alias("go"))
                stop = F.struct(s["top"].alias("top"), s["zone"].alias("zone"), F.lit(False).alias("go"))
                return F.when((F.size(level) == 0) | F.exists(level, lambda b: b["holds"]), stop).otherwise(more)

            level = F.filter(marked, lambda b: (b["y0"] < s["top"]) & (F.abs(b["y1"] - s["top"]) <= C.TOUCHING))
            return F.when(s["go"], let(level, up)).otherwise(s)

        return F.aggregate(marked, start, step, lambda s: s["zone"])

    def columns(d, zone):
        first = F.array_min(F.transform(zone, lambda b: b["y0"]))
        above = F.filter(rows, lambda r: (r["y"] < d["y0"]) & (r["y"] >= first))

        def placed(r):
            """A row's header cells with the narrowest drawn cell that holds each."""

            def best(c):
                options = F.transform(zone, lambda b, i: F.when(inside(b, r), let(containing(b, c["xc"]), lambda k: F.when(k.isNotNull(), F.struct((k["x1"] - k["x0"]).alias("w"), i.alias("i"), k["x0"].alias("a"), k["x1"].alias("b"), b["y0"].alias("y0"))))))
                return let(F.array_min(F.array_compact(options)), lambda k: F.when(k.isNotNull(), F.struct(k["a"].alias("a"), k["b"].alias("b"), k["y0"].alias("y0"), c["text"].alias("text"), first_near(F.transform(d["cells"], lambda x: F.struct(x["x0"].alias("a"), x["x1"].alias("b"))), k["a"], k["b"], C.ALIGNED).alias("column"))))

            return F.array_compact(F.transform(r["cells"], best))

        def built(texts):
            leaf = lambda i: F.trim(joined(F.filter(texts, lambda t: t["column"] == i + 1)))
            over = F.filter(texts, lambda t: t["column"] == 0)

            def groups(anchors):
                named = F.transform(anchors, lambda g, n: F.struct(g["y0"].alias("y0"), n.alias("n"), g["a"].alias("a"), g["b"].alias("b"), F.trim(joined(F.filter(over, lambda t: first_near(anchors, t["a"], t["b"], C.ALIGNED) == n + 1))).alias("text")))
                levels = last_levels(F.transform(anchors, lambda g: g["y0"]), C.ANCESTOR_LEVELS)
                return F.filter(F.sort_array(named), lambda g: F.array_contains(levels, g["y0"]) & (g["text"] != "") & ~is_value(g["text"]))

            def made(gs):
                def one(k, i):
                    xc = (k["x0"] + k["x1"]) / 2
                    own = F.transform(F.filter(gs, lambda g: (xc >= g["a"]) & (xc < g["b"])), lambda g: g["text"])
                    return F.struct(i.alias("i"), k["x0"].alias("x0"), k["x1"].alias("x1"), xc.alias("xc"), leaf(i).alias("leaf"), own.alias("ancestors"))

                return F.transform(d["cells"], one)

            return let(let(pair_anchors(over, C.ALIGNED), groups), made)

        made = let(F.flatten(F.transform(above, placed)), built)
        return F.when(F.size(zone) > 0, let(made, lambda m: F.when(F.exists(m, lambda c: c["leaf"] != ""), m)))

    return let(data, lambda d: F.when(d.isNotNull(), let(marked, lambda m: let(climbed(d, m), lambda zone: columns(d, zone)))))


def _heuristic(page: dict[str, Column]) -> Column:
    """The columns by the header row's cells alone, for pages without drawn cells."""
    rows, header, data = page["rows"], page["header"], page["data"]
    heads = header["cells"]
    below = F.flatten(F.transform(F.filter(rows, lambda r: (r["row_no"] > header["row_no"]) & (r["row_no"] < data["row_no"])), lambda r: r["cells"]))
    above = F.filter(rows, lambda r: (r["row_no"] < header["row_no"]) & (r["row_no"] >= header["row_no"] - C.ANCESTOR_LEVELS) & (header["y"] - r["y"] <= C.ANCESTOR_HEIGHT))

    def ancestor(h):
        def of(r):
            def chosen(gs):
                def domain(g, i):
                    width = g["x1"] - g["x0"]
                    left = F.coalesce((F.get(gs, i - 1)["x1"] + g["x0"]) / 2, g["x0"] - width)
                    right = F.coalesce((g["x1"] + F.get(gs, i + 1)["x0"]) / 2, g["x1"] + width)
                    share = overlap(g["x0"], g["x1"], h["x0"], h["x1"])
                    return F.struct(share.alias("share"), i.alias("i"), left.alias("left"), right.alias("right"), g["text"].alias("text"))

                def pick(ds):
                    best = F.array_max(F.filter(ds, lambda d: d["share"] >= C.OVERLAP))
                    reign = head(F.filter(ds, lambda d: (h["xc"] >= d["left"]) & (h["xc"] <= d["right"])))
                    return F.coalesce(best["text"], reign["text"])

                return let(F.transform(gs, domain), pick)

            return let(F.filter(r["cells"], lambda c: ~c["value"]), chosen)

        return F.array_compact(F.transform(above, of))

    numbered = F.transform(heads, lambda h, i: F.struct(h["xc"].alias("xc"), i.alias("i")))
    near = let(centre_index(numbered, "xc", "i"), lambda index: F.transform(below, lambda c: F.struct(nearest_of(index, c["xc"]).alias("i"), c["text"].alias("text"))))

    def one(h, i, near):
        more = F.transform(F.filter(near, lambda c: c["i"] == i), lambda c: c["text"])
        leaf = F.trim(F.array_join(F.concat(F.array(h["text"]), more), " "))
        return F.struct(i.alias("i"), h["x0"].alias("x0"), h["x1"].alias("x1"), h["xc"].alias("xc"), leaf.alias("leaf"), ancestor(h).alias("ancestors"))

    return let(near, lambda near: F.transform(heads, lambda h, i: one(h, i, near)))


def search_keys(ancestors: Column, leaf: Column) -> Column:
    """Keys from the most to the least specific: all ancestors, the last one, none."""
    whole = norm(F.array_join(F.concat(ancestors, F.array(leaf)), " "))
    near = norm(F.concat_ws(" ", F.get(ancestors, F.size(ancestors) - 1), leaf))
    keys = F.when(F.size(ancestors) > 0, F.array(whole, near, norm(leaf))).otherwise(F.array(norm(leaf)))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def laid_out(pages: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """pages with layout, all that columns depend on (the bands, which of them holds the data, and the rows at the
    headings, numbered from the header row), and live, the rows from the first one with a tax id up to that of
    accumulated totals: how many were read, and those with a tax id. Both are null without a table, and stand in place
    of rows and bands. Columns of pages that are named in own go into the layout."""
    rows = F.col("rows")
    has = lambda r: F.forall("anchors", lambda a: F.exists(r["cells"], lambda c: c["n"] == a)) & (F.size(r["cells"]) > F.size("anchors"))
    one = pages.withColumn("header", head(F.filter(rows, has)))
    two = one.withColumn("data", head(F.filter(rows, lambda r: (r["row_no"] > F.col("header")["row_no"]) & F.exists(r["cells"], lambda c: c["id"]))))
    three = two.withColumn("band", F.when(F.col("data").isNotNull(), widest_band(F.col("bands"), F.col("data")["y"])))
    band, header, data = F.col("band"), F.col("header")["row_no"], F.col("data")["row_no"]
    top = F.array_min(F.transform(F.filter("bands", lambda b: b["y0"] < band["y0"]), lambda b: b["y0"]))
    # the climb looks at bands that end at most TOUCHING below the top of the data band, and at rows inside them
    near = lambda r: F.coalesce((r["y"] >= top) & (r["y"] <= band["y0"] + C.TOUCHING), F.lit(False)) | ((r["row_no"] >= header - C.ANCESTOR_LEVELS) & (r["row_no"] < data))
    short = lambda r: F.struct((r["row_no"] - header).alias("row_no"), r["y"].alias("y"), F.transform(r["cells"], lambda c: F.struct(*[c[k].alias(k) for k in ("x0", "x1", "xc", "text")])).alias("cells"))
    form = F.coalesce(F.col("form"), F.lit("[]")) if "form" in pages.columns else form_of(F.col("bands"))
    layout = F.struct(*own, form.alias("form"), band["band_no"].alias("band"), (data - header).alias("data"), F.transform(F.filter(rows, near), short).alias("rows"))
    found = F.col("data").isNotNull()

    def with_id(live):
        cells = lambda r: F.transform(r["cells"], lambda c: F.struct(c["xc"].alias("xc"), c["text"].alias("text")))
        kept = F.filter(live, lambda r: F.exists(r["cells"], lambda c: c["id"]))
        return F.struct(F.size(live).alias("read"), F.transform(kept, lambda r: F.struct(r["row_no"].alias("row_no"), cells(r).alias("cells"))).alias("rows"))

    # rows above are passed over where the others are placed, so that no row is copied twice
    live = let(F.filter("rows", lambda r: r["row_no"] >= data), lambda rows: before_stop(rows, lambda r: r["text"].rlike(C.TOTALS_ROW), "row_no"))
    return three.withColumns({"layout": F.when(found, layout), "live": F.when(found, let(live, with_id))}).drop("header", "data", "band", "rows", "bands", "form", "anchors")


def columns_of(layouts: DataFrame, kind: ArrayType) -> DataFrame:
    """layouts(layout), for bands of a kind, with path ('rayado' or 'heuristico'), columns array<struct<i, x0, x1, xc, leaf, ancestors,
    label, keys>> and the indexes of their edges and centres."""
    cell = lambda c: F.struct(*[c[k].alias(k) for k in ("x0", "x1", "xc", "text")], is_value(c["text"]).alias("value"))
    rows = F.transform(F.col("layout")["rows"], lambda r: F.struct(r["row_no"].alias("row_no"), r["y"].alias("y"), F.transform(r["cells"], cell).alias("cells")))
    told = ArrayType(StructType([f for f in kind.elementType if f.name != "index"]))
    bands = F.transform(F.from_json(F.col("layout")["form"], told), lambda b: F.struct(*[b[k].alias(k) for k in ("y0", "band_no", "y1", "cells")], cover_index(b["cells"], "x0", "x1").alias("index")))
    layouts = layouts.withColumns({"_rows": rows, "_bands": bands})
    page = {"rows": F.col("_rows"), "bands": F.col("_bands"), "band": F.col("layout")["band"]}
    page |= {"header": head(F.filter(page["rows"], lambda r: r["row_no"] == 0)), "data": F.struct(F.col("layout")["data"].alias("row_no"))}
    three = layouts.withColumn("ruled", _ruled(page))
    four = three.withColumn("plain", F.when(F.col("ruled").isNull(), _heuristic(page)))
    path = F.when(F.col("ruled").isNotNull(), "rayado").otherwise("heuristico")
    named = lambda c: F.struct(c["i"].alias("i"), c["x0"].alias("x0"), c["x1"].alias("x1"), c["xc"].alias("xc"), c["leaf"].alias("leaf"), c["ancestors"].alias("ancestors"), F.array_join(F.concat(c["ancestors"], F.array(c["leaf"])), " > ").alias("label"), search_keys(c["ancestors"], c["leaf"]).alias("keys"))
    five = four.withColumns({"path": path, "columns": F.transform(F.coalesce("ruled", "plain"), named)})
    return five.withColumns({"edges": cover_index(F.col("columns"), "x0", "x1"), "centres": centre_index(F.col("columns"), "xc", "i")}).drop("ruled", "plain", "_rows", "_bands")


def locate_tables(pages: DataFrame, own: tuple[str, ...] = (), keep: Callable[[DataFrame], DataFrame] = lambda df: df, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """pages(doc_id, page, rows, bands, anchors array<string>, ...) with the table of each: what laid_out and
    columns_of find, path null for no table. Pages of one form have one layout, whose columns are worked out
    once; keep may add to that table and writes it. hold writes what laid_out finds, which is read twice."""
    laid = hold(laid_out(pages, own))
    # a null layout is kept here and meets no page: a filter would be planned ahead of what it looks at, and that worked out twice
    known = keep(columns_of(laid.select("layout").distinct(), pages.schema["bands"].dataType))
    return laid.join(known, "layout", "left").drop("layout")


def read_rows(tables: DataFrame) -> DataFrame:
    """tables with `lines` array<struct<row_no, values>>, one text for each column, and the counts
    read, dropped (rows without a tax id), outside (cells in no column) and colliding (cells that
    were put after another one in a column)."""
    columns, total = F.col("columns"), lambda array, f: F.aggregate(array, F.lit(0), lambda s, r: s + f(r))
    inside = lambda c: F.coalesce(F.get(columns, place_of(F.col("edges"), c["xc"]))["i"], F.lit(-1))
    nearest = lambda c: nearest_of(F.col("centres"), c["xc"])

    def put(r):
        cells = lambda of: F.transform(r["cells"], lambda c: F.struct(of(c).alias("i"), c["text"].alias("text")))
        return F.struct(r["row_no"].alias("row_no"), F.when(F.col("path") == "rayado", cells(inside)).otherwise(cells(nearest)).alias("cells"))

    live = F.when(F.col("path").isNotNull(), F.col("live"))
    tables = tables.withColumns({"read": live["read"], "placed": F.transform(live["rows"], put), "_all": F.transform(columns, lambda k: k["i"])})
    each = lambda r, k: F.transform(r["cells"], lambda c: c[k])
    # most lines have one cell in each column, in order: those are the values
    values = lambda r: F.when(each(r, "i") == F.col("_all"), each(r, "text")).otherwise(F.transform("_all", lambda k: joined(F.filter(r["cells"], lambda c: c["i"] == k))))
    line = lambda r: F.struct(r["row_no"].alias("row_no"), values(r).alias("values"))
    out = F.filter(F.flatten(F.transform("placed", lambda r: r["cells"])), lambda c: c["i"] < 0)
    colliding = total(F.col("placed"), lambda r: let(F.filter(each(r, "i"), lambda i: i >= 0), lambda own: F.size(own) - F.size(F.array_distinct(own))))
    return tables.withColumns({"lines_read": F.transform("placed", line), "dropped": F.col("read") - F.size("placed"), "outside": F.size(out), "colliding": colliding}).drop("placed", "_all", "live", "edges", "centres")
