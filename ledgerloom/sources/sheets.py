"""Cells of XLSX sheets, by the standard library alone.

A sheet and the shared strings are cut into fragments of whole rows and strings as they are inflated;
fragments are parsed by many tasks. Shared strings are a table that cells are joined to. Workbooks
of up to archive.WHOLE bytes are read whole, larger ones by byte ranges.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cuts import cut
from . import archive, ranges

_PIECE = pa.schema([("file", pa.string()), ("strings", pa.bool_()), ("first", pa.int64()), ("root", pa.binary()), ("xml", pa.binary()), ("error", pa.string())])
_CELL = pa.schema([("file", pa.string()), ("row_no", pa.int32()), ("col_no", pa.int32()), ("value", pa.string()), ("is_number", pa.bool_()), ("shared", pa.int64()), ("error", pa.string())])
_STRING = pa.schema([("file", pa.string()), ("shared", pa.int64()), ("text", pa.string())])
_PIECES = "file string, strings boolean, first long, root binary, xml binary, error string"
#: Bytes of a fragment, and cells that are passed on at a time.
FRAGMENT, HELD = 256 << 10, 20_000
SHARED = "xl/sharedStrings.xml"
_ROOT = re.compile(rb"<(?:[\w.-]+:)?(worksheet|sst)\b[^>]*>")
_ENDS = {False: re.compile(rb"</(?:[\w.-]+:)?row\s*>"), True: re.compile(rb"</(?:[\w.-]+:)?si\s*>")}
_BEGINS = {False: re.compile(rb"<(?:[\w.-]+:)?row(?=[\s/>])"), True: re.compile(rb"<(?:[\w.-]+:)?si(?=[\s/>])")}


def column_number(reference: str) -> int:
    """1 for A, 27 for AA."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n


def _fragments(stream: Iterator[bytes], strings: bool) -> Iterator[tuple[int, bytes, bytes]]:
    """(rows or strings before it, the root's start tag, XML of whole ones) of a part as it is read."""
    held, root, first, asked = b"", None, 0, FRAGMENT
    for data in stream:
        held += data
        if root is None:
            if m := _ROOT.search(held):
                root, held = m[0], held[m.end() :]
            continue
        if len(held) >= asked:
            end = max((m.end() for m in _ENDS[strings].finditer(held)), default=0)
            if end:
                yield first, root, held[:end]
                first, held = first + len(_BEGINS[strings].findall(held, 0, end)), held[end:]
            asked = max(FRAGMENT, 2 * len(held))
    if root is None:
        raise ValueError("no sheet in it")
    begin, end = _BEGINS[strings].search(held), max((m.end() for m in _ENDS[strings].finditer(held)), default=0)
    if begin:  # what follows the last end may be rows that are empty elements
        last = re.search(rb"</(?:[\w.-]+:)?(?:sheetData|sst)\s*>", held[end:])
        yield first, root, held[: end + last.start()] if last else held


def _elements(root: bytes, xml: bytes, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a fragment under the root that it was cut from, whose names it needs."""
    if root.endswith(b"/>"):
        return
    name = re.match(rb"<([\w.:-]+)", root)[1]
    body = re.sub(rb"^.*?<(?:[\w.-]+:)?sheetData\b[^>]*>", b"", xml, count=1, flags=re.DOTALL) if b"sheetData" in xml else xml
    for e in ElementTree.fromstring(root + body + b"</" + name + b">"):
        if e.tag.rpartition("}")[2] == tag:
            yield e


def _text(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if t.tag.rpartition("}")[2] == "t")


def _cells(first: int, root: bytes, xml: bytes) -> Iterator[tuple]:
    """(row, column, text, is_number, shared); rows are counted as they stand, so blank ones vanish."""
    for row, e in enumerate(_elements(root, xml, "row"), first + 1):
        col = 0
        for c in e:
            if c.tag.rpartition("}")[2] != "c":
                continue
            col = column_number(c.get("r")) if c.get("r") else col + 1
            kind, value = c.get("t"), next((v.text for v in c if v.tag.rpartition("}")[2] == "v"), None)
            if kind == "inlineStr":
                yield row, col, _text(c), False, None
            elif value is not None and kind == "s":
                yield row, col, None, False, int(value)
            elif value is not None:
                yield row, col, value, kind != "str", None


def _piece(file, strings, first, root, xml, error=None):
    return ranges.of(_PIECE, [file], [strings], [first], [root], [xml], [error])


def _failed(file: str, e: Exception) -> pa.RecordBatch:
    return _piece(file, False, None, None, None, str(e) or type(e).__name__)


def _chunks(f) -> Iterator[bytes]:
    while data := f.read(ranges.RUN):
        yield data


def _pieces(spark: SparkSession, path: str, part: str) -> DataFrame:
    """Fragments of a sheet and of the shared strings of every workbook at a path."""

    def whole(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        for name in [part] + [SHARED] * (SHARED in z.namelist()):
                            with z.open(name) as f:
                                for fragment in _fragments(_chunks(f), name == SHARED):
                                    yield _piece(file, name == SHARED, *fragment)
                except Exception as e:  # noqa: BLE001  a broken workbook must not stop the run
                    yield _failed(file, e)

    def ranged(batches):
        for m, data in ranges.members_of(batches):
            try:
                for fragment in _fragments(ranges.inflated(data, m["method"], m["flags"], m["crc"], m["packed"]), m["name"] == SHARED):
                    yield _piece(m["file"], m["name"] == SHARED, *fragment)
            except Exception as e:  # noqa: BLE001
                yield _failed(m["file"], e)

    files = spark.read.format("binaryFile").load(path)
    large = [r["path"] for r in files.where(F.col("length") > archive.WHOLE).select("path").collect()]  # names of large files
    found = files.where(F.col("length") <= archive.WHOLE).select("path", "content").mapInArrow(whole, _PIECES)
    if large:
        runs = ranges.runs(spark, large)
        directory = ranges.directories(runs)
        wanted = ranges.members(runs, directory).where(F.col("name").isin(part, SHARED))
        found = found.unionByName(ranges.slices(runs, wanted).mapInArrow(ranged, _PIECES))
        nothing = {"strings": F.lit(False), "first": F.lit(None).cast("long"), "root": F.lit(None).cast("binary"), "xml": F.lit(None).cast("binary")}
        without = directory.join(wanted.where(F.col("name") == part).select("file"), "file", "left_anti")
        found = found.unionByName(without.withColumns(nothing).select("file", *nothing, F.coalesce("error", F.lit(f"There is no item named '{part}' in the archive")).alias("error")))
    return found


def sheet_cells(spark: SparkSession, path: str, part: str = "xl/worksheets/sheet1.xml") -> DataFrame:
    """(file, row_no, col_no, value, is_number, error) of one sheet of every workbook at a path. A
    workbook that can't be read gives a row with its error besides what was read of it."""
    pieces = cut(_pieces(spark, path, part))

    def batched(schema, rows):
        rows = list(rows)
        for at in range(0, len(rows), HELD):
            yield ranges.of(schema, *zip(*rows[at : at + HELD]))

    def parse(batches):
        for b in batches:
            for file, first, root, xml, error in zip(*(b.column(c).to_pylist() for c in ("file", "first", "root", "xml", "error"))):
                failed = (file, None, None, None, None, None)
                if error is not None:
                    yield ranges.of(_CELL, *([x] for x in (*failed, error)))
                    continue
                try:
                    yield from batched(_CELL, ((file, *c, None) for c in _cells(first, root, xml)))
                except Exception as e:  # noqa: BLE001
                    yield ranges.of(_CELL, *([x] for x in (*failed, str(e) or type(e).__name__)))

    def strings(batches):
        for b in batches:
            for file, first, root, xml in zip(*(b.column(c).to_pylist() for c in ("file", "first", "root", "xml"))):
                yield from batched(_STRING, ((file, n, _text(e)) for n, e in enumerate(_elements(root, xml, "si"), first)))

    spread = lambda where: pieces.where(where).repartition("file", "first")
    cells = cut(spread("not strings").mapInArrow(parse, "file string, row_no int, col_no int, value string, is_number boolean, shared long, error string"))
    table = cut(spread("strings").mapInArrow(strings, "file string, shared long, text string"))  # its size decides how it is joined
    plain = cells.where("shared is null").drop("shared")
    named = cells.where("shared is not null").join(table, ["file", "shared"], "left").withColumns({"value": F.col("text"), "error": F.when(F.col("text").isNull(), F.lit("a shared string is missing"))})
    return plain.unionByName(named.drop("shared", "text"))


def sheet_table(cells: DataFrame, names: list[str]) -> DataFrame:
    """A sheet's rows below its first one as columns with these names, besides _file and _row."""
    picked = [F.max(F.when(F.col("col_no") == n + 1, F.col("value"))).alias(f"_{n}") for n in range(len(names))]
    rows = cells.where("row_no > 1 and error is null").select(F.col("file").alias("_file"), F.col("row_no").alias("_row"), "col_no", "value")
    return rows.groupBy("_file", "_row").agg(*picked).select("_file", "_row", *[F.col(f"_{n}").alias(name) for n, name in enumerate(names)])
