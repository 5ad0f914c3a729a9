import io
import os
import random
import re
import zipfile
import zlib
from types import SimpleNamespace
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import config as C
from ledgerloom.plans import ledger
from ledgerloom.sinks import ooxml, workbook
from ledgerloom.sources import archive, pdf, ranges, sheets

from . import vouchers


def zipped(names):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in names:
            z.writestr(name, f"data of {name}")
    return buffer.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "in.zip").write_bytes(zipped(["b/Ñandu.PDF", "a/zeta.pdf", "nota.txt", "__MACOSX/x.pdf", "a/._zeta.pdf", "a/.DS_Store", "dir/", "Oso.pdf", "c/avión.pdf"]))
    found = archive.entries(spark, str(tmp_path / "*.zip"))
    assert [r["file"] for r in archive.files(found).orderBy("doc_ord").collect()] == ["avión.pdf", "Ñandu.PDF", "Oso.pdf", "zeta.pdf"]
    docs = {r["doc_id"].split("!")[1]: bytes(r["data"]) for r in archive.documents(found).collect()}
    assert docs["Oso.pdf"] == b"data of Oso.pdf" and len(docs) == 4
    assert [r["file"] for r in archive.ignored(found).collect()] == ["nota.txt"]
    names = archive.entries(spark, str(tmp_path / "*.zip"), data=False)
    assert names.where("data is not null").count() == 0 and names.count() == 5


def test_broken_containers_are_rows(spark, tmp_path):
    whole = zipped(["x.pdf", "y.pdf"])
    (tmp_path / "a.zip").write_bytes(whole)
    (tmp_path / "b.zip").write_bytes(whole.replace(b"data of y.pdf", b"data of Y.pdf"))  # its checksum is wrong
    (tmp_path / "c.zip").write_bytes(b"no archive")
    found = archive.entries(spark, str(tmp_path / "*.zip"))
    got = {(r["archive"].split("/")[-1], r["path"]): r["error"] for r in found.collect()}
    assert {k for k, e in got.items() if e} == {("b.zip", "y.pdf"), ("c.zip", None)} and len(got) == 5
    files = archive.files(found).orderBy("doc_ord").collect()
    assert [(r["doc_ord"], r["file"], r["error"] is None) for r in files] == [(0, "c.zip", False), (1, "x.pdf", True), (2, "x.pdf", True), (3, "y.pdf", True), (4, "y.pdf", False)]
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    assert [r["error"] is None for r in sheets.sheet_cells(spark, str(tmp_path / "bad.xlsx")).collect()] == [False]


def test_archives_by_byte_ranges(spark, tmp_path, monkeypatch):
    """Archives in runs of a few bytes, read by many tasks, give what whole ones do."""
    rnd = random.Random(4)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in range(40):
            data = rnd.randbytes(rnd.randrange(5000)) if n % 3 else b"\n" * rnd.randrange(900) + b"text " * rnd.randrange(900)
            z.writestr(zipfile.ZipInfo(f"d/ñ{n}.pdf" if n % 5 else f"d/n{n}.txt"), data, zipfile.ZIP_DEFLATED if n % 2 else zipfile.ZIP_STORED)
        z.writestr("twice.pdf", b"one")
        z.writestr("twice.pdf", b"two")
        z.comment = b"a comment\n" * 30
    whole = zipped(["x.pdf", "y.pdf", "dir/"])
    (tmp_path / "b.zip").write_bytes(b"some\nbytes before" + whole.replace(b"data of y.pdf", b"data of Y.pdf"))
    (tmp_path / "c.zip").write_bytes(b"no\narchive")
    (tmp_path / "d.zip").write_bytes(zipped([]))
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z, z.open(zipfile.ZipInfo("big.pdf"), "w", force_zip64=True) as f:
        f.write(b"sizes in 64 bits")
    with zipfile.ZipFile(tmp_path / "f.zip", "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("b.pdf", b"another method")
    rows = lambda: sorted(((r["archive"].split("/")[-1], r["no"] if r["no"] is not None else -1, r["path"], r["data"] and bytes(r["data"]), bool(r["error"])) for r in archive.entries(spark, str(tmp_path / "*.zip")).collect()), key=str)
    want = [r if r[0] != "f.zip" else (*r[:3], None, True) for r in rows()]
    monkeypatch.setattr(archive, "WHOLE", 0)
    monkeypatch.setattr(ranges, "RUN", 700)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert rows() == want and len({r[1] for r in want if r[2] == "twice.pdf"}) == 2
        found = ranges.runs(spark, [str(tmp_path / "a.zip")])
        assert b"".join(bytes(r["data"]) for r in found.orderBy("at").collect())[: os.path.getsize(tmp_path / "a.zip")] == (tmp_path / "a.zip").read_bytes()
        assert archive.entries(spark, str(tmp_path / "a.zip"), data=False).where("data is not null").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_copies_in_two_archives_count_once(spark):
    """Two vouchers that are both first in their archives, by doc_id alone."""
    pages = vouchers.sample()[0][2]
    files, cells, boxes = vouchers.build(spark, [("a!x.pdf", "x.pdf", pages, None), ("b!x.pdf", "x.pdf", pages, None)])
    result = ledger.process(files.withColumn("doc_ord", F.lit(0)), cells, boxes)
    assert sorted(r["duplicate_of"] or "" for r in result.documents.collect()) == ["", "x.pdf"]
    assert {int(r[C.column("impo_afp").name]) for r in result.ledger.collect()} == {1000010, 500000}
    made = list(result._made)
    result.release()
    assert made and not any(os.path.exists(p.removeprefix("file:")) for p in made)


def test_workbook_reads_back(spark, tmp_path):
    result = ledger.process(*vouchers.build(spark, vouchers.sample()))
    path = tmp_path / "out.xlsx"
    workbook.write_workbook(result, path)
    assert workbook.file_name(result) == "consolidado-072026.xlsx"
    cells = {(r["row_no"], r["col_no"]): r["value"] for r in sheets.sheet_cells(spark, str(path)).collect()}
    assert [cells.get((1, c.at + 1), "") for c in C.LAYOUT] == [c.header for c in C.LAYOUT]
    at = C.column("impo_afp").at + 1
    assert cells[(4, at)] == "1000010" and cells[(2, C.column("rut").at + 1)] == "12786960" and (5, 1) not in cells
    table = sheets.sheet_table(sheets.sheet_cells(spark, str(path), "xl/worksheets/sheet4.xml"), ["kind", "where", "detail"]).orderBy("_row").collect()
    want = [tuple(r) for r in workbook.review(result).collect()]
    assert [(r["kind"], r["where"] or "", r["detail"]) for r in table] == want
    second = [r for r in sheets.sheet_cells(spark, str(path), "xl/worksheets/sheet2.xml").collect()]
    states = {r["value"] for r in second if r["col_no"] == 8}
    assert {"Verificado (7 totales)", "Duplicado de afp.pdf", "NO CUADRA", "Error: no es un PDF", "Institución no reconocida"} <= states
    third = sheets.sheet_cells(spark, str(path), "xl/worksheets/sheet3.xml").collect()
    assert any(r["value"] == "(SIN MAPEAR)" for r in third)
    assert workbook.metadata(result).count() == 5


def _bare(spark, n):
    """A result of n lines and nothing else, with texts that XML can't hold."""
    spoilt = "a\x0cb<&>\x00\ufffe é\t"
    value = lambda c: F.col("id").cast("decimal(20,6)") / 4 if c.kind == "N" else F.lit(spoilt) if c.header == "ape_pat" else F.concat(F.lit("x"), "id")
    lines = spark.range(1, n + 1).select(*[(F.col("id").cast("decimal(20,6)") if c.header == "Linea" else value(c)).alias(c.name) for c in C.LAYOUT])
    kinds = {
        "documents": "doc_ord long, file string, institution string, folio string, period struct<text:string>, employer struct<name:string>, pages int, n_records long, error string, duplicate_of string, profile string, state string, n_compared long, reasons array<string>",
        "control": "doc_ord long, pair_ord int, file string, label string, amount decimal(20,6), extracted decimal(20,6), ok boolean",
        "columns": "doc_ord long, file string, section string, i int, label string, key string, level string, field string, first_page int, last_page int, with_value long, total decimal(20,6)",
        "warnings": "prio int, ord array<bigint>, kind string, file string, detail string",
    }
    return SimpleNamespace(ledger=lines, **{name: spark.createDataFrame([], kind) for name, kind in kinds.items()})


@pytest.mark.parametrize("n, most", [(0, 1 << 20), (25, 1 << 20), (25, 11), (20, 11)])
def test_long_ledgers_go_on_in_further_sheets(spark, tmp_path, monkeypatch, n, most):
    monkeypatch.setattr(workbook, "ROWS_IN_A_SHEET", most)
    monkeypatch.setattr(ooxml, "PART", 4)
    monkeypatch.setattr(workbook, "AT_ONCE", 32 << 20 if n == 25 else 0)
    path = tmp_path / "out.xlsx"
    workbook.write_workbook(_bare(spark, n), path)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        names = re.findall(r'sheet name="([^"]*)"', z.read("xl/workbook.xml").decode())
        parts = [x for x in z.namelist() if "worksheets" in x]
        for part in parts:
            ElementTree.fromstring(z.read(part))
    more = max(0, -(-n // (most - 1)) - 1)
    assert names == [workbook.LEDGER, *(f"{workbook.LEDGER} ({k + 2})" for k in range(more)), workbook.SUMMARY, workbook.COLUMNS, workbook.REVIEW] and len(parts) == 4 + more
    read = []
    for part in (1, *range(5, 5 + more)):
        cells = sheets.sheet_cells(spark, str(path), f"xl/worksheets/sheet{part}.xml")
        table = sheets.sheet_table(cells, [c.name for c in C.LAYOUT]).orderBy("_row")
        read += [(r["_row"], r[C.column("Linea").name], r[C.column("ape_pat").name]) for r in table.collect()]
    assert read == [((k - 1) % (most - 1) + 2, str(k), "a\ufffdb<&>\ufffd\ufffd é\t") for k in range(1, n + 1)]


def test_check_sums_are_joined():
    rnd = random.Random(1)
    for _ in range(50):
        a, b = rnd.randbytes(rnd.randrange(300)), rnd.randbytes(rnd.randrange(300))
        assert ooxml.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_shared_strings_and_blank_rows(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>a &amp; b</t></si><si><r><t>x</t></r><r><t>y</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"/><c r="AA1" t="s"><v>1</v></c></row><row r="9"><c r="A9"><v>5</v></c></row></sheetData></worksheet>')
    got = sorted(tuple(r)[1:5] for r in sheets.sheet_cells(spark, str(tmp_path / "s.xlsx")).collect())
    assert got == [(1, 1, "a & b", False), (1, 27, "xy", False), (2, 1, "5", True)]


def test_headings_of_any_name(spark):
    cells = spark.createDataFrame([("f", r, c, f"{r}{c}", False, None) for r in (1, 2, 3) for c in (1, 2, 3)], "file string, row_no int, col_no int, value string, is_number boolean, error string")
    got = sheets.sheet_table(cells, ["file", "row_no", "value"]).orderBy("_row").collect()
    assert [tuple(r) for r in got] == [("f", 2, "21", "22", "23"), ("f", 3, "31", "32", "33")]


@pytest.mark.parametrize("way", ["whole", "ranges"])
def test_large_sheets_are_cut_into_fragments(spark, tmp_path, monkeypatch, way):
    ns = 'xmlns:m="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:y="urn:y"'
    texts = [f"t{n} < & é" for n in range(300)]
    rows, want = [], []
    for r in range(1, 1500):
        if r % 7 == 0:
            rows.append(f'<m:row r="{r}" y:a="b"/>' if r % 2 else "<m:row></m:row>")
            continue
        want += [(r, 1, texts[r % 300], False), (r, 28, str(r), True), (r, 29, "in  line", False)]
        rows.append(f'<m:row y:a="b"><m:c r="A{r}" t="s"><m:v>{r % 300}</m:v></m:c><m:c r="AB{r}" s="1"><m:v>{r}</m:v></m:c><m:c t="inlineStr"><m:is><m:t>in  line</m:t></m:is></m:c></m:row>')
    escaped = [t.replace("&", "&amp;").replace("<", "&lt;") for t in texts]
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><m:worksheet {ns}><m:cols/><m:sheetData>{"".join(rows)}</m:sheetData><m:rowBreaks count="1"/></m:worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<m:sst {ns}>{"".join(f"<m:si><m:t>{t}</m:t></m:si>" for t in escaped)}</m:sst>')
    (tmp_path / "t.xlsx").write_bytes(zipped(["other"]))
    monkeypatch.setattr(sheets, "FRAGMENT", 2000)
    monkeypatch.setattr(ranges, "RUN", 1500)
    if way == "ranges":
        monkeypatch.setattr(archive, "WHOLE", 0)
    cells = sheets.sheet_cells(spark, str(tmp_path / "*.xlsx"))
    assert sorted(tuple(r)[1:5] for r in cells.where("error is null").collect()) == sorted(want)
    assert [r["file"].split("/")[-1] for r in cells.where("error is not null").collect()] == ["t.xlsx"]


def test_pdf_plug(spark):
    docs = spark.createDataFrame([("d", b"ok"), ("e", b"bad")], "doc_id string, data binary")
    with pytest.raises(RuntimeError, match="reader"):
        pdf.drawn(docs, None)

    def reader(data):
        if data == b"bad":
            raise ValueError("no xref")
        yield "cell", 1, 0, 1.0, 3.0, 5.0, "hello"
        yield "box", 1, 0.0, 9.0, 0.0, 9.0

    items = pdf.drawn(docs, reader)
    assert [tuple(r) for r in pdf.cells(items).collect()] == [("d", 1, 0, 1.0, 3.0, 2.0, 5.0, "hello")]
    assert pdf.boxes(items).count() == 1 and [tuple(r) for r in pdf.errors(items).collect()] == [("e", "no xref")]
    assert pdf.transformed(0, 1, -1, 0, 10, 0)(2, 3) == (7, 2)


def test_stored_workbook_does_not_pass_the_driver(spark, tmp_path, monkeypatch):
    """Tasks store the same workbook that the driver writes; of its parts only the sums are collected."""
    result = _bare(spark, 1_025)
    workbook.write_workbook(result, tmp_path / "own.xlsx")
    monkeypatch.setattr(workbook, "AT_ONCE", None)  # whoever looks at what may come to the driver fails
    workbook.store_workbook(result, f"file://{tmp_path}/stored")
    (stored,) = (tmp_path / "stored").glob("part-*")
    with zipfile.ZipFile(tmp_path / "own.xlsx") as own, zipfile.ZipFile(stored) as other:
        assert other.testzip() is None and other.namelist() == own.namelist()
        assert all(other.read(n) == own.read(n) for n in own.namelist())
    assert stored.read_bytes().endswith(b"\x01\x00\n")
