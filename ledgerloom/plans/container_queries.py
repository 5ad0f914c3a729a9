"""Queries over containers: archives to a ledger, workbooks, fixtures and drawn paths.

The archives hold a voucher for every 40 customers, as lines of JSON in place of PDF: what a PDF reader
would give. Every eighth voucher is in two archives; each archive has a broken document and a note, and
one archive is broken. Tasks make the archives, and Spark's text sink writes them.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import config as C
from ..sinks import workbook
from ..sources import archive, pdf, sheets
from . import ledger, report
from .catalogue import query, table
from .cuts import shared_dir
from .ledger_queries import COLUMNS, GROUPS, TITLE


def _digit(body: str) -> str:
    rest = 11 - sum(int(c) * (i % 6 + 2) for i, c in enumerate(reversed(body))) % 11
    return "0" if rest == 11 else "K" if rest == 10 else str(rest)


def _printed(n: int) -> str:
    return f"{n:,}".replace(",", ".")


def _voucher(number: int, people: list[int]) -> bytes:
    items: list[tuple] = [("cell", 1, n, 20, 300, 20 + 8 * n, t) for n, t in enumerate(("COMPROBANTE DE PAGO DE COTIZACIONES PREVISIONALES", f"Número de Folio: V{number:06d}", "AFP PlanVital", "Período de Remuneraciones: 07/2026", "FONDO DE PENSIONES"))]
    base = {n: 1000 * (n + 1) for n in people}
    for k, (label, amount) in enumerate((("Renta Imponible", sum(base.values())), ("Cotización Obligatoria", sum(base.values()) // 10), ("NUMERO AFILIADOS INFORMADOS", len(people)))):
        items += [("cell", 1, 20 + 2 * k, 20, 200, 80 + 8 * k, label), ("cell", 1, 21 + 2 * k, 300, 360, 80 + 8 * k, _printed(amount))]
    items += [("cell", 2, 0, 20, 400, 40, TITLE)] + [("cell", 2, 1 + n, (a + b) / 2 - 20, (a + b) / 2 + 20, 98, t) for n, (t, a, b) in enumerate(GROUPS)] + [("cell", 2, 10 + n, at - 12, at + 12, 110, t) for n, (t, _, _, at) in enumerate(COLUMNS)]
    for row, n in enumerate(people):
        body = 1_000_000 + n
        texts = (f"{_printed(body)}-{_digit(str(body))}", f"CLIENTE V{number:06d} N{n:09d}", _printed(base[n]), _printed(base[n] // 10))
        items += [("cell", 2, 100 + 4 * row + k, at - 10, at + 10, 130 + 8 * row, t) for k, (t, (*_, at)) in enumerate(zip(texts, COLUMNS))]
    items += [("box", 2, a, b, 90, 100) for _, a, b in GROUPS] + [("box", 2, a, b, y0, y1) for _, a, b, _ in COLUMNS for y0, y1 in ((100, 122), (122, 500))]
    return "\n".join(map(json.dumps, items)).encode()


def _reader(data: bytes) -> Iterator[tuple]:
    yield from (tuple(json.loads(line)) for line in data.decode().splitlines())


#: Customers of a voucher and vouchers of an archive.
PEOPLE, VOUCHERS = 40, 8


def _archives(spark: SparkSession, sf: str) -> str:
    """Writes the archives and returns a pattern that finds them."""

    def zipped(batches):
        for b in batches:
            for name, vouchers in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    for v in vouchers:
                        z.writestr(f"docs/v{v['v']:06d}.pdf", _voucher(v["v"], v["people"]))
                    z.writestr("__MACOSX/docs/v0.pdf", b"")
                    z.writestr(f"roto-{name}.PDF", b"not a page")
                    z.writestr(f"nota-{name}.txt", b"read me")
                yield pa.RecordBatch.from_arrays([pa.array([buffer.getvalue()], pa.binary()), pa.array([name], pa.string())], names=["data", "archive"])

    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    made = table(spark, sf, "customer").groupBy(F.expr(f"c_custkey div {PEOPLE}").alias("v")).agg(F.sort_array(F.collect_list("c_custkey")).alias("people"))
    at = F.expr(f"v div {VOUCHERS}")
    places = F.explode(F.when(F.col("v") % VOUCHERS == 0, F.array(at, at + 1)).otherwise(F.array(at))).alias("a")
    grouped = made.select(places, "v", "people").groupBy(F.lpad(F.col("a").cast("string"), 6, "0").alias("archive")).agg(F.sort_array(F.collect_list(F.struct("v", "people"))).alias("vouchers"))
    archives = grouped.mapInArrow(zipped, "data binary, archive string")
    broken = spark.range(1).select(F.lit(b"PK, but no archive").alias("data"), F.lit("broken").alias("archive"))
    archives.unionByName(broken).select(F.col("data").cast("string").alias("data"), "archive").write.partitionBy("archive").text(folder)
    return f"{folder}/*/part-*"


_MADE = f"""vouchers AS (SELECT DISTINCT c_custkey // {PEOPLE} AS v FROM customer),
inside AS (SELECT v, v // {VOUCHERS} AS a FROM vouchers UNION ALL SELECT v, v // {VOUCHERS} + 1 FROM vouchers WHERE v % {VOUCHERS} = 0),
listed AS (SELECT lpad(CAST(a AS VARCHAR), 6, '0') AS archive, 'v' || lpad(CAST(v AS VARCHAR), 6, '0') || '.pdf' AS file FROM inside
  UNION ALL SELECT DISTINCT lpad(CAST(a AS VARCHAR), 6, '0'), 'roto-' || lpad(CAST(a AS VARCHAR), 6, '0') || '.PDF' FROM inside UNION ALL SELECT 'broken', 'broken')"""


def _archive(column):
    return F.regexp_extract(column, "archive=([^/]*)", 1)


@query(f"""WITH {_MADE} SELECT archive, file, true AS is_document, CAST(row_number() OVER (ORDER BY file, archive) - 1 AS INTEGER) AS ord FROM listed
  UNION ALL SELECT archive, 'nota-' || archive || '.txt', false, CAST(row_number() OVER (ORDER BY archive) AS INTEGER) FROM (SELECT DISTINCT archive FROM listed WHERE archive <> 'broken')""")
def archive_entries(spark, sf):
    """Documents of all archives in one sequence by name, and what isn't one."""
    found = archive.entries(spark, _archives(spark, sf), data=False)
    at = _archive("doc_id")
    names = archive.files(found).select(at.alias("archive"), F.when(at == "broken", "broken").otherwise(F.col("file")).alias("file"), F.lit(True).alias("is_document"), F.col("doc_ord").cast("int").alias("ord"))
    others = archive.ignored(found).select(F.regexp_extract("file", "[0-9]+", 0).alias("archive"), "file", F.lit(False).alias("is_document"), F.col("file_ord").cast("int").alias("ord"))
    return names.unionByName(others)


def _result(spark: SparkSession, sf: str) -> ledger.Ledger:
    return ledger.from_archives(spark, _archives(spark, sf), _reader)


_PEOPLE = f"SELECT row_number() OVER (ORDER BY c_custkey) AS line, CAST(1000000 + c_custkey AS VARCHAR) AS body, 'V' || lpad(CAST(c_custkey // {PEOPLE} AS VARCHAR), 6, '0') AS maternal, 1000.0 * (c_custkey + 1) AS base, 100.0 * (c_custkey + 1) AS paid FROM customer"


@query(f"SELECT line, body, maternal, CAST(base AS DOUBLE) AS base, CAST(paid AS DOUBLE) AS paid FROM ({_PEOPLE})")
def archive_ledger(spark, sf):
    """From archives to the ledger in one call; the voucher that is in both archives counts once."""
    c = lambda h: F.col(C.column(h).name)
    return _result(spark, sf).ledger.select(c("Linea").cast("long").alias("line"), c("rut").alias("body"), c("ape_mat").alias("maternal"), c("impo_afp").cast("double").alias("base"), c("cot_obli_afp").cast("double").alias("paid"))


@query(f"""WITH {_MADE}, counted AS (SELECT 'v' || lpad(CAST(c_custkey // {PEOPLE} AS VARCHAR), 6, '0') || '.pdf' AS file, count(*) AS n FROM customer GROUP BY 1),
ranked AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY archive) AS k FROM listed)
SELECT r.file, CASE WHEN k > 1 THEN r.file END AS duplicate_of, CASE WHEN k = 1 THEN CASE WHEN n IS NULL THEN 'no cuadra' ELSE 'verificado' END END AS state, n IS NULL AS broken, coalesce(n, 0) AS records
FROM ranked r LEFT JOIN counted c ON c.file = r.file""")
def archive_documents(spark, sf):
    name = F.when(_archive("doc_id") == "broken", "broken").otherwise(F.col("file")).alias("file")
    return _result(spark, sf).documents.select(name, "duplicate_of", "state", F.col("error").isNotNull().alias("broken"), F.col("n_records").alias("records"))


def _workbook(spark: SparkSession, sf: str) -> str:
    return workbook.store_workbook(_result(spark, sf), f"{shared_dir(spark)}/book-{uuid.uuid4().hex}")


@query(f"SELECT CAST(line AS VARCHAR) AS line, body, maternal, CAST(CAST(base AS BIGINT) AS VARCHAR) AS base FROM ({_PEOPLE})")
def workbook_ledger(spark, sf):
    """The ledger's sheet, written and read back."""
    cells = sheets.sheet_cells(spark, _workbook(spark, sf))
    return sheets.sheet_table(cells, [c.name for c in C.LAYOUT]).select(*[F.col(C.column(h).name).alias(name) for h, name in (("Linea", "line"), ("rut", "body"), ("ape_mat", "maternal"), ("impo_afp", "base"))])


@query(f"""SELECT 'v' || lpad(CAST(v AS VARCHAR), 6, '0') || '.pdf' AS file, label, CAST(CASE label WHEN 'Renta Imponible' THEN b WHEN 'Cotización Obligatoria' THEN b // 10 ELSE n END AS VARCHAR) AS declared, '✔' AS ok FROM
  (SELECT c_custkey // {PEOPLE} AS v, CAST(sum(1000 * (c_custkey + 1)) AS BIGINT) AS b, count(*) AS n FROM customer GROUP BY 1), (VALUES ('Renta Imponible'), ('Cotización Obligatoria'), ('NUMERO AFILIADOS INFORMADOS')) AS l(label)""")
def workbook_control(spark, sf):
    """The control table below the summary, written and read back."""
    cells = sheets.sheet_cells(spark, _workbook(spark, sf), "xl/worksheets/sheet2.xml")
    rows = sheets.sheet_table(cells, ["file", "label", "declared", "extracted", "difference", "ok"])
    return rows.where("ok in ('✔', '✘') and declared = extracted").select("file", "label", "declared", "ok")


@query(f"""WITH {_MADE}, counted AS (SELECT 'v' || lpad(CAST(c_custkey // {PEOPLE} AS VARCHAR), 6, '0') || '.pdf' AS file, count(*) AS n, CAST(sum(1000 * (c_custkey + 1)) AS BIGINT) AS b FROM customer GROUP BY 1),
heads AS (SELECT * FROM (VALUES (0, 'Identificación del Trabajador > RUT', 'identificacion del trabajador rut', 'rut'), (1, 'Identificación del Trabajador > Apellido Paterno Materno Nombres', 'identificacion del trabajador apellido paterno materno nombres', 'nombre'),
  (2, 'Fondo de Pensiones > Remuneración Imponible', 'fondo de pensiones remuneracion imponible', 'impAfp'), (3, 'Fondo de Pensiones > Cotización Obligatoria', 'fondo de pensiones cotizacion obligatoria', 'cotObliAfp')) AS t(i, label, key, field))
SELECT file, 'afp-cotizaciones' AS section, '2' AS pages, CAST(i AS VARCHAR) AS i, label, key, 'ancestro' AS level, field, CAST(n AS VARCHAR) AS with_value, CAST(CASE i WHEN 2 THEN b WHEN 3 THEN b // 10 ELSE 0 END AS VARCHAR) AS total
FROM listed JOIN counted USING (file), heads""")
def workbook_columns(spark, sf):
    """The audit of every column read, written and read back."""
    cells = sheets.sheet_cells(spark, _workbook(spark, sf), "xl/worksheets/sheet3.xml")
    return sheets.sheet_table(cells, ["file", "section", "pages", "i", "label", "key", "level", "field", "with_value", "total"]).drop("_file", "_row")


@query(f"""WITH {_MADE}, bad AS (SELECT file FROM listed WHERE file = 'broken' OR file LIKE 'roto%'), twice AS (SELECT file FROM listed GROUP BY file HAVING count(*) > 1)
SELECT 1 AS kind_place, 'Error al leer el PDF' AS kind, file, CAST(NULL AS VARCHAR) AS detail FROM bad
UNION ALL SELECT 2, 'PDF duplicado', file, 'Mismo folio ' || upper(file[1:7]) || ' que "' || file || '". Se procesó una sola vez para no duplicar los montos.' FROM twice
UNION ALL SELECT 3, 'Documento que no cuadra', file, NULL FROM bad
UNION ALL SELECT 4, 'PDF no reconocido', file, 'No se identificó la institución; el archivo no aportó datos.' FROM bad
UNION ALL SELECT 5, 'Columnas constantes en el consolidado', NULL, NULL
UNION ALL SELECT 6, 'Archivo ignorado', 'nota-' || archive || '.txt', 'No es un .pdf' FROM (SELECT DISTINCT archive FROM listed WHERE archive <> 'broken')""")
def workbook_review(spark, sf):
    """What to look at, kind by kind in its order, written and read back. What the readers of broken
    files say, and the names of constant columns, are left out."""
    cells = sheets.sheet_cells(spark, _workbook(spark, sf), "xl/worksheets/sheet4.xml")
    rows = sheets.sheet_table(cells, ["kind", "file", "detail"])
    first = rows.groupBy("kind").agg(F.min("_row").alias("first"))  # a row for each kind
    ranked = first.select("kind", F.dense_rank().over(Window.orderBy("first")).alias("kind_place"))
    file = F.when(F.col("file").startswith("part-"), "broken").otherwise(F.col("file")).alias("file")
    told = F.when(F.col("kind").isin("PDF duplicado", "PDF no reconocido", "Archivo ignorado"), F.col("detail")).alias("detail")
    return rows.join(ranked, "kind").select("kind_place", "kind", file, told)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Error: x' || o_orderkey WHEN o_orderkey % 5 = 0 THEN 'Duplicado de d.pdf' WHEN o_orderkey % 3 = 0 THEN 'Institución no reconocida' WHEN o_orderstatus = 'F' THEN 'NO CUADRA' WHEN o_orderstatus = 'O' THEN 'Verificado (' || o_custkey || ' totales)' ELSE 'SIN VERIFICAR' END AS state FROM orders""")
def shown_states(spark, sf):
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "no cuadra").when(F.col("o_orderstatus") == "O", "verificado").otherwise("sin verificar")
    docs = table(spark, sf, "orders").select(k, F.when(k % 7 == 0, F.concat(F.lit("x"), k.cast("string"))).alias("error"), F.when(k % 5 == 0, "d.pdf").alias("duplicate_of"), F.when(k % 3 != 0, "afp").alias("profile"), state.alias("state"), F.col("o_custkey").alias("n_compared"))
    return docs.select("o_orderkey", workbook.shown_state().alias("state"))


@query("""SELECT 'customers.' || c_mktsegment || '.' || c_nationkey AS path, CAST(count(*) AS VARCHAR) AS value, CASE WHEN c_nationkey = 3 THEN 'changed' WHEN c_nationkey = 5 THEN 'new' WHEN c_nationkey = 7 THEN 'absent' END AS kind FROM customer GROUP BY c_mktsegment, c_nationkey""")
def fixture_round_trip(spark, sf):
    """A fixture written, read and compared with a run that differs in three nations."""
    counts = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").cast("string").alias("value"))
    rows = counts.select(F.concat_ws(".", F.lit("customers"), "c_mktsegment", "c_nationkey").alias("path"), "value", "c_nationkey")
    path = f"{shared_dir(spark)}/fixture-{uuid.uuid4().hex}"
    at = report.save_fixture(rows.where("c_nationkey <> 5").select("path", "value"), path)
    actual = rows.where("c_nationkey <> 7").select("path", F.when(F.col("c_nationkey") == 3, "other").otherwise(F.col("value")).alias("value"))
    kinds = report.compare_fixtures(report.load_fixture(spark, at), actual).select("path", "kind")
    return rows.select("path", "value").join(kinds, "path", "left")


@query("""WITH p AS (SELECT page_id, k, CAST(page_id % 9 AS DOUBLE) AS a FROM pages, (SELECT unnest([0, 1, 2]) AS k)),
b AS (SELECT page_id, k, CASE k WHEN 0 THEN 10 + a ELSE 10 END AS x0, CASE k WHEN 0 THEN 30 + a ELSE 30 END AS x1, CASE k WHEN 2 THEN 5 ELSE 5 + 2 * a END AS y0, CASE k WHEN 2 THEN 9 ELSE 9 + 2 * a END AS y1 FROM p)
SELECT page_id, CAST(CASE k WHEN 1 THEN 2 * x0 ELSE x0 END AS DOUBLE) AS x0, CAST(CASE k WHEN 1 THEN 2 * x1 ELSE x1 END AS DOUBLE) AS x1, CAST(800 - CASE k WHEN 1 THEN 9 ELSE y1 END AS DOUBLE) AS y0, CAST(800 - CASE k WHEN 1 THEN 5 ELSE y0 END AS DOUBLE) AS y1 FROM b""")
def replayed_boxes(spark, sf):
    """Paths under saved, shifted, scaled and restored maps, on pages that are 800 points high."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), (F.col("page_id") % 9).cast("double").alias("a"))
    box, number = F.array(*map(F.lit, (10.0, 5.0, 30.0, 9.0))), lambda *v: F.array(*[x if not isinstance(x, float) else F.lit(x) for x in v])
    a = F.col("a")
    drawn = [
        ("save", None), ("transform", number(1.0, 0.0, 0.0, 1.0, a, 0.0)), ("transform", number(1.0, 0.0, 0.0, 1.0, 0.0, 2 * a)), ("path", box), ("restore", None), ("restore", None),
        ("save", None), ("transform", number(2.0, 0.0, 0.0, 1.0, 0.0, 0.0)), ("path", box), ("fill", None), ("restore", None), ("path", box), ("path", number(1.0)),
    ]
    ops = F.array(*[F.struct(F.lit(n).alias("seq"), F.lit(op).alias("op"), (args if args is not None else F.array()).cast("array<double>").alias("args")) for n, (op, args) in enumerate(drawn)])
    views = pages.select("doc_id", "page", number(1.0, 0.0, 0.0, -1.0, 0.0, 800.0).alias("view"))
    return pdf.replayed(pages.select("doc_id", "page", F.inline(ops)), views).select(F.col("doc_id").alias("page_id"), "x0", "x1", "y0", "y1")
