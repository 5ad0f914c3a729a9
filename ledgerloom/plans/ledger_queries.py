"""Queries over the whole voucher plan.

The orders of each nation's customers are laid out as one voucher: cells at positions on pages
with drawn boxes, a cover that declares totals (one too much in every fifth), a tax id with its
check digit for each customer. Some lines have a cell beyond the table, some two cells in one
column, and some are followed by a line without a tax id. The plan then has to read it all back from
geometry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taxid import check_digit
from ..functions.text import printed
from ..operators import config as C
from ..sinks import workbook
from . import ledger, report
from .catalogue import query, table
from .cuts import cut

# the layout of a page: heading, box, centre of the data below
COLUMNS = (("RUT", 18, 59, 38), ("Apellido Paterno Materno Nombres", 59, 223, 130), ("Remuneración Imponible", 223, 273, 256), ("Cotización Obligatoria", 273, 314, 299))
GROUPS = (("Identificación del Trabajador", 18, 223), ("Fondo de Pensiones", 223, 314))
ROWS = 50  # lines that a page has room for
BOTTOM = 134 + 8 * ROWS
TITLE = "DETALLE DE PAGO DE COTIZACIONES PREVISIONALES Y DEPOSITOS DE AHORRO VOLUNTARIO, FONDO DE PENSIONES"
COVER = ("COMPROBANTE DE PAGO DE COTIZACIONES PREVISIONALES", None, "AFP PlanVital", "Período de Remuneraciones: 07/2026", "FONDO DE PENSIONES")


def _cell(page, y, x0, x1, text, order):
    x0, x1, y = (v if not isinstance(v, (int, float)) else F.lit(float(v)) for v in (x0, x1, y))
    return F.struct(page.cast("int").alias("page"), F.lit(order).alias("item_ord"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), ((x0 + x1) / 2).cast("double").alias("xc"), y.cast("double").alias("y"), text.alias("text"))


def vouchers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, cells, boxes) of one voucher for each nation that has orders."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").cast("long").alias("base"))
    body = 1_000_000 + F.col("c_custkey")
    # what is printed of a customer is worked out once, ahead of the orders
    rut, name = F.concat_ws("-", printed(body), check_digit(body)), F.concat_ws(" ", F.lit("CLIENTE"), F.col("c_mktsegment"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey", rut.alias("_t0"), name.alias("_t1"))
    lines = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    doc = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    page, y = (2 + F.floor(F.col("o_orderkey") / ROWS)).cast("int"), 130 + 8 * (F.col("o_orderkey") % ROWS)
    # texts are columns ahead of the array, where they are compiled
    amounts = {"_t2": printed(F.col("base")), "_t3": printed(F.floor(F.col("base") / 10))}
    named = [f"_t{n}" for n in range(len(COLUMNS))]
    cells = [_cell(page, y, at - 10, at + 10, F.col(t), 100 + n) for n, (t, (*_, at)) in enumerate(zip(named, COLUMNS))]
    every = lambda n, cell: F.when(F.col("o_orderkey") % n == 0, cell)
    cells += [every(97, _cell(page, y, 330, 340, F.lit("7"), 104)), every(89, _cell(page, y, 205, 212, F.lit("X"), 105)), every(83, _cell(page, y + 4, 120, 140, F.lit("SIN RUT"), 106))]
    data = lines.withColumns(amounts).select(doc.alias("doc_id"), F.inline(F.array_compact(F.array(*cells))))

    where = cut(lines.select(doc.alias("doc_id"), page.alias("p")).distinct())  # headings and boxes are drawn on each of these pages
    p = F.col("p")
    heads = [_cell(p, 40, 20, 400, F.lit(TITLE), 0)] + [_cell(p, 98, (a + b) / 2 - 20, (a + b) / 2 + 20, F.lit(t), n + 1) for n, (t, a, b) in enumerate(GROUPS)] + [_cell(p, 110, at - 12, at + 12, F.lit(t), n + 10) for n, (t, _, _, at) in enumerate(COLUMNS)]
    head = where.select("doc_id", F.inline(F.array(*heads)))

    per = lines.groupBy(doc.alias("doc_id"), "c_nationkey").agg(F.sum("base").alias("b"), F.sum(F.floor(F.col("base") / 10)).alias("c"), F.count_distinct("o_custkey").alias("n"))
    declared = [("Renta Imponible", F.col("b") + F.when(F.col("c_nationkey") % 5 == 0, 1).otherwise(0)), ("Cotización Obligatoria", F.col("c")), ("NUMERO AFILIADOS INFORMADOS", F.col("n")), ("Otro concepto", F.lit(7))]
    one = F.lit(1)
    cover = [_cell(one, 20 + 8 * n, 20, 300, F.lit(t) if t else F.concat(F.lit("Número de Folio: "), F.col("doc_id")), n) for n, t in enumerate(COVER)]
    cover += [_cell(one, 80 + 8 * n, a, b, t, 20 + 2 * n + k) for n, (label, amount) in enumerate(declared) for k, (t, a, b) in enumerate(((F.lit(label), 20, 200), (printed(amount), 300, 360)))]
    first = per.select("doc_id", F.inline(F.array(*cover)))

    box = lambda x0, x1, y0, y1: F.struct(p.cast("int").alias("page"), *[F.lit(float(v)).alias(k) for k, v in (("x0", x0), ("x1", x1), ("y0", y0), ("y1", y1))])
    drawn = [box(a, b, 90, 100) for _, a, b in GROUPS] + [box(a, b, 100, 122) for _, a, b, _ in COLUMNS]
    # one band holds the data rows: as tall as the page, it contains the first row with a tax id
    drawn += [box(a, b, 122, BOTTOM) for _, a, b, _ in COLUMNS]
    boxes = where.select("doc_id", F.inline(F.array(*drawn)))

    files = per.select("doc_id", F.col("c_nationkey").cast("int").alias("doc_ord"), F.concat("doc_id", F.lit(".pdf")).alias("file"), F.lit(None).cast("string").alias("error"))
    return files, data.unionByName(head).unionByName(first), boxes


def processed(spark: SparkSession, sf: str) -> ledger.Ledger:
    return ledger.process(*vouchers(spark, sf))


_LINES = "SELECT o_custkey, c_nationkey, c_mktsegment, CAST(floor(o_totalprice) AS BIGINT) AS base, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey"
_ODD = "count(*) FILTER (WHERE o_orderkey % 97 = 0) AS outside, count(*) FILTER (WHERE o_orderkey % 89 = 0) AS colliding, count(*) FILTER (WHERE o_orderkey % 83 = 0) AS dropped"
_DIGIT = "CASE 11 - CAST(list_sum(list_transform(range(1, len(body) + 1), lambda i: CAST(body[len(body) - i + 1] AS INTEGER) * ((i - 1) % 6 + 2))) AS BIGINT) % 11 WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE CAST(11 - CAST(list_sum(list_transform(range(1, len(body) + 1), lambda i: CAST(body[len(body) - i + 1] AS INTEGER) * ((i - 1) % 6 + 2))) AS BIGINT) % 11 AS VARCHAR) END"


@query(f"""WITH p AS (SELECT CAST(1000000 + o_custkey AS VARCHAR) AS body, 'CLIENTE' AS paternal, min(c_mktsegment) AS maternal, lpad(CAST(o_custkey AS VARCHAR), 9, '0') || CASE WHEN bool_or(o_orderkey % 89 = 0) THEN ' X' ELSE '' END AS given, CAST(sum(base) AS DOUBLE) AS base, CAST(sum(base // 10) AS DOUBLE) AS paid FROM ({_LINES}) GROUP BY o_custkey)
SELECT CAST(row_number() OVER (ORDER BY maternal, given) AS BIGINT) AS line, body, {_DIGIT} AS digit, paternal, maternal, given, '72026' AS month, 'AFP' AS regime, CAST(29 AS BIGINT) AS pension, base, paid FROM p""")
def voucher_ledger(spark, sf):
    out = processed(spark, sf).ledger
    c = lambda h: F.col(C.column(h).name)
    return out.select(
        c("Linea").cast("long").alias("line"), c("rut").alias("body"), c("dv").alias("digit"), c("ape_pat").alias("paternal"), c("ape_mat").alias("maternal"), c("nombres").alias("given"),
        c("remu_desde").alias("month"), c("reg_previ").alias("regime"), c("nom_AFP").cast("long").alias("pension"), c("impo_afp").cast("double").alias("base"), c("cot_obli_afp").cast("double").alias("paid"),
    )


@query(f"""WITH s AS (SELECT c_nationkey, CAST(sum(base) AS DOUBLE) AS b, CAST(sum(base // 10) AS DOUBLE) AS c, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS n FROM ({_LINES}) GROUP BY c_nationkey)
SELECT 'n' || c_nationkey || '.pdf' AS file, 'Renta Imponible' AS label, 'impAfp' AS field, b + CASE WHEN c_nationkey % 5 = 0 THEN 1 ELSE 0 END AS declared, b AS extracted, c_nationkey % 5 <> 0 AS ok FROM s
UNION ALL SELECT 'n' || c_nationkey || '.pdf', 'Cotización Obligatoria', 'cotObliAfp', c, c, true FROM s UNION ALL SELECT 'n' || c_nationkey || '.pdf', 'NUMERO AFILIADOS INFORMADOS', '(rut únicos)', n, n, true FROM s""")
def voucher_control(spark, sf):
    return processed(spark, sf).control.select("file", "label", "field", F.col("amount").cast("double").alias("declared"), F.col("extracted").cast("double").alias("extracted"), "ok")


@query(f"""WITH s AS (SELECT c_nationkey, count(*) AS n, {_ODD} FROM ({_LINES}) GROUP BY c_nationkey)
SELECT 'n' || c_nationkey || '.pdf' AS file, 'afp' AS profile, 'AFP PlanVital' AS institution, 'n' || c_nationkey AS folio, CASE WHEN c_nationkey % 5 = 0 THEN 'no cuadra' ELSE 'verificado' END AS state, CAST(CASE WHEN c_nationkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS reasons,
  CAST(n AS BIGINT) AS records, outside, colliding, dropped, CAST(4 AS BIGINT) AS pairs, CAST(1 AS BIGINT) AS uncompared FROM s""")
def voucher_states(spark, sf):
    return processed(spark, sf).documents.select("file", "profile", "institution", "folio", "state", F.size("reasons").alias("reasons"), F.col("n_records").alias("records"), "outside", "colliding", "dropped", F.col("n_pairs").alias("pairs"), F.col("n_uncompared").alias("uncompared"))


@query(f"""WITH s AS (SELECT c_nationkey, count(*) AS n, CAST(sum(base) AS DOUBLE) AS b, CAST(sum(base // 10) AS DOUBLE) AS c FROM ({_LINES}) GROUP BY c_nationkey)
SELECT 'n' || c_nationkey || '.pdf' AS file, CAST(i AS INTEGER) AS i, label, field, 'ancestro' AS level, CAST(n AS BIGINT) AS with_value, CASE i WHEN 2 THEN b WHEN 3 THEN c ELSE 0 END AS total FROM s,
  (VALUES (0, 'Identificación del Trabajador > RUT', 'rut'), (1, 'Identificación del Trabajador > Apellido Paterno Materno Nombres', 'nombre'), (2, 'Fondo de Pensiones > Remuneración Imponible', 'impAfp'), (3, 'Fondo de Pensiones > Cotización Obligatoria', 'cotObliAfp')) AS v(i, label, field)""")
def voucher_columns(spark, sf):
    return processed(spark, sf).columns.select("file", "i", "label", "field", "level", "with_value", F.col("total").cast("double").alias("total"))


@query(f"""WITH s AS (SELECT c_nationkey, {_ODD} FROM ({_LINES}) GROUP BY c_nationkey)
SELECT 'Total de portada sin comparar' AS kind, count(*) AS n FROM s UNION ALL SELECT 'Total no cuadra', count(*) FROM s WHERE c_nationkey % 5 = 0 UNION ALL SELECT 'Documento que no cuadra', count(*) FROM s WHERE c_nationkey % 5 = 0
UNION ALL SELECT 'Columnas constantes en el consolidado', 1 UNION ALL SELECT 'Celda fuera de su columna', count(*) FROM s WHERE outside > 0 HAVING count(*) > 0
UNION ALL SELECT 'Dos celdas en la misma columna', count(*) FROM s WHERE colliding > 0 HAVING count(*) > 0 UNION ALL SELECT 'Filas de datos descartadas', count(*) FROM s WHERE dropped > 0 HAVING count(*) > 0""")
def voucher_warnings(spark, sf):
    return processed(spark, sf).warnings.groupBy("kind").agg(F.count("*").alias("n"))


def without_boxes(spark: SparkSession, sf: str) -> ledger.Ledger:
    """The same vouchers without a drawn box: columns are those of the header row, cells go to the nearest one, and
    groups to the headings that they overlap or reign over."""
    files, cells, boxes = vouchers(spark, sf)
    return ledger.process(files, cells, boxes.where("false"))


@query(f"""WITH s AS (SELECT c_nationkey, count(*) AS n, CAST(sum(base) FILTER (WHERE o_orderkey % 89 <> 0) AS DOUBLE) AS b, CAST(sum(base // 10) FILTER (WHERE o_orderkey % 97 <> 0) AS DOUBLE) AS c FROM ({_LINES}) GROUP BY c_nationkey)
SELECT 'n' || c_nationkey || '.pdf' AS file, CAST(i AS INTEGER) AS i, label, field, level, CAST(n AS BIGINT) AS with_value, CASE i WHEN 2 THEN b WHEN 3 THEN c ELSE 0 END AS total FROM s,
  (VALUES (0, 'RUT', 'rut', 'hoja'), (1, 'Identificación del Trabajador > Apellido Paterno Materno Nombres', 'nombre', 'ancestro'), (2, 'Fondo de Pensiones > Remuneración Imponible', 'impAfp', 'ancestro'), (3, 'Fondo de Pensiones > Cotización Obligatoria', 'cotObliAfp', 'ancestro')) AS v(i, label, field, level)""")
def voucher_plain_columns(spark, sf):
    """An amount with a stray cell beside it can't be read, and is missing in its column's total."""
    return without_boxes(spark, sf).columns.select("file", "i", "label", "field", "level", "with_value", F.col("total").cast("double").alias("total"))


@query(f"""WITH s AS (SELECT c_nationkey, count(*) AS n, {_ODD} FROM ({_LINES}) GROUP BY c_nationkey)
SELECT 'n' || c_nationkey || '.pdf' AS file, CAST(n AS BIGINT) AS records, CAST(0 AS BIGINT) AS outside, CAST(outside + colliding AS BIGINT) AS colliding, dropped FROM s""")
def voucher_plain_states(spark, sf):
    return without_boxes(spark, sf).documents.select("file", F.col("n_records").alias("records"), "outside", "colliding", "dropped")


@query(f"""SELECT 'n' || c_nationkey || '.pdf' AS file, 'afp-cotizaciones' AS section, CAST(4 AS BIGINT) AS columns, CAST(min(2 + o_orderkey // {ROWS}) AS INTEGER) AS first_page, CAST(max(2 + o_orderkey // {ROWS}) AS INTEGER) AS last_page FROM ({_LINES}) GROUP BY c_nationkey""")
def voucher_sections(spark, sf):
    return report.sections(processed(spark, sf))


@query(f"""SELECT DISTINCT 'n' || c_nationkey || '.pdf' AS file, 'cotObliAfp,impAfp' AS fields, 'Fondo de Pensiones,Identificación del Trabajador' AS groups FROM ({_LINES})""")
def voucher_concepts(spark, sf):
    return report.concepts(processed(spark, sf)).select("file", F.array_join("fields", ",").alias("fields"), F.array_join("groups", ",").alias("groups"))


@query(f"""SELECT CAST(c_nationkey AS INTEGER) AS doc_ord, 'n' || c_nationkey || '.pdf' AS file, CAST(max(2 + o_orderkey // {ROWS}) AS INTEGER) AS pages, 'AFP PlanVital' AS institution, '07/2026' AS period, '' AS employer, count(*) AS records, CASE WHEN c_nationkey % 5 = 0 THEN 'no cuadra' ELSE 'verificado' END AS state
FROM ({_LINES}) GROUP BY c_nationkey""")
def voucher_metadata(spark, sf):
    """What a user interface shows of each document."""
    return workbook.metadata(processed(spark, sf)).select("doc_ord", "file", "pages", "institution", "period", "employer", "records", "state")


OWN = "GREMIO SOLIDARIO"


def own_institution(spark: SparkSession) -> C.Config:
    """A seventh institution that tables describe."""
    return C.BASE.with_tables(
        spark.createDataFrame([("gremio", "Gremio", None, None, [])], "profile string, shown string, regime string, health_code int, unbacked array<string>"),
        spark.createDataFrame([(1, "gremio", "institution", 12, r"(?iu)gremio\s+solidario"), (2, "afp", "institution", -20, r"(?iu)gremio")], "ord int, profile string, scope string, weight int, pattern string"),
        spark.createDataFrame([("gremio-detalle", "gremio", r"(?imu)^DETALLE DE PAGO", ["RUT"], [])], "section string, profile string, title string, anchors array<string>, additive array<string>"),
        spark.createDataFrame([("gremio-detalle", "fondo de pensiones remuneracion imponible", "impCcaf"), ("gremio-detalle", "fondo de pensiones cotizacion obligatoria", "credPersonal")], "section string, heading string, field string"),
        spark.createDataFrame([(1, "gremio", "cotizacion obligatoria", "field", ["credPersonal"], [], None, None, False), (2, "gremio", "numero afiliados informados", "count", [], [], None, None, False)], "ord int, profile string, key string, kind string, plus array<string>, minus array<string>, only string, why string, prefix boolean"),
    )


@query(f"""WITH s AS (SELECT c_nationkey, CAST(sum(base) AS DOUBLE) AS b, CAST(sum(base // 10) AS DOUBLE) AS c, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS n FROM ({_LINES}) GROUP BY c_nationkey)
SELECT 'n' || c_nationkey || '.pdf' AS file, 'Gremio' AS institution, 'Cotización Obligatoria' AS label, 'credPersonal' AS field, c AS declared, c AS extracted, true AS ok FROM s
UNION ALL SELECT 'n' || c_nationkey || '.pdf', 'Gremio', 'NUMERO AFILIADOS INFORMADOS', '(rut únicos)', n, n, true FROM s""")
def voucher_own_institution(spark, sf):
    """The same vouchers, of an institution that only tables know."""
    files, cells, boxes = vouchers(spark, sf)
    named = cells.withColumn("text", F.when(F.col("text") == "AFP PlanVital", OWN).otherwise(F.col("text")))
    run = ledger.process(files, named, boxes, config=own_institution(spark))
    return run.control.select("file", "institution", "label", "field", F.col("amount").cast("double").alias("declared"), F.col("extracted").cast("double").alias("extracted"), "ok")
