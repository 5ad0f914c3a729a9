import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import classify, cover, geometry
from ledgerloom.operators import config as C
from ledgerloom.plans import ledger

from . import vouchers


@pytest.fixture(scope="module")
def result(spark):
    files, cells, boxes = vouchers.build(spark, vouchers.sample())
    ignored = spark.createDataFrame([("notas.txt", 0)], "file string, file_ord long")
    return ledger.process(files, cells, boxes, ignored)


def col(row, header):
    return row[C.column(header).name]


def test_documents(result):
    docs = {r["doc_id"]: r for r in result.documents.collect()}
    assert {d: (r["profile"], r["institution"]) for d, r in docs.items()} == {
        "d1": ("afp", "AFP PlanVital"), "d2": ("afp", "AFP PlanVital"), "d3": ("ccaf", "Caja de Compensación Los Andes"), "d4": (None, "(no reconocida)"), "d5": (None, "(no reconocida)"),
    }
    assert docs["d2"]["duplicate_of"] == "afp.pdf" and docs["d1"]["duplicate_of"] is None
    assert docs["d1"]["period"]["code"] == "72026" and docs["d3"]["period"]["text"] == "07/2026" and docs["d1"]["folio"] == "F-1"
    assert tuple(docs["d1"]["employer"]) == ("CORPORACION EJEMPLO", "61.313.000-4")
    assert {d: r["state"] for d, r in docs.items()} == {"d1": "verificado", "d2": None, "d3": "no cuadra", "d4": "no cuadra", "d5": "sin verificar"}
    assert (docs["d3"]["no_section"], docs["d3"]["no_table"], docs["d3"]["dropped"]) == ([3], [4], 1)
    assert result.state().first()["state"] == "no cuadra"


def test_ledger(result):
    rows = result.ledger.orderBy(C.column("Linea").name).collect()
    assert [col(r, "rut") for r in rows] == ["12786960", "7654321", "9068054"] and [int(col(r, "Linea")) for r in rows] == [1, 2, 3]
    assert len(rows[0]) == 108
    juan = rows[2]
    assert (col(juan, "ape_pat"), col(juan, "ape_mat"), col(juan, "nombres"), col(juan, "dv")) == ("PEREZ", "SOTO", "JUAN JOSE", "4")
    assert {h: int(col(juan, h)) for h in ("impo_afp", "cot_obli_afp", "Renta_impo_SC", "Aporte_trab_SC", "cot_CCAF", "asig_fam", "nom_AFP", "cod_CCAF")} == {
        "impo_afp": 1000010, "cot_obli_afp": 99999, "Renta_impo_SC": 900000, "Aporte_trab_SC": 5400, "cot_CCAF": 42, "asig_fam": 1000, "nom_AFP": 29, "cod_CCAF": 1,
    }
    assert (juan[C.LAYOUT[1].name], col(juan, "reg_previ"), col(juan, "remu_desde"), col(juan, "tipo_linea")) == ("CAJA LOS ANDES", "AFP", "72026", "00")
    assert col(rows[0], "impo_ccaf") == 0 and rows[0][C.LAYOUT[1].name] == ""


def test_control(result):
    got = {(r["file"], r["label"]): (r["field"], int(r["amount"]), int(r["extracted"]), r["ok"]) for r in result.control.collect()}
    assert got[("afp.pdf", "Renta Imponible")] == ("impAfp", 1500010, 1500010, True)
    assert got[("afp.pdf", "NUMERO AFILIADOS INFORMADOS FDO CESANTIA")] == ("(rut únicos con impSC)", 1, 1, True)
    assert got[("afp.pdf", "TOTAL REMUNERACIONES O GRATIFICACIONES")] == ("impSC", 900000, 900000, True)
    assert got[("afp.pdf", "TOTAL A PAGAR FONDO DE PENSIONES AFP PlanVital")][1:] == (149999, 149999, True)
    assert got[("caja.pdf", "Creditos Personales")] == ("credPersonal", 11, 0, False)
    assert got[("caja.pdf", "ASIGNACIÓN FAMILIAR")] == ("asigFam", 3000, 3000, True)
    assert not any(f == "afp-copia.pdf" for f, _ in got)


def test_audit(result):
    got = {(r["file"], r["i"]): (r["section"], r["label"], r["field"], r["level"], r["with_value"], int(r["total"])) for r in result.columns.collect()}
    assert got[("afp.pdf", 2)] == ("afp-cotizaciones", "Fondo de Pensiones > Remuneración Imponible", "impAfp", "ancestro", 3, 1500010)
    assert got[("afp.pdf", 4)][2:] == ("impSC", "ancestro", 2, 900000)
    assert got[("caja.pdf", 4)] == ("ccaf-cotizaciones", "Misterio", None, None, 1, 0)


def test_warnings(result):
    rows = [tuple(r) for r in result.warnings.orderBy("prio", "ord").select("kind", "file", "detail").collect()]
    kinds = [r[0] for r in rows]
    assert kinds[0] == "Total no cuadra" and rows[0][2] == "Creditos Personales: el comprobante dice 11 y lo extraído suma 0 (dif. -11)"
    assert ("Error al leer el PDF", "roto.pdf", "no es un PDF") in rows
    assert ("PDF duplicado", "afp-copia.pdf", 'Mismo folio F-1 que "afp.pdf". Se procesó una sola vez para no duplicar los montos.') in rows
    assert ("Columna sin mapear", "caja.pdf", "Misterio") in rows and kinds.count("Columna sin mapear") == 1
    assert ("Página sin sección", "caja.pdf", "Página 3: su título no calza con ninguna sección del perfil.") in rows
    assert ("Página sin leer", "caja.pdf", "Página 4: no se encontró la tabla.") in rows
    assert ("RUT inválido", "", "12.786.960-1 — el dígito verificador debería ser K") in rows
    assert any(k == "Nombre incompleto" and "ABARCA ARIAS DE LA" in d for k, _, d in rows)
    assert any(k == "Valor no numérico en columna mapeada" and d == 'Seguro Cesantía > Remuneración Imponible → impSC: "x9"' for k, _, d in rows)
    assert ("Filas de datos descartadas", "caja.pdf", "1 de 3 filas no traían RUT y no se leyeron.") in rows
    assert ("PDF sin folio", "caja.pdf", "Sin folio no se puede detectar si este comprobante viene repetido en el ZIP.") in rows
    assert ("Total de portada sin comparar", "afp.pdf", "Otro concepto: 7 — el perfil no dice contra qué cotejarlo.") in rows
    assert rows[-1] == ("Archivo ignorado", "notas.txt", "No es un .pdf") and any(k == "Columnas constantes en el consolidado" for k in kinds)


AFP = "COMPROBANTE DE PAGO DE COTIZACIONES PREVISIONALES Y DEPOSITOS DE AHORRO VOLUNTARIO\nFONDO DE PENSIONES, SEGURO DE CESANTIA, APVI, APVC Y AFILIADO VOLUNTARIO\nPeríodo de Remuneraciones: 07/2026\nAFP PlanVital\nCORPORACION NACIONAL FORESTAL\nRenta Imponible\nCotización Obligatoria\nSeguro Invalidez y Sobrevivencia (SIS)"
AFC = "COMPROBANTE DE PAGO DE COTIZACIONES DEL SEGURO DE CESANTIA\nPeríodo de Remuneraciones: 07/2026\nAFC Chile II S.A.\nAdministradora de Fondos de Cesantía\nAporte Trabajador\nAporte Empleador"


@pytest.mark.parametrize(
    "text,profile,name",
    [
        (AFP, "afp", "AFP PlanVital"),
        ("COMPROBANTE\nPeríodo de Remuneraciones: 07/2026\nCaja de Compensación Los Andes\nCORPORACION NACIONAL FORESTAL\nCOTIZACIÓN NO AFILIADOS A ISAPRE\nASIGNACIÓN FAMILIAR", "ccaf", "Caja de Compensación Los Andes"),
        (AFC, "afc", "AFC"),
        ("BOLETA DE HONORARIOS ELECTRÓNICA\nSERVICIO DE IMPUESTOS INTERNOS", None, "(no reconocida)"),
        ("COMPROBANTE DE PAGO\nCaja de Compensación Los Andes\nes esencial revisar los datos", "ccaf", "Caja de Compensación Los Andes"),
        ("", None, "(no reconocida)"),
    ],
)
def test_classification(spark, text, profile, name):
    got = classify.classified(spark.createDataFrame([("d", text)], "doc_id string, lines string")).first()
    assert (got["profile"], got["institution"]) == (profile, name)


def test_cover_boxes_keep_side_by_side_frames_apart(spark):
    items = [(20, "Renta Imponible", 20, 100), (20, "406.998.661", 150, 190), (14, "NUMERO AFILIADOS", 210, 290), (20, "409", 230, 260)]
    bands = [(16, 24, [(10, 140), (140, 200)]), (15, 25, [(205, 300), (300, 400)])]
    _, cells, boxes = vouchers.build(spark, [("d", "f", {1: (items, bands)}, None)])
    pages = geometry.pages_of(geometry.rows_of(cells), geometry.bands_of(boxes))
    pairs = cover.covers(pages).first()["pairs"]
    assert sorted((p["label"], int(p["amount"])) for p in pairs) == [("NUMERO AFILIADOS", 409), ("Renta Imponible", 406998661)]


def test_empty(spark):
    files, cells, boxes = (spark.createDataFrame([], s) for s in (vouchers.FILES, vouchers.CELLS, vouchers.BOXES))
    out = ledger.process(files, cells, boxes)
    assert out.ledger.count() == 0 and out.control.count() == 0
    assert out.warnings.select("kind").collect()[0][0] == "Columnas constantes en el consolidado"
    assert out.state().first()["state"] == "verificado"


def test_config_is_consistent():
    headers = {c.header for c in C.LAYOUT}
    assert len(C.LAYOUT) == 108 and len({c.name for c in C.LAYOUT}) == 108
    assert all(col is None or col in headers for _, col in C.FIELDS.values())
    assert all(f in C.FIELDS and C.normal(k) for _, k, f in C.LABELS)
    assert all(f in C.FIELDS for t in C.TOTALS for f in (*t.plus, *t.minus, *filter(None, [t.where])))
    assert all(C.normal(t.key) for t in C.TOTALS) and {t.profile for t in C.TOTALS} <= set(C.PROFILES)
    assert all(f in C.NUMERIC for *_, fields in C.SECTIONS.values() for f in fields)
    assert all(p in C.PROFILES and anchors for p, _, anchors, _ in C.SECTIONS.values()) and {p for p, *_ in C.SECTIONS.values()} == set(C.PROFILES)
    assert all({s for s, _, _ in C.LABELS} - {"common"} == set(C.SECTIONS) for _ in [0])
    assert len(set(C.FUND_CODES.values())) == len(C.FUND_CODES)
