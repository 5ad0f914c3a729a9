"""Synthetic vouchers for the tests and for the registered ledger queries' own checks."""

from __future__ import annotations

CELLS = "doc_id string, page int, item_ord int, x0 double, x1 double, xc double, y double, text string"
BOXES = "doc_id string, page int, x0 double, x1 double, y0 double, y1 double"
FILES = "doc_id string, doc_ord int, file string, error string"

AFP_TITLE = ["DETALLE DE PAGO DE COTIZACIONES PREVISIONALES Y DEPOSITOS DE AHORRO VOLUNTARIO, FONDO DE PENSIONES"]
EDGES = [(18, 59), (59, 223), (223, 273), (273, 314), (519, 569), (569, 610)]
BANDS = [(90, 100, [(18, 223), (223, 519), (519, 651)]), (100, 122, EDGES), (122, 130, EDGES)]
AFP_HEAD = [
    (98, "Identificación del Trabajador", 83, 158), (98, "Fondo de Pensiones", 344, 399), (98, "Seguro Cesantía", 562, 608),
    (108, "RUT", 32, 45), (108, "Apellido Paterno Materno Nombres", 93, 190), (108, "Remuneración", 229, 268), (108, "Cotización", 279, 307), (108, "Remuneración", 524, 563), (108, "Cotización", 575, 603),
    (114, "Imponible", 235, 261), (114, "Obligatoria", 279, 308), (114, "Imponible", 531, 557), (114, "Afiliado", 579, 599),
]
CENTRES = [(20, 58), (62, 190), (240, 272), (285, 313), (535, 567), (585, 607)]


def lines(rows, y=126, step=8, centres=CENTRES):
    return [(y + step * n, t, *centres[i]) for n, r in enumerate(rows) for i, t in enumerate(r) if t]


def afp_cover(folio, totals):
    head = [
        (20, "COMPROBANTE DE PAGO DE COTIZACIONES PREVISIONALES", 100, 400), (28, f"Número de Folio: {folio}" if folio else "Comprobante", 100, 300),
        (36, "AFP PlanVital", 100, 200), (44, "Período de Remuneraciones: 07/2026", 100, 300),
        (52, "RUT", 30, 60), (52, "Nombre o Razón Social", 200, 320), (60, "61.313.000-4", 30, 90), (60, "CORPORACION EJEMPLO", 180, 300),
        (68, "FONDO DE PENSIONES", 20, 120),
    ]
    return head + [(80 + 8 * n, t, a, b) for n, (label, amount) in enumerate(totals) for t, a, b in ((label, 20, 200), (amount, 300, 360))]


def build(spark, docs):
    """docs: list of (doc_id, file, {page: (items, bands)}, error) in file order."""
    cells, boxes, files = [], [], []
    for n, (doc, file, pages, error) in enumerate(docs):
        files.append((doc, n, file, error))
        for page, (items, bands) in pages.items():
            cells += [(doc, page, k, float(a), float(b), (a + b) / 2, float(y), t) for k, (y, t, a, b) in enumerate(items)]
            boxes += [(doc, page, float(a), float(b), float(y0), float(y1)) for y0, y1, cs in bands for a, b in cs]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(cells, CELLS), spark.createDataFrame(boxes, BOXES)


AFP_ROWS = [
    ["9.068.054-4", "PEREZ SOTO JUAN", "1.000.000", "100.000", "900.000", "5.400"],
    ["12.786.960-1", "ABARCA ARIAS DE LA", "500.000", "50.000", "", ""],
    ["9.068.054-4", "PEREZ SOTO JUAN JOSE", "10", "-1", "x9", ""],
]
AFP_TOTALS = [("Renta Imponible", "1.500.010"), ("Cotización Obligatoria", "149.999"), ("COTIZACION AFILIADOS", "5.400"), ("NUMERO AFILIADOS INFORMADOS", "2"), ("NUMERO AFILIADOS INFORMADOS FDO CESANTIA", "1"),
    ("TOTAL REMUNERACIONES O GRATIFICACIONES", "900.000"), ("TOTAL A PAGAR FONDO DE PENSIONES AFP PlanVital", "149.999"), ("Monto Ahorro Voluntario", "0"), ("Otro concepto", "7")]


def sample():
    page2 = (lines([[t] for t in AFP_TITLE], 40, 8, [(20, 400)]) + AFP_HEAD + lines(AFP_ROWS), BANDS)
    good = {1: (afp_cover("F-1", AFP_TOTALS), []), 2: page2}
    ccaf = [
        (20, "COMPROBANTE DE PAGO DE COTIZACIONES PREVISIONALES", 100, 400), (28, "Caja de Compensación Los Andes", 100, 300), (36, "Julio 2026", 100, 200), (44, "ASIGNACIÓN FAMILIAR", 20, 120), (44, "3.000", 300, 330),
        (52, "Creditos Personales", 20, 120), (52, "11", 300, 330),
    ]
    plain = [
        (40, "DETALLE DE PAGO DE COTIZACIONES PREVISIONALES", 20, 400), (70, "RUT", 30, 50), (70, "Nombre Afiliado", 80, 160), (70, "Cotización 4,2%", 200, 260), (70, "Monto Asig Fam", 300, 360), (70, "Misterio", 400, 450),
        (80, "9.068.054-4", 20, 60), (80, "PEREZ JUAN", 80, 160), (80, "42", 210, 250), (80, "1.000", 310, 350), (80, "zz", 405, 440),
        (88, "7.654.321-6", 20, 60), (88, "ÑANDU ROSA MARIA", 80, 160), (88, "8", 210, 250), (88, "2.000", 310, 350),
        (96, "sin rut", 80, 160),
    ]
    return [
        ("d1", "afp.pdf", good, None),
        ("d2", "afp-copia.pdf", good, None),
        ("d3", "caja.pdf", {1: (ccaf, []), 2: (plain, []), 3: ([(40, "OTRA COSA", 20, 100)], []), 4: ([(40, "DETALLE DE PAGO DE OTRAS PRESTACIONES", 20, 300)], [])}, None),
        ("d4", "roto.pdf", {}, "no es un PDF"),
        ("d5", "boleta.pdf", {1: ([(20, "BOLETA DE HONORARIOS ELECTRÓNICA", 20, 200)], [])}, None),
    ]
