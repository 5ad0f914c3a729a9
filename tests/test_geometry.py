import pytest

from ledgerloom.functions.text import norm
from ledgerloom.operators import geometry
from pyspark.sql import functions as F

CELLS = "doc_id string, page int, item_ord int, x0 double, x1 double, xc double, y double, text string"
BOXES = "doc_id string, page int, x0 double, x1 double, y0 double, y1 double"

PAGE = [
    (98, "Identificación del Trabajador", 83, 158), (98, "Fondo de Pensiones", 344, 399), (98, "Seguro Cesantía", 562, 608),
    (108, "RUT", 32, 45), (108, "Nombre", 93, 190), (108, "Remuneración", 229, 268), (108, "Cotización", 279, 307), (108, "Remuneración", 524, 563), (108, "Cotización", 575, 603),
    (114, "Imponible", 235, 261), (114, "Obligatoria", 279, 308), (114, "Imponible", 531, 557), (114, "Afiliado", 579, 599),
    (126, "9.068.054-4", 20, 58), (126, "PEREZ JUAN", 62, 190), (126, "1.000.000", 240, 272), (126, "100.000", 285, 313), (126, "900.000", 535, 567), (126, "5.400", 585, 607),
]
EDGES = [(18, 59), (59, 223), (223, 273), (273, 314), (519, 569), (569, 610)]
BANDS = [(90, 100, [(18, 223), (223, 519), (519, 651)]), (100, 122, EDGES), (122, 130, EDGES)]


def cells(spark, items, doc="d", page=2):
    return spark.createDataFrame([(doc, page, n, float(a), float(b), (a + b) / 2, float(y), t) for n, (y, t, a, b) in enumerate(items)], CELLS)


def boxes(spark, bands, doc="d", page=2):
    rows = [(doc, page, float(a), float(b), float(y0), float(y1)) for y0, y1, cs in bands for a, b in cs]
    return spark.createDataFrame(rows * 2, BOXES)  # fill and stroke: every cell is drawn twice


def table(spark, items, bands, anchors=("RUT",)):
    pages = geometry.pages_of(geometry.rows_of(cells(spark, items)), geometry.bands_of(boxes(spark, bands)))
    pages = pages.withColumn("anchors", F.array(*[norm(F.lit(a)) for a in anchors]))
    return geometry.read_rows(geometry.locate_tables(pages)).first()


def test_rows_by_anchor_not_by_gap(spark):
    items = [(y, f"t{y}", 10 * y, 10 * y + 5) for y in (0, 2, 4, 6, 10)]
    rows = geometry.rows_of(cells(spark, items)).orderBy("row_no").collect()
    assert [(r["y"], r["text"]) for r in rows] == [(0, "t0 t2"), (4, "t4 t6"), (10, "t10")]


def test_bands_drop_lines_and_repeats(spark):
    lines = boxes(spark, [*BANDS, (50, 50.5, [(0, 100)]), (60, 70, [(5, 6)]), (90.3, 100.4, [(651, 700)])])
    got = geometry.bands_of(lines).orderBy("y0", "band_no").collect()
    assert [(r["y0"], r["y1"], len(r["cells"])) for r in got] == [(90, 100, 4), (100, 122, 6), (122, 130, 6)]


def test_ruled_columns_tell_equal_headings_apart(spark):
    t = table(spark, PAGE, BANDS)
    assert t["path"] == "rayado"
    same = [c for c in t["columns"] if c["leaf"] == "Remuneración Imponible"]
    assert [c["ancestors"] for c in same] == [["Fondo de Pensiones"], ["Seguro Cesantía"]]
    assert [c["keys"][0] for c in same] == ["fondo de pensiones remuneracion imponible", "seguro cesantia remuneracion imponible"]
    assert t["columns"][0]["label"] == "Identificación del Trabajador > RUT"
    assert [r["values"] for r in t["lines_read"]] == [["9.068.054-4", "PEREZ JUAN", "1.000.000", "100.000", "900.000", "5.400"]]
    assert (t["read"], t["dropped"], t["outside"], t["colliding"]) == (1, 0, 0, 0)


def test_without_boxes_the_middle_between_headings_misleads(spark):
    t = table(spark, PAGE, [])
    assert t["path"] == "heuristico"
    first = next(c for c in t["columns"] if c["leaf"].startswith("Remuneración"))
    assert first["ancestors"] == ["Identificación del Trabajador"]


def test_no_data_no_table(spark):
    assert table(spark, [i for i in PAGE if i[0] < 126], BANDS)["path"] is None
    assert table(spark, PAGE, BANDS, ("RUT", "Nombre Afiliado"))["path"] is None


def test_employer_block_above_stops_the_climb(spark):
    glued = [(80, 90, [(18, 223), (223, 651)]), *BANDS]
    items = [(85, "RUT:", 20, 40), (85, "61.313.000-4", 230, 300), *PAGE]
    t = table(spark, items, glued)
    assert t["columns"][0]["ancestors"] == ["Identificación del Trabajador"] and t["columns"][0]["leaf"] == "RUT"


def test_merged_header_cell_and_collisions_and_totals(spark):
    merged = [(90, 100, [(18, 59), (59, 223), (223, 519), (519, 651)]), (100, 122, [*EDGES[:4], *EDGES[4:]]), (122, 130, EDGES)]
    more = [
        (134, "12.786.960-K", 20, 58), (134, "SOTO", 62, 100), (134, "ANA", 110, 150), (134, "7", 400, 410),
        (142, "no id here", 62, 100), (150, "TOTALES ACUMULADOS", 20, 100), (158, "1.111.111-1", 20, 58),
    ]
    t = table(spark, PAGE + more, merged)
    assert [r["values"][1] for r in t["lines_read"]] == ["PEREZ JUAN", "SOTO ANA"]
    assert (t["read"], t["dropped"], t["outside"], t["colliding"]) == (3, 1, 1, 1)


@pytest.mark.parametrize("bands", [[], BANDS])
def test_empty_pages(spark, bands):
    pages = geometry.pages_of(geometry.rows_of(cells(spark, [])), geometry.bands_of(boxes(spark, bands)))
    assert geometry.read_rows(geometry.locate_tables(pages.withColumn("anchors", F.array(F.lit("rut"))))).count() == 0


def test_pages_of_one_form_share_their_drawing_and_layout(spark):
    """What pages of one form have in common is worked out once; a page of another form is on its own."""
    other = [(y0, y1, [(a + 3, b + 3) for a, b in cs]) for y0, y1, cs in BANDS]
    forms = [BANDS, BANDS, other, BANDS]
    rows, drawn = cells(spark, PAGE, page=2), boxes(spark, forms[0], page=2)
    for n, form in enumerate(forms[1:], 3):
        rows, drawn = rows.union(cells(spark, PAGE, page=n)), drawn.union(boxes(spark, form, page=n))
    kept = []

    def keep(df):
        kept.append(df.count())
        return df

    pages = geometry.whole_pages(geometry.page_rows(rows), geometry.page_bands(drawn, keep))
    found = geometry.locate_tables(pages.withColumn("anchors", F.array(F.lit("rut"))), keep=keep)
    got = {r["page"]: r for r in geometry.read_rows(found).collect()}
    assert kept == [4, 2, 2]  # drawings by page, distinct ones, distinct layouts
    assert {n: r["columns"][0]["x0"] for n, r in got.items()} == {2: 18, 3: 18, 4: 21, 5: 18}
    assert {r["path"] for r in got.values()} == {"rayado"} and {r["read"] for r in got.values()} == {1}
