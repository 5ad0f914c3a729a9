"""The four-sheet workbook of a run: ledger, summary, columns and what to look at.

A sheet holds a million rows, so a longer ledger goes on in further sheets. Rows are put into a sheet's
form and compressed by the tasks that hold them (see ooxml). A task joins the compressed parts in a store
(store_workbook), or the driver copies them one after another into a file of its own (write_workbook).
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import checks
from ..operators import config as C
from ..plans.cuts import cut, numbered, scope
from ..plans.ledger import Ledger
from . import ooxml

# fixed values: the sheets' names
LEDGER, SUMMARY, COLUMNS, REVIEW = "TXT CONSOLIDADO", "Resumen", "Columnas", "Revisar"
WIDTH_ROWS, NARROWEST, WIDEST = 200, 8, 26
#: Compressed bytes that come to the driver at once; more come one partition at a time.
AT_ONCE = 32 << 20
#: fixed value: rows of a sheet, its heading included
ROWS_IN_A_SHEET = 1_048_576

# fixed values: the notes under the control table
NOTES = (
    "cod_mov: el PDF usa la codificación de movimientos de la caja (1 Contrataciones, 2 Retiros, 3 Subsidios, 4 Permiso sin goce, 5 Remuneraciones…), que no equivale al código de movimiento de personal del archivo plano. Se copia tal cual viene en el comprobante.",
    "Nombres: la columna del PDF tiene ancho fijo y recorta los nombres largos. Los casos detectados están en la hoja Revisar.",
    "Columnas sin dato: las que ninguna institución alimenta quedan en 0 o vacías, no se inventan valores.",
    "Los montos provienen del comprobante de la institución, que puede diferir de lo declarado previamente por el empleador.",
)


def shown_state() -> Column:
    """A document's state as the summary words it."""
    return (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error")))
        .when(F.col("duplicate_of").isNotNull(), F.concat(F.lit("Duplicado de "), F.col("duplicate_of")))
        .when(F.col("profile").isNull(), "Institución no reconocida")
        .when(F.col("state") == checks.MISMATCH, "NO CUADRA")
        .when(F.col("state") == checks.VERIFIED, F.format_string("Verificado (%d totales)", F.coalesce("n_compared", F.lit(0))))
        .otherwise("SIN VERIFICAR")
    )


def summary(result: Ledger) -> DataFrame:
    """(block, ord, cells): documents, each followed by its reasons, then the control table."""
    text = lambda *cs: F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cs])
    d = result.documents
    docs = d.select(F.lit(0).alias("block"), F.array(F.col("doc_ord"), F.lit(-1)).alias("ord"), text(F.col("file"), F.col("institution"), F.col("folio"), F.col("period.text"), F.col("employer.name"), F.col("pages"), F.col("n_records"), shown_state()).alias("cells"))
    why = d.where("reasons is not null").select("doc_ord", F.posexplode("reasons").alias("n", "reason")).select(F.lit(0).alias("block"), F.array("doc_ord", "n").alias("ord"), text(*[F.lit("")] * 7, F.col("reason")).alias("cells"))
    difference = F.col("extracted") - F.col("amount")
    control = result.control.select(F.lit(1).alias("block"), F.array("doc_ord", "pair_ord").alias("ord"), text(F.col("file"), F.col("label"), F.col("amount"), F.col("extracted"), difference, F.when(F.col("ok"), "✔").otherwise("✘")).alias("cells"))
    return docs.unionByName(why).unionByName(control)


#: fixed value: the order of the columns sheet
COLUMN_ORDER = ("doc_ord", "first_page", "section", "i")


def _columns(result: Ledger) -> DataFrame:
    pages = F.when(F.col("first_page") == F.col("last_page"), F.col("first_page").cast("string")).otherwise(F.concat_ws("-", "first_page", "last_page"))
    shown = {"pages": pages, "key": F.coalesce("key", F.lit("(ninguna)")), "level": F.coalesce("level", F.lit("")), "field": F.coalesce("field", F.lit("(SIN MAPEAR)"))}
    return result.columns.withColumns(shown)


def columns(result: Ledger) -> DataFrame:
    return _columns(result).orderBy(*COLUMN_ORDER).select("file", "section", "pages", "i", "label", "key", "level", "field", "with_value", "total")


def _review(result: Ledger) -> DataFrame:
    w = result.warnings
    none = w.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).alias("prio"), F.array().cast("array<bigint>").alias("ord"), F.lit("—").alias("kind"), F.lit("").alias("file"), F.lit("Sin observaciones: todo se leyó y se mapeó correctamente.").alias("detail"))
    return w.unionByName(none)


def review(result: Ledger) -> DataFrame:
    """The warnings in order, or one row that says there are none."""
    return _review(result).orderBy("prio", "ord").select("kind", "file", "detail")


def widths(rows: DataFrame, headers: list[str], names: list[str]) -> list[int]:
    """Column widths from some rows, within bounds."""
    few = rows.agg(*[F.max(F.length(F.coalesce(F.col(n).cast("string"), F.lit("")))).alias(n) for n in names]).first()
    return [min(WIDEST, max(NARROWEST, max(len(h), few[n] or 0) + 2)) for h, n in zip(headers, names)]


def file_name(result: Ledger, prefix: str = "consolidado") -> str:
    """The prefix with the month of the first document that has one: prefix-MMYYYY.xlsx."""
    p = result.documents.agg(F.min_by("period", F.when(F.col("period").isNotNull(), F.col("doc_ord"))).alias("p")).first()["p"]
    return f"{prefix}-{p['month']:02d}{p['year']}.xlsx" if p else f"{prefix}.xlsx"


def metadata(result: Ledger) -> DataFrame:
    """What a user interface shows of each document: no records."""
    return result.documents.select("doc_ord", "file", "pages", "institution", "profile", "folio", F.col("period.text").alias("period"), F.col("employer.name").alias("employer"), F.col("n_records").alias("records"), "state", "reasons", "duplicate_of", "error")


def _cell(row: int, col: int, text: str) -> str:
    return f'<c r="{ooxml.letters(col)}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>' if text else ""


def _row(at: int, texts: list[str]) -> str:
    return f'<row r="{at}">' + "".join(_cell(at, c, t) for c, t in enumerate(texts, 1)) + "</row>"


def rows_in_form(rows: DataFrame, names: list[str], at: Column) -> DataFrame:
    """(at, row): rows as a sheet holds them, at is the number of a row. Decimals and numbers are written
    plainly and without trailing zeros, empty cells left out."""
    kinds, place = dict(rows.dtypes), F.col("_at")
    cells = [ooxml.text_cell(n, place, F.col(name)) if kinds[name] == "string" else ooxml.number_cell(n, place, ooxml.plain_number(F.col(name))) for n, name in enumerate(names, 1)]
    return rows.withColumn("_at", at.cast("long").cast("string")).select(at.cast("long").alias("at"), ooxml.row(place, cells).alias("row"))


def _head(width: list[int], frozen: bool) -> str:
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if frozen else ""
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(width, 1))
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{view}<cols>{cols}</cols><sheetData>'


def _tail(width: list[int], filtered: bool) -> str:
    return "</sheetData>" + (f'<autoFilter ref="A1:{ooxml.letters(len(width))}1"/>' if filtered else "") + "</worksheet>"


# fixed values: the sheets' headings and widths
SUMMARY_HEAD = ["Archivo", "Institución", "Folio", "Período", "Empleador", "Páginas", "Líneas leídas", "Estado"]
CONTROL_HEAD = [[], ["Totales de control declarados por cada comprobante"], [], ["Archivo", "Concepto", "Dice el comprobante", "Suma de lo extraído", "Diferencia", ""]]
COLUMNS_HEAD = ["Archivo", "Sección", "Págs.", "#", "Encabezado detectado", "Clave que calzó", "Nivel", "Campo", "Filas con valor", "Suma"]
REVIEW_HEAD = ["Tipo", "Archivo", "Detalle"]
WIDTHS = {SUMMARY: [34, 30, 22, 10, 34, 9, 13, 26], COLUMNS: [26, 22, 10, 5, 52, 46, 10, 16, 14, 16], REVIEW: [26, 30, 100]}
#: Cells of the control table that are numbers.
AMOUNTS = (3, 4, 5)


def _summary_rows(result: Ledger) -> tuple[DataFrame, int, int]:
    """(segment, at, row) of both tables of the summary, and how many rows each has."""
    sums = summary(result)
    docs = cut(numbered(sums.where("block = 0"), [F.col("ord")]))
    control = cut(numbered(sums.where("block = 1"), [F.col("ord")]))
    n_docs, n_control = docs.count(), control.count()
    place = F.col("_at")
    texts = [ooxml.text_cell(n + 1, place, F.get("cells", F.lit(n))) for n in range(len(SUMMARY_HEAD))]
    amounts = [(ooxml.number_cell(n + 1, place, ooxml.plain_number(F.when(F.get("cells", F.lit(n)) != "", F.get("cells", F.lit(n))))) if n + 1 in AMOUNTS else texts[n]) for n in range(6)]
    made = []
    for segment, (rows, cells, before) in enumerate(((docs, texts, 1), (control, amounts, 1 + n_docs + len(CONTROL_HEAD)))):
        at = F.col("line") + before
        made.append(rows.withColumn("_at", at.cast("string")).select(F.lit(segment).alias("segment"), at.alias("at"), ooxml.row(place, cells).alias("row")))
    return made[0].unionByName(made[1]), n_docs, n_control


def write_workbook(result: Ledger, target) -> None:
    """The workbook into a path or binary file on the driver."""
    with scope(result.ledger.sparkSession):
        made, known, sheets, shown = _made(result)
        order = ["sheet", "segment", "part"]
        if sum(k[-1] for k in known) <= AT_ONCE:
            flow = (bytes(r["data"]) + ooxml.END for r in sorted(made.select(*order, "data").collect(), key=lambda r: tuple(r)[:3]))
        else:
            flow = (bytes(r["data"]) + ooxml.END for r in made.orderBy(*order).select("data").toLocalIterator())
        out = target if hasattr(target, "write") else open(target, "wb")  # noqa: SIM115
        try:
            _put_together(out, known, sheets, shown, flow)
        finally:
            if out is not target:
                out.close()


def store_workbook(result: Ledger, path: str) -> str:
    """The workbook as the one file in a folder of any store that Spark writes, without its content passing the
    driver; returns a pattern that finds it."""
    with scope(result.ledger.sparkSession):
        made, known, sheets, shown = _made(result)
        gaps = ooxml.Gaps()
        _put_together(gaps, known, sheets, shown, (ooxml.Part(k[:3], k[-1]) for k in known), ooxml.END)
        ooxml.store(made, gaps, path)
    return f"{path}/part-*"


def _made(result: Ledger) -> tuple[DataFrame, list[tuple], list[tuple], list[int]]:
    """The compressed parts, (sheet, segment, part, crc, raw, packed) of each in order, the sheets as texts
    and segments, and the order of their tabs."""
    names, headers = [c.name for c in C.LAYOUT], [c.header for c in C.LAYOUT]
    line, lines = C.column("Linea").name, result.ledger
    most = ROWS_IN_A_SHEET - 1
    n_lines = int(lines.agg(F.max(line)).first()[0] or 0)
    at = F.col(line).cast("long") - 1
    more = max(0, -(-n_lines // most) - 1)  # sheets that the ledger goes on in; they follow the four in the archive
    placed = lines.withColumns({"_sheet": at, "_own": at % most + 2})
    sheet = F.when(F.col("_sheet") < most, 0).otherwise(F.expr(f"_sheet div {most}") + 3).cast("int")
    form = [ooxml.text_cell(n, F.col("_at"), F.col(c)) if kind == "string" else ooxml.number_cell(n, F.col("_at"), ooxml.plain_number(F.col(c))) for n, (c, kind) in enumerate(((c, dict(lines.dtypes)[c]) for c in names), 1)]
    ledger = placed.withColumn("_at", F.col("_own").cast("string")).select(sheet.alias("sheet"), F.lit(0).alias("segment"), F.col("_own").alias("at"), ooxml.row(F.col("_at"), form).alias("row"))
    sums, n_docs, n_control = _summary_rows(result)
    audit, told = (numbered(rows, list(map(F.col, order))) for rows, order in ((_columns(result), COLUMN_ORDER), (_review(result), ("prio", "ord"))))
    audit = rows_in_form(audit, ["file", "section", "pages", "i", "label", "key", "level", "field", "with_value", "total"], F.col("line") + 1)
    told = rows_in_form(told, ["kind", "file", "detail"], F.col("line") + 1)
    whole = [ledger, sums.select(F.lit(1).alias("sheet"), "segment", "at", "row"), *(t.select(F.lit(n).alias("sheet"), F.lit(0).alias("segment"), "at", "row") for n, t in ((2, audit), (3, told)))]
    rows = whole[0]
    for other in whole[1:]:
        rows = rows.unionByName(other)
    made = cut(ooxml.parts(rows))
    known = sorted(map(tuple, made.select("sheet", "segment", "part", "crc", "raw", "packed").collect()))  # a row for each part
    ledger_widths = widths(lines.where(F.col(line) <= WIDTH_ROWS), headers, names)
    block = lambda first, rows: "".join(_row(first + n, r) for n, r in enumerate(rows))
    after = 2 + n_docs
    notes = [[], ["Advertencias sobre el contenido"], *([n] for n in NOTES)]
    ledger_sheet = [_head(ledger_widths, True) + _row(1, headers), 0, _tail(ledger_widths, n_lines > 0)]
    sheets = [
        (LEDGER, ledger_sheet),
        (SUMMARY, [_head(WIDTHS[SUMMARY], False) + _row(1, SUMMARY_HEAD), 0, block(after, CONTROL_HEAD), 1, block(after + len(CONTROL_HEAD) + n_control, notes) + _tail([], False)]),
        (COLUMNS, [_head(WIDTHS[COLUMNS], False) + _row(1, COLUMNS_HEAD), 0, _tail([], False)]),
        (REVIEW, [_head(WIDTHS[REVIEW], False) + _row(1, REVIEW_HEAD), 0, _tail([], False)]),
        *((f"{LEDGER} ({n + 2})", ledger_sheet) for n in range(more)),
    ]
    shown = [0, *range(4, 4 + more), 1, 2, 3]  # the order of the tabs
    return made, known, sheets, shown


def _put_together(out, known: list[tuple], sheets: list[tuple], shown: list[int], flow: Iterator[bytes], comment: bytes = b"") -> None:
    """The archive of the sheets, whose parts flow in order."""
    sums_of: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for sheet_no, segment, _, *sums_ in known:
        sums_of.setdefault((sheet_no, segment), []).append(tuple(sums_))
    space = "http://schemas.openxmlformats.org"
    z = ooxml.Archive(out)
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(1, len(sheets) + 1))
    z.add_text("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
    z.add_text("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="rId1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    tabs = "".join(f'<sheet name="{sheets[n][0]}" sheetId="{n + 1}" r:id="rId{n + 1}"/>' for n in shown)
    z.add_text("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{space}/spreadsheetml/2006/main" xmlns:r="{space}/officeDocument/2006/relationships"><sheets>{tabs}</sheets></workbook>')
    links = "".join(f'<Relationship Id="rId{n}" Type="{space}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
    z.add_text("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{space}/package/2006/relationships">{links}</Relationships>')
    for n, (_, stretches) in enumerate(sheets):
        z.add(f"xl/worksheets/sheet{n + 1}.xml", *_stretched(n, stretches, sums_of, flow))
    z.close(comment)


def _stretched(sheet: int, stretches: list[str | int], sums_of: dict, flow: Iterator[bytes]) -> tuple[list[tuple[int, int, int]], Iterator[bytes]]:
    """The sums and bytes of a sheet: texts are compressed here, numbers stand for segments of the flow of parts."""
    whole = [[ooxml.literal(s)] if isinstance(s, str) else [(*p, None) for p in sums_of.get((sheet, s), [])] for s in stretches]
    flat = [x for part in whole for x in part]
    return [x[:3] for x in flat], (next(flow) if x[3] is None else x[3] for x in flat)
