"""What the engine says: reasons of states and kinds and details of warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: reasons why a document isn't verified, in the order in which they are given
REASONS = {
    "error": "No se pudo leer: %s",
    "unknown": "No se identificó la institución.",
    "ambiguous": "Institución ambigua: %s (%s) apenas por encima de %s (%s); se exige %s de margen.",
    "no_control": "Ningún total de control: no hay nada en la portada contra qué comprobar lo extraído.",
    "failed": "%s: el comprobante dice %s y lo extraído suma %s.",
    "bare": "Campos con monto y sin ningún total que los respalde: %s.",
    "no_table": "Páginas sin tabla: %s.",
    "no_section": "Páginas sin sección reconocida: %s.",
    "repeated": "Dos columnas al mismo campo (no declarado acumulable): %s.",
}

# fixed values: warnings of a document (kind, detail), in the order in which they are given
DOCUMENT = {
    "unmapped": ("Columna sin mapear", "%s"),
    "generic": ("Columna mapeada por clave genérica", "%s — calzó sin usar su encabezado de agrupación; si hay otra columna con el mismo rótulo, se están confundiendo."),
    "no_table": ("Página sin leer", "Página %s: no se encontró la tabla."),
    "no_section": ("Página sin sección", "Página %s: su título no calza con ninguna sección del perfil."),
    "ambiguous_sections": ("Página con sección ambigua", "Calzaron varias secciones: %s."),
    "repeated": ("Dos columnas al mismo campo", "%s: dos columnas distintas escriben aquí y el perfil no lo declara acumulable."),
    "not_numeric": ("Valor no numérico en columna mapeada", '%s → %s: "%s"'),
    "dropped": ("Filas de datos descartadas", "%s de %s filas no traían RUT y no se leyeron."),
    "outside": ("Celda fuera de su columna", "%s celda(s) no cayeron dentro de ninguna columna."),
    "colliding": ("Dos celdas en la misma columna", "%s vez/veces se concatenaron dos valores en una celda."),
    "no_folio": ("PDF sin folio", "Sin folio no se puede detectar si este comprobante viene repetido en el ZIP."),
    "unlabelled": ("Monto de portada sin rótulo", "%s — no se pudo saber a qué concepto corresponde."),
    "uncompared": ("Total de portada sin comparar", "%s: %s — el perfil no dice contra qué cotejarlo."),
}

# fixed values: warnings of a run (kind, detail)
RUN = {
    "failed": ("Total no cuadra", "%s: el comprobante dice %s y lo extraído suma %s (dif. %s)"),
    "error": ("Error al leer el PDF", "%s"),
    "duplicate": ("PDF duplicado", 'Mismo folio %s que "%s". Se procesó una sola vez para no duplicar los montos.'),
    "mismatch": ("Documento que no cuadra", "%s"),
    "unverified": ("Documento SIN VERIFICAR", "%s"),
    "unknown": ("PDF no reconocido", "No se identificó la institución; el archivo no aportó datos."),
    "bad_id": ("RUT inválido", "%s — el dígito verificador debería ser %s"),
    "unfinished": ("Nombre incompleto", '%s — "%s" termina en una preposición o artículo; falta al menos una palabra.'),
    "constant": ("Columnas constantes en el consolidado", "%s de %s columnas salen iguales en todas las filas: %s"),
    "ignored": ("Archivo ignorado", "No es un .pdf"),
}

#: Our own: records that had a tax id, but not where the person's belongs.
LOST = ("Filas de datos descartadas", "%s filas traían RUT pero no en la columna del trabajador.")


def said(template: str, *parts: Column | str | int) -> Column:
    """A template with its parts as text."""
    if not parts:
        return F.lit(template)
    return F.format_string(template, *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
