"""Which institution a document comes from, by weighted rules over its cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BARCODE, norm, trimmed
from . import config as C
from .geometry import let
from .match import longest_pattern, scored

#: Word borders between ASCII letters, digits and underscores only: in Java, \b knows accents.
BORDER = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def institution_lines(cover: Column) -> Column:
    """Up to three short lines after the title that are neither a form's label nor a barcode."""
    lines = F.filter(F.transform(F.split(cover, "\n"), trimmed), lambda x: x != "")
    fit = F.filter(F.slice(lines, 2, 6), lambda x: (F.length(x) <= 60) & ~x.rlike(C.FORM_LABEL) & ~x.rlike(BARCODE))
    return F.array_join(F.slice(fit, 1, 3), "\n")


def classified(docs: DataFrame) -> DataFrame:
    """docs(doc_id, lines, ...) with profile (null for none), score, second, second_score,
    ambiguous, evidence and institution."""
    texts = {"cover": F.coalesce("lines", F.lit("")), "institution": F.col("_institution")}
    rules = [(p, scope, w, pattern.replace(r"\b", BORDER)) for p, scope, w, pattern in C.RULES]
    got = scored(texts, rules, C.MARGIN)
    out = docs.withColumn("_institution", institution_lines(F.coalesce("lines", F.lit(""))))
    out = out.withColumns({"profile" if k == "best" else k: v for k, v in got.items()})

    def name(pattern, group, prefix):
        found = lambda s: F.when(s.rlike(pattern), F.concat(F.lit(prefix), trimmed(F.regexp_extract(s, pattern, group))))
        return F.coalesce(found(texts["institution"]), found(texts["cover"]))

    label = F.lit(None).cast("string")
    for profile, (shown, *_) in C.PROFILES.items():
        label = F.when(F.col("profile") == profile, shown).otherwise(label)
    named = F.when(F.col("profile") == "ccaf", name(C.FUND_NAME, 1, "Caja de Compensación ")).when(F.col("profile") == "afp", name(C.PENSION_NAME, 1, ""))
    return out.withColumn("institution", F.coalesce(named, label, F.lit("(no reconocida)"))).drop("_institution")


def section_of(profile: Column, title: Column) -> tuple[Column, Column]:
    """(section, sections that match as well): the profile's section with the longest match."""
    section, ambiguous = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in C.PROFILES:
        own = {s: spec[1] for s, spec in C.SECTIONS.items() if spec[0] == p}
        best, others = longest_pattern(title, own)
        section = F.when(profile == p, best).otherwise(section)
        ambiguous = F.when(profile == p, others).otherwise(ambiguous)
    return section, ambiguous


def anchors_of(section: Column) -> Column:
    out = F.lit(None).cast("array<string>")
    for name, (_, _, anchors, _) in C.SECTIONS.items():
        out = F.when(section == name, F.array(*[norm(F.lit(a)) for a in anchors])).otherwise(out)
    return out


def short_fund(institution: Column) -> Column:
    """'Caja de Compensación Los Andes' as 'CAJA LOS ANDES'; others in capitals; null as ''."""
    found = F.regexp_extract(institution, C.SHORT_FUND, 1)
    return F.when(institution.isNull(), "").when(found != "", F.concat(F.lit("CAJA "), F.upper(trimmed(found)))).otherwise(F.upper(institution))


def code_of(institution: Column, codes: dict[str, int], prefix: str) -> Column:
    """The code of an institution's normalised name without its kind; null if it has none."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return let(F.regexp_replace(norm(institution), prefix, ""), lambda n: F.try_element_at(table, n))
