"""One row for each person: merging, and the fixed output layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxid import split_name
from . import config as C
from .classify import code_of, short_fund
from .merge import first_where, kinds_of, merged_fields

ORDER = ["doc_ord", "page", "row_no"]


def people(values: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for each tax id body, with every canonical field merged by its rule.

    values: doc_id, page, row_no, id, field, num, txt; docs: doc_id, doc_ord, profile,
    institution, period. Every record has its rut. Values are merged by person and field, each once, before a
    person's become one row; sums combine before the shuffle. The check digit is that of the person's first record.
    """
    info = docs.select("doc_id", "doc_ord", "profile", "institution", "period")
    rows = values.join(info, "doc_id")
    up = [F.col(c) for c in ORDER]
    place = F.struct(*ORDER)
    first = lambda value, where: first_where(value, where, up)
    regime, health = (F.lit(None) for _ in range(2))
    for p, (_, r, h, _) in C.PROFILES.items():
        regime = F.when(F.col("profile") == p, F.lit(r)).otherwise(regime) if r else regime
        health = F.when(F.col("profile") == p, F.lit(h)).otherwise(health) if h else health
    body = F.col("id.body").alias("body")
    # a person's first record in each document, then what is known of these documents
    inside = F.struct("page", "row_no")
    each = values.where("field = 'rut'").groupBy(body, "doc_id").agg(F.min_by("id", inside).alias("id"), F.min(inside).alias("at"), F.count("*").alias("n"))
    about = each.join(info, "doc_id").select("*", "at.*").groupBy("body").agg(
        F.min_by("id", place).alias("id"), F.min(place).alias("place"), F.sum("n").alias("n_lines"),
        kinds_of(F.col("institution")).alias("sources"), kinds_of(F.col("profile")).alias("profiles"),
        first(F.col("period"), F.col("period").isNotNull()).alias("period"),
        first(F.col("institution"), F.col("profile") == "ccaf").alias("fund"), first(F.col("institution"), F.col("profile") == "afp").alias("pension"),
        first(regime, regime.isNotNull()).cast("string").alias("regime"), first(health, health.isNotNull()).cast("int").alias("health"),
    )
    kept = merged_fields(rows.select(body, "field", "num", "txt", *ORDER), ["body"], {f: rule for f, (rule, _) in C.FIELDS.items()}, ORDER)
    return about.join(kept, "body", "left")


def ledger(numbered: DataFrame) -> DataFrame:
    """The 108 columns of the layout, under unique internal names, for people with `line`."""
    name = split_name(F.coalesce("nombre", F.lit("")))
    pays = F.coalesce(F.col("rutSubs") != "0", F.lit(False)) & F.col("rutSubs").rlike(C.SUBSIDY)
    filled: dict[int, Column] = {
        0: F.col("body"),
        1: short_fund(F.col("fund")),
        C.column("Linea").at: F.col("line"),
        C.column("rut").at: F.col("body"),
        C.column("dv").at: F.col("id.digit"),
        C.column("ape_pat").at: name["paternal"],
        C.column("ape_mat").at: name["maternal"],
        C.column("nombres").at: name["given"],
        C.column("remu_desde").at: F.col("period.code"),
        C.column("remu_hasta").at: F.col("period.code"),
        C.column("reg_previ").at: F.col("regime"),
        C.column("cod_inst_salud").at: F.col("health"),
        C.column("cod_CCAF").at: code_of(F.col("fund"), C.FUND_CODES, "^caja de compensacion "),
        C.column("nom_AFP").at: code_of(F.col("pension"), C.PENSION_CODES, r"^a ?f ?p\s+"),
        C.column("rut_pag_subs").at: F.when(pays, F.regexp_replace(F.regexp_extract("rutSubs", C.SUBSIDY, 1), r"\.", "").try_cast("decimal(20,6)")),
        C.column("dv_pag_subs").at: F.when(pays, F.upper(F.regexp_extract("rutSubs", C.SUBSIDY, 2))),
    }
    filled |= {C.column(col).at: F.col(f) for f, (_, col) in C.FIELDS.items() if col}
    kinds = {"N": "decimal(20,6)"}
    cells = [F.coalesce(filled.get(c.at, F.lit(None)).cast(kinds.get(c.kind, "string")), F.lit(c.default).cast(kinds.get(c.kind, "string"))).alias(c.name) for c in C.LAYOUT]
    return numbered.select(*cells)
