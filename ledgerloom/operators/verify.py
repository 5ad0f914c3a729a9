"""Covers against what was extracted, each document's state, and every warning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxid import check_digit, unfinished_name
from ..functions.text import norm
from . import checks
from . import config as C
from .match import exact_or_prefix
from .wording import DOCUMENT, LOST, REASONS, RUN, said

PAIR = ["doc_id", "pair_ord"]


def shown(n: Column) -> Column:
    """A number as es-CL writes it: points between thousands, up to three decimals."""
    plain = F.translate(F.format_number(n, 3), ",.", ".,")
    return F.regexp_replace(F.regexp_replace(plain, r"(,\d*[1-9])0+$", "$1"), ",0+$", "")


def _total_of(profile: Column, label: Column) -> Column:
    """struct<kind, shown, only, why, name> of the total that a profile declares under a label, or null."""
    text = lambda x: F.lit(x).cast("string")
    out = F.lit(None).cast("struct<kind:string,shown:string,only:string,why:string,name:string>")
    for p in dict.fromkeys(t.profile for t in C.TOTALS):
        own = [t for t in C.TOTALS if t.profile == p]
        rows = F.array(*[F.struct(*[text(v).alias(k) for k, v in (("kind", t.kind), ("shown", t.shown), ("only", t.where), ("why", t.why), ("name", C.name_of(t)))]) for t in own])
        at = exact_or_prefix(label, [(t.key, t.prefix) for t in own])
        out = F.when(profile == p, F.get(rows, at)).otherwise(out)
    return out


def compare_covers(pairs: DataFrame, docs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs with outcome (compared, note, uncompared), field, extracted and ok.

    pairs: doc_id, pair_ord, label, amount; docs: doc_id, profile; values: doc_id, id, field, num, where every record
    has its rut. People are counted once for all lines and for the fields that totals name. Sums are worked out once for all totals. A declared total must equal its sum exactly.
    """
    known = pairs.join(docs.select("doc_id", "profile"), "doc_id")
    named = known.withColumn("_t", _total_of(F.col("profile"), norm(F.col("label")))).select(*known.columns, "_t.*").withColumn("declared", F.col("amount"))
    sums = checks.field_sums(values.withColumnRenamed("num", "value"))
    added = checks.signed_sums(named.where("kind in ('field', 'terms')"), sums, [(n, f, sign) for n, f, sign, _ in C.terms()], "doc_id", PAIR)
    chosen = checks.any_alternative(named.where("kind = 'any'"), sums, [(n, f, at) for n, f, _, at in C.terms()], "doc_id", PAIR)
    body = F.col("id.body")
    everyone = checks.distinct_where(values.where("field = 'rut'").withColumn("body", body), ["doc_id"], "body").withColumn("only", F.lit(""))
    asked = sorted({t.where for t in C.TOTALS if t.kind == "count" and t.where})
    having = values.where(F.col("field").isin(*asked)).where("num > 0").groupBy("doc_id", F.col("field").alias("only")).agg(F.count_distinct(body).alias("n"))
    counts = everyone.select("doc_id", "only", "n").union(having.select("doc_id", "only", "n"))
    counted = named.where("kind = 'count'").select(*PAIR, F.coalesce("only", F.lit("")).alias("only")).join(counts, ["doc_id", "only"], "left").select(*PAIR, F.coalesce("n", F.lit(0)).cast("decimal(20,6)").alias("extracted"))
    got = added.withColumn("hit", F.lit(None).cast("string")).unionByName(chosen.select(*PAIR, "extracted", "hit")).unionByName(counted.withColumn("hit", F.lit(None).cast("string")))
    out = named.join(got, PAIR, "left")
    outcome = F.when(F.col("kind").isNull(), "uncompared").when(F.col("kind") == "note", "note").otherwise("compared")
    return out.select(*pairs.columns, outcome.alias("outcome"), F.coalesce("hit", "shown").alias("field"), "extracted", (F.col("extracted") == F.col("amount")).alias("ok"), "why")


def states(docs: DataFrame, compared: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, state, reasons array<string>) of documents that aren't duplicates.

    docs: doc_id, doc_ord, error, profile, score, second, second_score, ambiguous, and the arrays
    no_table, no_section (pages) and repeated (fields).
    """
    control = compared.where("outcome = 'compared'")
    says = said(REASONS["failed"], F.col("label"), shown(F.col("amount")), shown(F.col("extracted")))
    per = control.groupBy("doc_id").agg(F.count("*").alias("n_control"), F.count_if(~F.col("ok")).alias("n_failed"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct("pair_ord", says.alias("says"))))).alias("failed"))
    backed = control.select("doc_id", F.explode(F.split("field", r"[+−\s]+")).alias("field")).distinct()
    spark = docs.sparkSession
    summed = [f for f, (rule, _) in C.FIELDS.items() if rule == "sum"]
    sums = values.where(F.col("field").isin(*summed)).groupBy("doc_id", "field").agg(F.bool_or(F.col("num") != 0).alias("any_amount"))
    excused = docs.select("doc_id", "profile").join(F.broadcast(C.excused(spark)), "profile").select("doc_id", "field")
    bare = checks.unbacked_fields(sums, backed, excused).groupBy("doc_id").agg(F.sort_array(F.collect_set("field")).alias("bare"))
    all_ = docs.join(per, "doc_id", "left").join(bare, "doc_id", "left")
    listed = lambda name: F.when(F.size(name) > 0, said(REASONS[name], F.array_join(F.transform(name, lambda x: x.cast("string")), ", ")))
    ambiguous = said(REASONS["ambiguous"], *[F.col(c) for c in ("profile", "score", "second", "second_score")], C.MARGIN)
    first = F.array(F.when(F.col("ambiguous"), ambiguous), F.when(F.coalesce("n_control", F.lit(0)) == 0, REASONS["no_control"]))
    failures = F.coalesce(F.transform("failed", lambda f: f["says"]), F.array().cast("array<string>"))
    reasons = F.array_compact(F.concat(first, failures, F.array(*map(listed, ("bare", "no_table", "no_section", "repeated")))))
    failed = F.coalesce(F.col("n_failed") > 0, F.lit(False))
    error, unknown = F.col("error").isNotNull(), F.col("profile").isNull()
    state = F.when(error, checks.MISMATCH).when(unknown, checks.UNVERIFIED).otherwise(checks.state_of(failed, reasons))
    why = F.when(error, F.array(said(REASONS["error"], F.col("error")))).when(unknown, F.array(F.lit(REASONS["unknown"]))).otherwise(reasons)
    return all_.select("doc_id", state.alias("state"), why.alias("reasons"))


WARNING = "prio int, ord array<bigint>, kind string, file string, detail string"


def _warn(df: DataFrame, prio: int, kind: Column | str, detail: Column, ord_: list, file: Column | None = None, backwards: bool = False) -> DataFrame:
    sign = -1 if backwards else 1
    order = F.array(*[(sign * (F.lit(o) if isinstance(o, int) else F.col(o) if isinstance(o, str) else o)).cast("bigint") for o in ord_])
    return df.select(F.lit(prio).alias("prio"), order.alias("ord"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.col("file") if file is None else file).alias("file"), detail.alias("detail"))


def document_warnings(docs: DataFrame, columns: DataFrame, compared: DataFrame, bad_values: DataFrame) -> DataFrame:
    """What was dropped or couldn't be decided, by document. docs additionally holds file, folio,
    no_table, no_section, ambiguous_sections, repeated and the reading counts."""
    at = docs.select("doc_id", "doc_ord", "file")
    place = {name: n for n, name in enumerate(DOCUMENT)}

    def say(df, name, parts, *order):
        kind, detail = DOCUMENT[name]
        return _warn(df, 6, kind, said(detail, *parts), ["doc_ord", place[name], *order])

    def spread(name):
        return say(docs.select("doc_ord", "file", F.posexplode(name).alias("k", "x")), name, [F.col("x")], "k")

    def counted(where, name, *parts):
        return say(docs.where(where), name, map(F.col, parts))

    first = F.min(F.struct("first_page", "i")).alias("w")
    loose = columns.join(at, "doc_id").groupBy("doc_ord", "file", "label", "field", "level").agg(first)
    where = (F.col("w.first_page"), F.col("w.i"))
    left = compared.where("outcome = 'uncompared'").join(at, "doc_id")
    amount = shown(F.col("amount"))
    return reduce(
        DataFrame.unionByName,
        [
            say(loose.where("field is null"), "unmapped", [F.col("label")], *where),
            say(loose.where("level = 'hoja' and label like '% > %'"), "generic", [F.col("label")], *where),
            *map(spread, ("no_table", "no_section", "ambiguous_sections", "repeated")),
            say(bad_values.join(at, "doc_id"), "not_numeric", map(F.col, ("label", "field", "raw")), "n"),
            counted("dropped > 0", "dropped", "dropped", "read"),
            counted("outside > 0", "outside", "outside"),
            counted("colliding > 0", "colliding", "colliding"),
            counted("profile is not null and folio = ''", "no_folio"),
            say(left.where("label = ''"), "unlabelled", [amount], "pair_ord"),
            say(left.where("label <> ''"), "uncompared", [F.col("label"), amount], "pair_ord"),
            _warn(docs.where("lost > 0"), 6, LOST[0], said(LOST[1], F.col("lost")), ["doc_ord", len(place)]),
        ],
    )


def run_warnings(docs: DataFrame, states_: DataFrame, compared: DataFrame, people: DataFrame, constants: DataFrame, ignored: DataFrame) -> DataFrame:
    """Warnings of the whole run; docs includes duplicates and documents that couldn't be read.
    What is found late stands first, the last of its kind before the others."""
    at = docs.select("doc_id", "doc_ord", "file", "folio", "duplicate_of", "error", "profile")
    failed = compared.where("outcome = 'compared' and not ok").join(at, "doc_id")
    judged = states_.where(F.col("state") != checks.VERIFIED).join(at, "doc_id").withColumn("why", F.array_join("reasons", " "))
    bad = F.col("state") == checks.MISMATCH
    nobody = F.lit("")
    written = people.select("line", F.col("id.text").alias("text"), F.col("id.valid").alias("valid"), "body", "nombre")

    def say(df, prio, name, parts, *order, **options):
        kind, detail = RUN[name]
        return _warn(df, prio, kind, said(detail, *parts), list(order), **options)

    return reduce(
        DataFrame.unionByName,
        [
            say(failed, 1, "failed", [F.col("label"), *map(shown, (F.col("amount"), F.col("extracted"), F.col("extracted") - F.col("amount")))], "doc_ord", "pair_ord", backwards=True),
            say(at.where("error is not null"), 2, "error", [F.col("error")], "doc_ord", backwards=True),
            say(at.where("duplicate_of is not null"), 3, "duplicate", [F.col("folio"), F.col("duplicate_of")], "doc_ord", backwards=True),
            say(judged.where(bad), 4, "mismatch", [F.col("why")], "doc_ord", backwards=True),
            say(judged.where(~bad), 4, "unverified", [F.col("why")], "doc_ord", backwards=True),
            say(at.where("profile is null and duplicate_of is null"), 5, "unknown", [], 0, "doc_ord"),
            say(written.where("not valid"), 5, "bad_id", [F.col("text"), check_digit(F.col("body"))], 1, "line", 0, file=nobody),
            say(written.where(unfinished_name(F.col("nombre"))), 5, "unfinished", [F.col("text"), F.col("nombre")], 1, "line", 1, file=nobody),
            say(constants.where("n > 0"), 7, "constant", [F.col("n"), len(C.LAYOUT), F.col("names")], 0, file=nobody),
            say(ignored, 8, "ignored", [], "file_ord"),
        ],
    )
