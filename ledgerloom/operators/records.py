"""From table rows to typed records, and the audit of every column read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxid import tax_id, with_tax_id
from ..functions.text import norm, squish, to_number
from . import config as C
from .edges import let
from .geometry import PAGE, head
from .match import first_known

RECORD = [*PAGE, "row_no"]
SUM = "decimal(30,6)"
#: The rows of record_values that count.
USABLE = "id is not null and (num is not null or txt is not null)"


def with_fields(layouts: DataFrame) -> DataFrame:
    """layouts of geometry.columns_of, whose layout has a section, with key, field and level of every column;
    level tells whether the heading alone was enough ('hoja') or its group was used. numeric and additive are
    those of the field; where a column lies is only known by the indexes from here on. rut_at is the 0-based place of
    the tax id's column, twice tells whether two columns have one field."""
    additive = lambda f: reduce(Column.__or__, [(F.col("layout")["section"] == name) & f.isin(*own) for name, (*_, own) in C.SECTIONS.items() if own], F.lit(False))

    def told(c):
        hit = F.lit(None).cast("struct<key:string,value:string>")
        for section, table in C.labels().items():
            hit = F.when(F.col("layout")["section"] == section, first_known(c["keys"], table)).otherwise(hit)
        level = lambda k: F.when(k == norm(c["leaf"]), "hoja").when(k.isNotNull(), "ancestro")
        numeric = lambda f: F.coalesce(f.isin(*C.NUMERIC), F.lit(False))
        return let(hit, lambda h: F.struct(c["i"].alias("i"), c["label"].alias("label"), h["key"].alias("key"), h["value"].alias("field"), level(h["key"]).alias("level"), numeric(h["value"]).alias("numeric"), F.coalesce(additive(h["value"]), F.lit(False)).alias("additive")))

    fields = F.array_compact(F.transform("columns", lambda c: c["field"]))
    place = F.nullif(F.array_position(F.transform("columns", lambda c: F.coalesce(c["field"], F.lit(""))), "rut"), F.lit(0)) - 1
    return layouts.withColumn("columns", F.transform("columns", told)).withColumns({"rut_at": place.cast("int"), "twice": F.size(F.array_distinct(fields)) < F.size(fields)})


def mapped_columns(tables: DataFrame) -> DataFrame:
    """(doc_id, page, section, i, label, key, field, level) of every column."""
    columns = tables.where("path is not null").select(*PAGE, "section", F.explode("columns").alias("c"))
    return columns.select(*PAGE, "section", *[f"c.{k}" for k in ("i", "label", "key", "field", "level")])


def cell_values(tables: DataFrame) -> DataFrame:
    """(doc_id, page, row_no, section, i, label, field, raw): every value read that isn't empty, with its column."""
    own = F.transform("columns", lambda c: F.struct(c["label"].alias("label"), c["field"].alias("field")))
    slim = tables.where("path is not null").select(*PAGE, "section", own.alias("own"), "lines_read")  # ahead of the lines, so once for a page
    lines = slim.select(*PAGE, "section", "own", F.explode("lines_read").alias("l"))
    cells = lines.select(*PAGE, "section", "l.row_no", F.posexplode(F.arrays_zip("l.values", "own")).alias("i", "c"))
    values = cells.select(*PAGE, "row_no", "section", "i", "c.own.label", "c.own.field", squish(F.col("c.values")).alias("raw"))
    return values.where("raw <> ''")


def column_audit(columns: DataFrame, values: DataFrame) -> DataFrame:
    """audited() of values that only tell page and number of their column."""
    return audited(columns, values.join(columns.select(*PAGE, "i", "section", "label"), [*PAGE, "i"]))


def audited(columns: DataFrame, values: DataFrame) -> DataFrame:
    """One row for each (doc_id, section, i, label): the key and field it got, its pages, how
    many rows had a value and what the numeric ones add up to."""
    one = ["doc_id", "section", "i", "label"]
    per = values.groupBy(*one).agg(F.count("*").alias("n"), F.sum(to_number(F.col("raw"))).alias("s"))
    place = F.min_by(F.struct("key", "level", "field"), "page").alias("used")
    places = columns.groupBy(*one).agg(place, F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return places.join(per, one, "left").select(*one, "used.*", "first_page", "last_page", zero("n").alias("with_value"), zero("s").cast("decimal(20,6)").alias("total"))


def typed_values(values: DataFrame) -> DataFrame:
    """(record, section, i, field, label, raw, numeric, num): the values of mapped columns; num is null
    for text fields and for what isn't a number."""
    numeric = F.col("field").isin(*C.NUMERIC)
    return values.where("field is not null").withColumn("numeric", numeric).withColumn("num", F.when(numeric, to_number(F.col("raw"))))


def unread_values(tables: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, page, row_no, i, label, field, raw): what stands in a numeric column and is no number. values are the
    record_values, all of them: a page without one that lacks its value has nothing unread, but where two columns have
    one field, which are folded, values don't tell."""
    lacking = values.where("num is null and txt is null").select(*PAGE).distinct()
    looked = tables.where("twice").unionByName(tables.where("not twice").join(lacking, PAGE, "left_semi"))
    return typed_values(cell_values(looked)).where("numeric and num is null").select(*RECORD, "i", "label", "field", "raw")


def record_values(tables: DataFrame) -> DataFrame:
    """(record, id, field, num, txt, repeated): values by record and field. Numbers in several
    columns of one field add up, of text the first counts; repeated marks a numeric field that
    was fed twice though its section doesn't declare it. Records without a tax id have no id, and what isn't there or
    can't be read is null: USABLE leaves both out. A filter in here would be planned ahead of what it looks at, and
    that worked out twice, so it is for the written table.

    A record is a line of a page, so it is folded where it lies, without a shuffle; where every field has one column,
    its values are those of the line.
    """
    return _values_once(tables.where("path is not null and not twice")).unionByName(_values_folded(tables.where("path is not null and twice")))


def _values_once(tables: DataFrame) -> DataFrame:
    # steps of their own: what a line's values need of its columns is found once for a page, and texts once for a value
    fields = F.filter(F.transform("columns", lambda c, i: F.struct(i.alias("i"), c["field"].alias("field"), c["numeric"].alias("numeric"))), lambda c: c["field"].isNotNull())
    lines = tables.select(*PAGE, fields.alias("own"), "rut_at", "lines_read").select(*PAGE, "own", "rut_at", F.explode("lines_read").alias("l"))
    named = lines.select(*PAGE, "l.row_no", "own", "l.values", squish(F.get("l.values", F.col("rut_at"))).alias("_rut"))
    each = with_tax_id(named, "_rut", "id").select(*RECORD, "id", "values", F.explode("own").alias("c"))
    read = each.select(*RECORD, "id", "c.field", "c.numeric", squish(F.get("values", F.col("c.i"))).alias("raw"))
    num, txt = F.when(F.col("numeric"), to_number(F.col("raw"))).cast(SUM), F.when(~F.col("numeric"), F.nullif("raw", F.lit("")))
    return read.select(*RECORD, "field", num.alias("num"), txt.alias("txt"), F.lit(False).alias("repeated"), "id")


def _values_folded(tables: DataFrame) -> DataFrame:
    lines = tables.select(*PAGE, "columns", F.explode("lines_read").alias("l"))

    def value(c, i):
        raw = squish(F.get(F.col("l")["values"], i))
        return let(raw, lambda raw: F.struct(c["field"].alias("field"), c["numeric"].alias("numeric"), c["additive"].alias("additive"), raw.alias("raw"), F.when(c["numeric"], to_number(raw)).alias("num")))

    usable = F.filter(F.transform("columns", value), lambda v: v["field"].isNotNull() & (v["raw"] != "") & (~v["numeric"] | v["num"].isNotNull()))
    text = lambda v: F.when(~v["numeric"], v["raw"])
    folded = lambda v, num, repeated: F.struct(v["field"].alias("field"), num.cast(SUM).alias("num"), text(v).alias("txt"), repeated.alias("repeated"))

    def several(vs, f):
        own = F.filter(vs, lambda v: v["field"] == f)
        added = lambda own: F.when(head(own)["numeric"], F.aggregate(own, F.lit(0).cast(SUM), lambda s, v: (s + v["num"]).cast(SUM)))
        return let(own, lambda own: folded(head(own), added(own), F.forall(own, lambda v: v["numeric"] & ~v["additive"]) & (F.size(own) > 1)))

    def fold(vs):
        fields = F.array_distinct(F.transform(vs, lambda v: v["field"]))
        each = F.transform(vs, lambda v: folded(v, v["num"], F.lit(False)))
        return F.when(F.size(fields) == F.size(vs), each).otherwise(F.transform(fields, lambda f: several(vs, f)))

    whole = lines.select(*PAGE, "l.row_no", let(usable, fold).alias("values"))
    own = whole.withColumn("_own", head(F.filter("values", lambda v: v["field"] == "rut"))["txt"]).withColumn("id", tax_id(F.col("_own")))
    return own.select(*RECORD, "id", F.inline("values")).select(*RECORD, "field", "num", "txt", "repeated", "id")
