"""What keeps the work of larger tables in proportion: values folded where they lie, and rows that move once."""

from ledgerloom.functions import taxid
from ledgerloom.operators import checks, cover, merge, records
from ledgerloom.plans import cuts, ledger
from pyspark.sql import functions as F

from . import vouchers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_folded_without_a_shuffle(spark):
    """F2-F5: a record is a line of one page; the values of a line never leave its task."""
    run = ledger.process(*vouchers.build(spark, vouchers.sample()))
    assert "Exchange" not in plan(records.record_values(run.tables))
    run.release()


def test_two_columns_of_one_field_are_folded(spark):
    column = lambda i, field, numeric, additive=False: (i, f"c{i}", field, field, "hoja", numeric, additive)
    columns = [column(0, "rut", False), column(1, "impAfp", True), column(2, "nombre", False), column(3, "impAfp", True), column(4, "nombre", False), column(5, None, False)]
    kind = "doc_id string, page int, path string, twice boolean, rut_at int, columns array<struct<i:int,label:string,key:string,field:string,level:string,numeric:boolean,additive:boolean>>, lines_read array<struct<row_no:int,values:array<string>>>"
    lines = [(1, ["9.068.054-4", "1.000", "", "2", "ANA", "x"]), (2, ["9.068.054-4", "zz", "EVA", "5", "", ""]), (3, ["nobody", "7", "EVA", "5", "", ""])]
    once = [column(0, "nombre", False), column(1, "rut", False), column(2, "impAfp", True)]
    tables = spark.createDataFrame([("a", 2, "rayado", True, 0, columns, lines), ("b", 2, "rayado", False, 1, once, [(1, ["EVA", "9.068.054-4", "3"]), (2, ["EVA", "", "3"])])], kind)
    got = records.record_values(tables).where(records.USABLE).collect()
    shown = sorted((r["doc_id"], r["row_no"], r["field"], None if r["num"] is None else int(r["num"]), r["txt"], r["repeated"]) for r in got)
    assert shown == [
        ("a", 1, "impAfp", 1002, None, True), ("a", 1, "nombre", None, "ANA", False), ("a", 1, "rut", None, "9.068.054-4", False),
        ("a", 2, "impAfp", 5, None, False), ("a", 2, "nombre", None, "EVA", False), ("a", 2, "rut", None, "9.068.054-4", False),
        ("b", 1, "impAfp", 3, None, False), ("b", 1, "nombre", None, "EVA", False), ("b", 1, "rut", None, "9.068.054-4", False),
    ]
    assert {r["id"]["body"] for r in got} == {"9068054"}


def test_fields_merge_like_rows(spark):
    """Each value meets the rule of its own field only, with the results of merge_rows."""
    fields = dict(zip("abcdef", merge.RULES))
    rows = spark.range(200).select((F.col("id") % 7).alias("k"), F.col("id").alias("at"), *[(F.when(F.col("id") % 3 != 0, (F.col("id") * 37 % 11 - 5)).cast("decimal(20,6)")).alias(c) for c in "ab"],
        *[F.when(F.col("id") % 4 != n, F.concat_ws("/", F.lpad((F.col("id") * 13 % 28 + 1).cast("string"), 2, "0"), F.lit("07"), F.when(F.col("id") % 5 == 0, "x").otherwise("2026"))).alias(c) for n, c in enumerate("cdef")])
    long = rows.select("k", "at", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("num") if f in "ab" else F.lit(None).cast("decimal(20,6)").alias("num"), F.lit(None).cast("string").alias("txt") if f in "ab" else F.col(f).alias("txt")) for f in fields])))
    left, right = merge.merged_fields(long, ["k"], fields, ["at"]), merge.merge_rows(rows, ["k"], fields, ["at"])
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, right.select(*left.columns).collect()))


def test_sums_of_columns_move_as_one_row(spark):
    """sums of a document's columns are one row of a shuffle, with the results of field_sums."""
    rows = spark.range(60).select((F.col("id") % 5).alias("doc_id"), *[F.when(F.col("id") % 5 != n, F.col("id") + n).cast("decimal(20,6)").alias(c) for n, c in enumerate("xyz")])
    wide = checks.column_sums(rows, ["x", "y", "z"])
    long = checks.field_sums(merge.long_values(rows, ["doc_id"], ["x", "y", "z"]))
    key = lambda r: (r["doc_id"], r["field"])
    assert [tuple(r) for r in sorted(wide.collect(), key=key)] == [tuple(r) for r in sorted(long.collect(), key=key)]
    assert "field" not in plan(wide).split("Exchange hashpartitioning(")[1].split(")")[0]


def test_later_pages_are_only_read_where_a_month_is_missing(spark):
    """the text of a later page is not even worked out where the first page has the month."""
    found = ledger.process(*vouchers.build(spark, vouchers.sample())).pages
    found = found.join(found.where("page = 1 and lines like '%Remuneraciones: 0%'").select("doc_id"), "doc_id", "left_semi")
    assert found.where("page > 1").count()
    late = found.withColumn("lines", F.when(F.col("page") > 1, F.raise_error(F.lit("read"))).otherwise(F.col("lines")))
    assert all(r["period"] for r in cover.covers(late, cuts.cut).collect())


def test_months_of_later_pages_are_found(spark):
    found = ledger.process(*vouchers.build(spark, vouchers.sample())).pages
    text = F.lit("Período de Remuneraciones: ")
    moved = found.withColumn("lines", F.when(F.col("page") > 1, F.concat(text, F.lpad(F.col("page").cast("string"), 2, "0"), F.lit("/2026"))).otherwise("none"))
    many = {r["doc_id"] for r in found.where("page = 2").select("doc_id").collect()}
    assert many and {r["doc_id"]: r["period"] and r["period"]["text"] for r in cover.covers(moved, cuts.cut).collect()} == {r["doc_id"]: "02/2026" if r["doc_id"] in many else None for r in found.select("doc_id").distinct().collect()}


def test_bands_do_not_move_with_pages(spark):
    """what is written of a page names its drawing; the bands are written once for all pages of a form."""
    run = ledger.process(*vouchers.build(spark, vouchers.sample()))
    run.pages  # noqa: B018
    kinds = [spark.read.parquet(path).columns for path in run._made]
    assert [k for k in kinds if "rows" in k] == [["doc_id", "page", "rows", "drawing", "title", "front"]]
    run.release()


def test_ids_by_steps_are_those_of_one_expression(spark):
    """check digits of short bodies come from the number; longer bodies and other texts as before."""
    bodies = ["7", "61313000", "9068054", "123456789012", "1234567890123", "999999999999", "000000000001", "", None]
    plain = lambda b: "0K987654321"[sum(int(c) * (i % 6 + 2) for i, c in enumerate(reversed(b))) % 11]
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", taxid.check_digit(F.col("b")).alias("d")).collect()
    assert {r["b"]: r["d"] for r in got} == {b: None if b is None else plain(b) for b in bodies}
    texts = ["9.068.054-4", " 9.068.054-4 ", "9.068.054-K", "61.313.000-k", "9068054-4", "x", "", None, "1-9"]
    rows = taxid.with_tax_id(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "a").withColumn("b", taxid.tax_id(F.col("t")))
    assert all(r["a"] == r["b"] for r in rows.collect()) and rows.where("a is not null").count() == 5


def test_unread_values_are_those_of_all_cells(spark):
    """only pages with a value that lacks are looked at again; also pages whose columns share a field."""
    column = lambda i, field, numeric: (i, f"c{i}", field, field, "hoja", numeric, False)
    columns = [column(0, "rut", False), column(1, "impAfp", True), column(2, "nombre", False)]
    kind = "doc_id string, page int, section string, path string, twice boolean, rut_at int, columns array<struct<i:int,label:string,key:string,field:string,level:string,numeric:boolean,additive:boolean>>, lines_read array<struct<row_no:int,values:array<string>>>"
    lines = [(1, ["9.068.054-4", "zz", "EVA"]), (2, ["nobody", " y  y", ""]), (3, ["9.068.054-4", "", "EVA"])]
    fine = [(1, ["9.068.054-4", "1.000", "EVA"])]
    tables = spark.createDataFrame([("a", 2, "s", "rayado", False, 0, columns, lines), ("b", 2, "s", "rayado", False, 0, columns, fine), ("c", 2, "s", "rayado", True, 0, [*columns[:2], column(2, "impAfp", True)], lines), ("d", 2, None, None, None, None, None, None)], kind)
    want = records.typed_values(records.cell_values(tables)).where("numeric and num is null").select("doc_id", "page", "row_no", "i", "label", "field", "raw")
    got = records.unread_values(tables, records.record_values(tables))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["raw"] for r in got.collect()} == {"zz", "y y", "EVA"}


def test_small_tables_are_numbered_in_few_partitions(spark):
    """F8, F9: keys that are sampled and tasks that report to the driver grow with the rows, not with the session's partitions."""
    got = cuts.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), [F.col("k")])
    assert len([f for f in got.inputFiles()]) == 1
    assert all(r["line"] == r["k"] + 1 for r in got.collect())
