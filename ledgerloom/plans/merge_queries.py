"""Queries over merging, folding, projection and first-occurrence rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.merge import first_where, fold_repeated, kinds_of, long_values, merge_rows
from .catalogue import query, table
from .cuts import numbered
from .ledger import mark_duplicates

ORDER = ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FIELDS = {"amount": "sum", "days": "max", "movement": "first", "since": "earliest", "until": "latest", "name": "longest"}


def voucher_lines(spark, sf):
    """orders, lineitem and part as voucher lines; the customer stands for the person."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    day = F.date_format("l_shipdate", "dd/MM/yyyy")
    return lines.select(
        F.col("o_custkey").alias("person"), *ORDER,
        F.col("l_extendedprice").cast("decimal(20,6)").alias("amount"), F.col("l_quantity").cast("decimal(20,6)").alias("days"),
        F.col("l_returnflag").alias("movement"), day.alias("since"), day.alias("until"), F.col("p_name").alias("name"), F.col("o_orderstatus").alias("kind"),
    )


_LINES = """SELECT o_custkey AS person, o_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(20,2)) AS amount, l_quantity AS days, l_returnflag AS movement,
  strftime(l_shipdate, '%d/%m/%Y') AS since, CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS k, p_name AS name, o_orderstatus AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
_UP, _DOWN = "[o_orderkey, l_linenumber, l_partkey, l_suppkey]", "[-o_orderkey, -l_linenumber, -l_partkey, -l_suppkey]"


@query(f"""SELECT person, CAST(sum(amount) AS DOUBLE) AS amount, CAST(greatest(max(days), 0) AS DOUBLE) AS days, arg_min(movement, {_UP}) AS movement,
  arg_min(since, [k, o_orderkey, l_linenumber, l_partkey, l_suppkey]) AS since, arg_max(since, [k, -o_orderkey, -l_linenumber, -l_partkey, -l_suppkey]) AS until,
  arg_max(name, [length(name), -o_orderkey, -l_linenumber, -l_partkey, -l_suppkey]) AS name, count(*) AS lines FROM ({_LINES}) GROUP BY person""")
def merge_by_key(spark, sf):
    out = merge_rows(voucher_lines(spark, sf), ["person"], FIELDS, ORDER, (F.count("*").alias("lines"),))
    return out.withColumns({"amount": F.col("amount").cast("double"), "days": F.col("days").cast("double")})


@query(f"""SELECT person, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, CAST(count(DISTINCT kind) AS BIGINT) AS n_kinds, count(*) AS lines,
  arg_min(since, {_UP}) FILTER (WHERE kind = 'F') AS first_f FROM ({_LINES}) GROUP BY person""")
def merge_provenance(spark, sf):
    kind = F.col("kind")
    return voucher_lines(spark, sf).groupBy("person").agg(
        F.array_join(kinds_of(kind), ",").alias("kinds"), F.count_distinct("kind").alias("n_kinds"), F.count("*").alias("lines"),
        first_where(F.col("since"), kind == "F", [F.col(c) for c in ORDER]).alias("first_f"),
    )


@query("""WITH v AS (SELECT l_orderkey, CASE WHEN l_linenumber <= 2 THEN 'base' WHEN l_linenumber = 3 THEN 'fee' ELSE 'other' END AS field, CAST(l_extendedprice AS DECIMAL(20,2)) AS value FROM lineitem)
SELECT l_orderkey, field, CAST(sum(value) AS DOUBLE) AS value, count(*) AS n, count(*) > 1 AND field <> 'base' AS repeated FROM v GROUP BY l_orderkey, field""")
def prefold_accumulate(spark, sf):
    field = F.when(F.col("l_linenumber") <= 2, "base").when(F.col("l_linenumber") == 3, "fee").otherwise("other")
    values = table(spark, sf, "lineitem").select("l_orderkey", field.alias("field"), F.col("l_extendedprice").cast("decimal(20,6)").alias("value"))
    return fold_repeated(values, ["l_orderkey"], ("base",)).withColumn("value", F.col("value").cast("double"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, field, CAST(value AS DOUBLE) AS value FROM
  (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(20,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(20,2)) AS price, CAST(l_tax AS DECIMAL(20,2)) AS tax FROM lineitem)
  UNPIVOT (value FOR field IN (quantity, price, tax))""")
def unpivoted_fields(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnsRenamed({"l_quantity": "quantity", "l_extendedprice": "price", "l_tax": "tax"})
    return long_values(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["quantity", "price", "tax"], "decimal(20,2)").withColumn("value", F.col("value").cast("double"))


@query("""SELECT CAST(row_number() OVER (ORDER BY c_name, c_custkey) AS INTEGER) AS line, c_custkey, c_name, '1' AS payment, '00' AS line_kind, CAST(coalesce(spent, 0) AS DOUBLE) AS spent, coalesce(first_status, '') AS first_status
  FROM customer LEFT JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(20,2))) AS spent, arg_min(o_orderstatus, o_orderkey) AS first_status FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def ledger_projection(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).alias("spent"), F.min_by("o_orderstatus", "o_orderkey").alias("first_status"))
    rows = table(spark, sf, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    # a ledger numbers its lines from 1 in one sequence: one row for each person, after the merge
    rows = numbered(rows, [F.collate(F.coalesce("c_name", F.lit("")), "es"), F.col("c_custkey")])
    return rows.select(F.col("line").cast("int").alias("line"), "c_custkey", "c_name", F.lit("1").alias("payment"), F.lit("00").alias("line_kind"), F.coalesce(F.col("spent").cast("double"), F.lit(0.0)).alias("spent"), F.coalesce("first_status", F.lit("")).alias("first_status"))


@query("""SELECT doc_id, CASE WHEN row_number() OVER w > 1 THEN first_value(doc_id) OVER w END AS duplicate_of FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY doc_id)""")
def dedup_first(spark, sf):
    """Documents as vouchers: the digest of the text is the folio."""
    text = F.col("text")
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("doc_ord"), F.col("doc_id").cast("string").alias("file"), F.lit("i").alias("institution"), F.coalesce(F.md5(text), F.lit("none")).alias("folio"), F.struct(F.lit("07/2026").alias("text")).alias("period"))
    return mark_duplicates(docs).select("doc_id", F.col("duplicate_of").cast("long").alias("duplicate_of"))
