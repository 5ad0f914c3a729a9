"""Queries over reconciliation: declared totals, states and what backs them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from ..operators.merge import long_values
from .catalogue import query, table

MONEY = "decimal(20,6)"


FIELDS = ["extendedprice", "quantity", "tax", "discount"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_partkey", *[F.col(f"l_{f}").cast("decimal(20,2)").alias(f) for f in FIELDS])


def _values(spark, sf):
    return long_values(_lines(spark, sf), ["doc_id", "l_partkey"], FIELDS, "decimal(20,2)").withColumn("value", F.col("value").cast(MONEY))


def _declared(spark, sf):
    """A declared total for each order: what its lines add up to, one more for every fifth, none for every seventh."""
    total = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).cast(MONEY).alias("t"))
    return total.where("l_orderkey % 7 <> 0").select(F.col("l_orderkey").alias("doc_id"), (F.col("t") + F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)).cast(MONEY).alias("declared"))


_DECLARED = "SELECT l_orderkey AS doc_id, sum(CAST(l_extendedprice AS DECIMAL(20,2))) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS declared, sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS extracted FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY l_orderkey"


@query(f"SELECT doc_id, CAST(declared AS DOUBLE) AS declared, CAST(extracted AS DOUBLE) AS extracted, declared = extracted AS ok FROM ({_DECLARED})")
def control_totals(spark, sf):
    sums = checks.field_sums(_values(spark, sf)).where("field = 'extendedprice'")
    both = _declared(spark, sf).join(sums, "doc_id")
    return both.select("doc_id", F.col("declared").cast("double").alias("declared"), F.col("total").cast("double").alias("extracted"), (F.col("declared") == F.col("total")).alias("ok"))


@query("""SELECT l_orderkey AS doc_id, name, CAST(CASE name WHEN 'net' THEN sum(CAST(l_extendedprice AS DECIMAL(20,2))) - sum(CAST(l_tax AS DECIMAL(20,2))) - sum(CAST(l_discount AS DECIMAL(20,2)))
  ELSE sum(CAST(l_quantity AS DECIMAL(20,2))) + sum(CAST(l_tax AS DECIMAL(20,2))) END AS DOUBLE) AS extracted FROM lineitem, (VALUES ('net'), ('mass')) AS n(name) GROUP BY l_orderkey, name""")
def sum_minus(spark, sf):
    terms = [("net", "extendedprice", 1), ("net", "tax", -1), ("net", "discount", -1), ("mass", "quantity", 1), ("mass", "tax", 1), ("mass", "unheard_of", 1)]
    sums = checks.column_sums(_lines(spark, sf).withColumns({f: F.col(f).cast(MONEY) for f in FIELDS}), FIELDS)
    pairs = sums.select("doc_id").distinct().withColumn("name", F.explode(F.array(F.lit("net"), F.lit("mass"))))
    return checks.signed_sums(pairs, sums, terms, "doc_id", ["doc_id", "name"]).withColumn("extracted", F.col("extracted").cast("double"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS everyone, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 200000) AS n FROM orders GROUP BY o_orderstatus")
def distinct_where(spark, sf):
    o = table(spark, sf, "orders")
    every = checks.distinct_where(o, ["o_orderstatus"], "o_custkey").withColumnRenamed("n", "everyone")
    return every.join(checks.distinct_where(o, ["o_orderstatus"], "o_custkey", F.col("o_totalprice") > 200000), "o_orderstatus")


@query(f"""WITH d AS ({_DECLARED}), q AS (SELECT l_orderkey AS doc_id, sum(CAST(l_quantity AS DECIMAL(20,2))) AS quantity FROM lineitem GROUP BY 1)
SELECT doc_id, CASE WHEN quantity = declared THEN 'quantity' WHEN extracted = declared THEN 'extendedprice' END AS hit,
  CAST(CASE WHEN quantity = declared OR extracted = declared THEN declared ELSE quantity END AS DOUBLE) AS extracted FROM d JOIN q USING (doc_id)""")
def any_alternative(spark, sf):
    options = [("total", "quantity", 0), ("total", "extendedprice", 1)]
    pairs = _declared(spark, sf).withColumn("name", F.lit("total"))
    return checks.any_alternative(pairs, checks.field_sums(_values(spark, sf)), options, "doc_id", ["doc_id"]).withColumn("extracted", F.col("extracted").cast("double"))


@query(f"""SELECT o_orderkey AS doc_id, CASE WHEN declared <> extracted THEN 'no cuadra' WHEN declared IS NULL OR o_orderstatus = 'P' THEN 'sin verificar' ELSE 'verificado' END AS state,
  concat_ws(' ', CASE WHEN declared IS NULL THEN 'no total' END, CASE WHEN declared <> extracted THEN 'mismatch' END, CASE WHEN o_orderstatus = 'P' THEN 'pages' END) AS reasons
  FROM orders LEFT JOIN ({_DECLARED}) ON o_orderkey = doc_id""")
def tri_state_status(spark, sf):
    sums = checks.field_sums(_values(spark, sf)).where("field = 'extendedprice'").select("doc_id", "total")
    compared = _declared(spark, sf).join(sums, "doc_id")
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus").join(compared, "doc_id", "left")
    failed = F.coalesce(F.col("declared") != F.col("total"), F.lit(False))
    reasons = F.array_compact(F.array(F.when(F.col("declared").isNull(), "no total"), F.when(failed, "mismatch"), F.when(F.col("o_orderstatus") == "P", "pages")))
    return docs.select("doc_id", checks.state_of(failed, reasons).alias("state"), F.array_join(reasons, " ").alias("reasons"))


@query(f"""WITH s AS (SELECT o_custkey, CASE WHEN declared <> extracted THEN 2 WHEN declared IS NULL OR o_orderstatus = 'P' THEN 1 ELSE 0 END AS s FROM orders LEFT JOIN ({_DECLARED}) ON o_orderkey = doc_id)
SELECT o_custkey, (['verificado', 'sin verificar', 'no cuadra'])[max(s) + 1] AS state FROM s GROUP BY o_custkey""")
def worst_status(spark, sf):
    docs = tri_state_status(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey"), "doc_id")
    return docs.groupBy("o_custkey").agg(checks.worst(F.col("state")).alias("state"))


@query("""WITH v AS (SELECT l_orderkey AS doc_id, field, bool_or(value <> 0) AS any_amount FROM (SELECT l_orderkey, l_extendedprice, l_quantity, l_tax, l_discount FROM lineitem) UNPIVOT (value FOR field IN (l_extendedprice, l_quantity, l_tax, l_discount)) GROUP BY ALL)
SELECT doc_id, replace(field, 'l_', '') AS field FROM v WHERE any_amount AND field NOT IN ('l_quantity') AND NOT (field = 'l_extendedprice' AND doc_id % 7 <> 0)""")
def unbacked_fields(spark, sf):
    values = _values(spark, sf)
    sums = values.groupBy("doc_id", "field").agg(F.bool_or(F.col("value") != 0).alias("any_amount"))
    backed = _declared(spark, sf).select("doc_id", F.lit("extendedprice").alias("field"))
    excused = sums.where("field = 'quantity'").select("doc_id", "field")
    return checks.unbacked_fields(sums, backed, excused)


@query(f"""SELECT o_orderstatus, count(*) AS pairs, count(declared) AS compared, count(*) FILTER (WHERE declared IS NULL AND o_orderkey % 2 = 0) AS informative, count(*) FILTER (WHERE declared IS NULL AND o_orderkey % 2 = 1) AS uncompared
  FROM orders LEFT JOIN ({_DECLARED}) ON o_orderkey = doc_id GROUP BY o_orderstatus""")
def coverage_counts(spark, sf):
    docs = table(spark, sf, "orders").join(_declared(spark, sf), F.col("o_orderkey") == F.col("doc_id"), "left")
    outcome = F.when(F.col("declared").isNotNull(), "compared").when(F.col("o_orderkey") % 2 == 0, "note").otherwise("uncompared")
    got = checks.coverage(docs.withColumn("outcome", outcome), ["o_orderstatus"])
    return got.withColumnsRenamed({"n_pairs": "pairs", "n_compared": "compared", "n_note": "informative", "n_uncompared": "uncompared"})
