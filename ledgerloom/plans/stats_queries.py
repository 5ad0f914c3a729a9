"""Queries over profiles, overlap, coverage, reconciliation and differences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import printed
from ..operators import records, stats, trees
from ..sources.archive import junk
from .catalogue import query, table


@query("""SELECT l_returnflag AS section, l_linenumber AS i, CAST(count(*) FILTER (WHERE l_tax > 0) AS BIGINT) AS with_value, CAST(sum(CAST(l_tax AS DECIMAL(20,2))) AS DOUBLE) AS total, CAST(min(l_partkey) AS BIGINT) AS first_page, CAST(max(l_partkey) AS BIGINT) AS last_page FROM lineitem GROUP BY ALL""")
def column_audit(spark, sf):
    """A section is a document, a part a page, a line number a column, a tax what stands in it."""
    page = [F.col("l_returnflag").alias("doc_id"), F.col("l_partkey").alias("page")]
    lines, i = table(spark, sf, "lineitem"), F.col("l_linenumber").alias("i")
    none = F.lit(None).cast("string")
    columns = lines.select(*page, i, F.col("l_returnflag").alias("section"), F.lit("tax").alias("label"), none.alias("key"), none.alias("level"), none.alias("field")).distinct()
    values = lines.where("l_tax > 0").select(*page, i, printed(F.col("l_tax").cast("decimal(20,2)"), 2).alias("raw"))
    return records.column_audit(columns, values).select("section", "i", "with_value", F.col("total").cast("double").alias("total"), "first_page", "last_page")


@query("""SELECT count(DISTINCT coalesce(n_name, '')) <= 1 AS n_name, count(DISTINCT n_regionkey) <= 1 AS n_regionkey, true AS always, true AS never FROM nation""")
def constant_columns(spark, sf):
    rows = table(spark, sf, "nation").withColumn("always", F.lit("x")).withColumn("never", F.lit(None).cast("string"))
    return stats.constant_columns(rows, ["n_name", "n_regionkey", "always", "never"])


@query("""SELECT 'c_nationkey' AS name, count(DISTINCT c_nationkey) AS "distinct", CAST(sum(c_nationkey) AS DOUBLE) AS total FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), CAST(0 AS DOUBLE) FROM customer
  UNION ALL SELECT 'balance', count(DISTINCT CAST(c_acctbal AS DECIMAL(20,2))), CAST(sum(CAST(c_acctbal AS DECIMAL(20,2))) AS DOUBLE) FROM customer""")
def column_profile(spark, sf):
    rows = table(spark, sf, "customer").withColumn("balance", F.col("c_acctbal").cast("decimal(20,2)"))
    return stats.column_profile(rows, ["c_nationkey", "c_mktsegment", "balance"]).withColumn("total", F.col("total").cast("double"))


@query("""SELECT o_orderstatus AS doc, field, count(*) FILTER (WHERE v <> 0) AS with_value, CAST(sum(v) AS DOUBLE) AS total FROM (SELECT o_orderstatus, CAST(l_tax AS DECIMAL(20,2)) AS tax, CAST(l_discount AS DECIMAL(20,2)) AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey) UNPIVOT (v FOR field IN (tax, discount)) GROUP BY ALL""")
def field_profile(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    wide = rows.select(F.col("o_orderstatus").alias("doc"), F.col("l_tax").cast("decimal(20,2)").alias("tax"), F.col("l_discount").cast("decimal(20,2)").alias("discount"))
    long = wide.unpivot(["doc"], ["tax", "discount"], "field", "v")
    return stats.field_profile(long, ["doc", "field"], F.col("v") != 0, F.col("v")).withColumn("total", F.col("total").cast("double"))


@query("""WITH r AS (SELECT event_type, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)
SELECT event_type, count(*) AS "count", min(event_id) AS first_id, string_agg(CAST(user_id AS VARCHAR), '|' ORDER BY event_id) FILTER (WHERE n <= 8) AS details FROM r GROUP BY event_type""")
def warning_histogram_topk(spark, sf):
    return stats.histogram_with_details(table(spark, sf, "events"), "event_type", "user_id", ["event_id"]).select("event_type", "count", F.col("first.event_id").alias("first_id"), "details")


@query("""WITH s AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS a, bool_or(o_orderstatus = 'O') AS b, bool_or(o_orderstatus <> 'F') AS other FROM orders GROUP BY 1)
SELECT count(*) AS everyone, count(*) FILTER (WHERE a AND NOT other) AS only_first, count(*) FILTER (WHERE a AND b) AS in_both FROM s""")
def population_overlap(spark, sf):
    return stats.overlap(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "F", "O")


@query("""SELECT 'union' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'both', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'first', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def population_sets(spark, sf):
    return stats.population_sets(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "F", "P")


@query("""WITH can AS (SELECT n_regionkey AS source, n_name AS item FROM nation), present AS (SELECT DISTINCT n_regionkey AS source FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 2), filled AS (SELECT DISTINCT n_name AS item FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 = 0)
SELECT CAST(source AS INTEGER) AS source, string_agg(item, ',' ORDER BY item) AS items FROM can WHERE item NOT IN (SELECT item FROM filled) AND source NOT IN (SELECT source FROM present) GROUP BY source""")
def coverage_missing(spark, sf):
    nation = table(spark, sf, "nation")
    can = nation.select(F.col("n_regionkey").alias("source"), F.col("n_name").alias("item"))
    present = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).where("n_regionkey < 2").select(F.col("n_regionkey").alias("source")).distinct()
    filled = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).where("n_nationkey % 3 = 0").select(F.col("n_name").alias("item")).distinct()
    return stats.missing_coverage(can, present, filled)


@query("""WITH a AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(20,2))) AS spent, count(*) AS orders FROM orders GROUP BY 1),
b AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(20,2))) + CASE WHEN o_custkey % 10 = 0 THEN 5 ELSE 0 END AS spent, count(*) AS orders FROM orders GROUP BY 1),
j AS (SELECT o_custkey, a.spent AS s1, b.spent AS s2, a.orders AS o1, b.orders AS o2 FROM a JOIN b USING (o_custkey))
SELECT 'spent' AS field, count(*) AS compared, count(*) FILTER (WHERE s1 <> s2) AS different, min(o_custkey) FILTER (WHERE s1 <> s2) AS example FROM j UNION ALL SELECT 'orders', count(*), count(*) FILTER (WHERE o1 <> o2), min(o_custkey) FILTER (WHERE o1 <> o2) FROM j""")
def manual_reconcile(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).alias("spent"), F.count("*").alias("orders"))
    theirs = per.withColumn("spent", F.col("spent") + F.when(F.col("o_custkey") % 10 == 0, 5).otherwise(0))
    return stats.reconcile(per, theirs, "o_custkey", ["spent", "orders"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def without_partner(spark, sf):
    partners = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return stats.without_partner(table(spark, sf, "customer").select("c_custkey"), partners, "c_custkey")


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE short) AS shorter FROM (SELECT length(p_name) > length(mine) AND starts_with(p_name, mine) AS short FROM (SELECT p_name, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS mine FROM part))""")
def short_name_prefix(spark, sf):
    part = table(spark, sf, "part")
    mine = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_name")).alias("p_name"))
    return stats.cut_names(mine, part, "p_partkey", "p_name")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '\+1 \(\d{3}\) \d{3}-\d{4}')) AS BIGINT) AS hits FROM documents")
def privacy_scan(spark, sf):
    return stats.privacy_hits(table(spark, sf, "documents"), "doc_id", "text", r"\+1 \(\d{3}\) \d{3}-\d{4}")


@query("""WITH n AS (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events), p AS (SELECT user_id, n, unnest(json_keys(props)) AS path, props FROM n),
v AS (SELECT user_id, n // 2 AS k, n % 2 AS side, path, json_extract_string(props, '$.' || path) AS value FROM p),
e AS (SELECT user_id, k, path, value FROM v WHERE side = 0), a AS (SELECT user_id, k, path, value FROM v WHERE side = 1)
SELECT user_id, CAST(k AS BIGINT) AS k, path, CASE WHEN e.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'absent' ELSE 'changed' END AS kind, e.value AS expected, a.value AS actual FROM e FULL JOIN a USING (user_id, k, path) WHERE e.k IS NULL OR a.k IS NULL OR e.value IS DISTINCT FROM a.value""")
def fixture_diff(spark, sf):
    """Every event: of each user's events the first, third, ... are expected, those after them actual."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    v = table(spark, sf, "events").select("user_id", n.cast("long").alias("n"), F.explode(stats.flat_json(F.col("props"))).alias("e")).select("user_id", F.expr("n div 2").alias("k"), (F.col("n") % 2).alias("side"), "e.path", "e.value")
    return stats.differences(v.where("side = 0"), v.where("side = 1"), ["user_id", "k"])


@query("""WITH p AS (SELECT event_id, unnest(json_keys(props)) AS path, props FROM events), v AS (SELECT event_id // 2 AS k, event_id % 2 AS side, path, json_extract_string(props, '$.' || path) AS value FROM p),
e AS (SELECT k, path, value FROM v WHERE side = 0), a AS (SELECT k, path, value FROM v WHERE side = 1)
SELECT k, path, CASE WHEN e.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'absent' ELSE 'changed' END AS kind, e.value AS expected, a.value AS actual FROM e FULL JOIN a USING (k, path) WHERE e.k IS NULL OR a.k IS NULL OR e.value IS DISTINCT FROM a.value""")
def fixture_diff_all(spark, sf):
    """Every event: 2k is expected, 2k + 1 is actual."""
    v = table(spark, sf, "events").select(F.expr("event_id div 2").alias("k"), (F.col("event_id") % 2).alias("side"), F.explode(stats.flat_json(F.col("props"))).alias("e")).select("k", "side", "e.path", "e.value")
    return stats.differences(v.where("side = 0"), v.where("side = 1"), ["k"])


_TAG = "CASE {t}.n % 3 WHEN 0 THEN '{{\"k\":' || {t}.n % 5 || '}}' WHEN 1 THEN '[' || {t}.n % 5 || CASE WHEN {t}.n % 4 = 0 THEN '' ELSE ',1' END || ']' ELSE CAST({t}.n % 5 AS VARCHAR) END"
_CONVERSED = f"""WITH t AS (SELECT conv_id // 2 AS k, conv_id % 2 AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, CAST(length(text) AS BIGINT) AS n FROM conversations),
c AS (SELECT k, side, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT e.k, e.n AS x, a.n AS y FROM c e JOIN c a ON e.k = a.k AND e.side = 0 AND a.side = 1),
m AS (SELECT e.k, '.turns[' || e.i || ']' AS place, e.role AS er, a.role AS ar, e.n AS en, a.n AS an, {_TAG.format(t="e")} AS et, {_TAG.format(t="a")} AS att FROM t e JOIN t a ON e.k = a.k AND e.i = a.i AND e.side = 0 AND a.side = 1)"""


@query(f"""{_CONVERSED}
SELECT CAST(k AS BIGINT) AS k, '.n' AS path, 'changed' AS kind, CAST(x AS VARCHAR) AS expected, CAST(y AS VARCHAR) AS actual FROM s WHERE x <> y
UNION ALL SELECT k, '.turns.length', 'changed', CAST(x AS VARCHAR), CAST(y AS VARCHAR) FROM s WHERE x <> y
UNION ALL SELECT k, place || '.role', 'changed', er, ar FROM m WHERE er <> ar
UNION ALL SELECT k, place || '.chars', 'changed', CAST(en AS VARCHAR), CAST(an AS VARCHAR) FROM m WHERE en <> an
UNION ALL SELECT k, place || '.only', CASE WHEN an % 2 = 1 THEN 'absent' WHEN en % 2 = 1 THEN 'new' ELSE 'changed' END, CASE WHEN en % 2 = 0 THEN CAST(en % 7 AS VARCHAR) END, CASE WHEN an % 2 = 0 THEN CAST(an % 7 AS VARCHAR) ELSE '(ausente)' END
  FROM m WHERE (en % 2 = 0 OR an % 2 = 0) AND NOT (en % 2 = 0 AND an % 2 = 0 AND en % 7 = an % 7)
UNION ALL SELECT k, place || '.tag' || CASE en % 3 WHEN 0 THEN '.k' WHEN 1 THEN '[0]' ELSE '' END, 'changed', CAST(en % 5 AS VARCHAR), CAST(an % 5 AS VARCHAR) FROM m WHERE en % 3 = an % 3 AND en % 5 <> an % 5
UNION ALL SELECT k, place || '.tag.length', 'changed', CASE WHEN en % 4 = 0 THEN '1' ELSE '2' END, CASE WHEN an % 4 = 0 THEN '1' ELSE '2' END FROM m WHERE en % 3 = 1 AND an % 3 = 1 AND (en % 4 = 0) <> (an % 4 = 0)
UNION ALL SELECT k, place || '.tag', 'changed', CASE en % 3 WHEN 0 THEN '(objeto)' WHEN 1 THEN '(arreglo)' ELSE et END, CASE WHEN en % 3 = 2 THEN att WHEN an % 3 = 2 THEN 'number' ELSE 'object' END FROM m WHERE en % 3 <> an % 3""")
def nested_diff(spark, sf):
    """Conversations as nested JSON, of which 2k is expected and 2k + 1 actual."""
    c = table(spark, sf, "conversations").select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("i"), "role", F.length("text").alias("n"))
    n = F.col("n")
    tag = F.when(n % 3 == 0, F.format_string('{"k":%d}', n % 5)).when(n % 3 == 1, F.when(n % 4 == 0, F.format_string("[%d]", n % 5)).otherwise(F.format_string("[%d, 1]", n % 5))).otherwise((n % 5).cast("string"))
    turn = F.concat(F.format_string('{"chars": %d, "tag": ', n), tag, F.when(n % 2 == 0, F.format_string(', "only": %d', n % 7)).otherwise(""), F.format_string(', "role": "%s"}', "role"))
    docs = c.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", turn.alias("t")))), lambda x: x["t"]), ",").alias("turns"))
    docs = docs.select(F.expr("conv_id div 2").alias("k"), (F.col("conv_id") % 2).alias("side"), F.format_string('{"turns": [%s], "n": %d}', "turns", "n").alias("doc"))
    pairs = docs.where("side = 0").select("k", F.col("doc").alias("e")).join(docs.where("side = 1").select("k", F.col("doc").alias("a")), "k")
    return trees.nested_differences(pairs, ["k"], "e", "a")


@query("""WITH p AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '__MACOSX/' || source WHEN 1 THEN 'a/._' || source || '.pdf' WHEN 2 THEN lang || '/' WHEN 3 THEN 'a/b/.DS_Store' WHEN 4 THEN '.DS_Store/' || source WHEN 5 THEN '_' || source || '.pdf' ELSE 'a/' || source || '.PDF' END AS path FROM documents),
b AS (SELECT *, split_part(path, '/', -1) AS base FROM p)
SELECT doc_id, path FROM b WHERE NOT (starts_with(path, '__MACOSX/') OR starts_with(base, '._') OR ends_with(path, '/') OR base = '.DS_Store')""")
def junk_filter(spark, sf):
    k, at = F.col("doc_id") % 7, lambda *parts: F.concat(*[F.lit(p) if p[0] != "$" else F.col(p[1:]) for p in parts])
    path = F.when(k == 0, at("__MACOSX/", "$source")).when(k == 1, at("a/._", "$source", ".pdf")).when(k == 2, at("$lang", "/")).when(k == 3, "a/b/.DS_Store").when(k == 4, at(".DS_Store/", "$source")).when(k == 5, at("_", "$source", ".pdf"))
    return table(spark, sf, "documents").select("doc_id", path.otherwise(at("a/", "$source", ".PDF")).alias("path")).where(~junk(F.col("path")))
