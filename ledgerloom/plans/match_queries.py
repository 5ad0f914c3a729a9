"""Queries over containment, nearest, overlap, clustering, fallback and pattern operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import classify, cluster, cover, geometry, match
from .catalogue import query, table

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
BANDS = [(0, 0.0, 900.0), (1, 900.0, 1800.5), (2, 1800.5, 5000.0), (3, 4000.0, 60000.0), (4, 70000.0, 80000.0)]
_BANDS = "(VALUES " + ", ".join(f"({n}, {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in BANDS) + ") AS b(band, low, high)"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT CAST(min(band) AS INTEGER) FROM {_BANDS} WHERE l_extendedprice >= low AND l_extendedprice < high) AS band FROM lineitem""")
def range_containment(spark, sf):
    bands = spark.createDataFrame([(1, *b) for b in BANDS], "page int, band int, low double, high double")
    points = table(spark, sf, "lineitem").select(*LINE, "l_extendedprice", F.lit(1).alias("page"))
    return match.contained(points, F.broadcast(bands), ["page"], "l_extendedprice", "low", "high", ["band"]).select(*LINE, "band")


@query(f"""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (WHERE band IS NULL) AS BIGINT) AS outside, CAST(count(band) - count(DISTINCT band) AS BIGINT) AS collisions FROM
  (SELECT l_orderkey, (SELECT min(band) FROM {_BANDS} WHERE l_extendedprice >= low AND l_extendedprice < high AND band <> 2) AS band FROM lineitem) GROUP BY l_orderkey""")
def cells_outside_and_colliding(spark, sf):
    bands = spark.createDataFrame([(1, *b) for b in BANDS if b[0] != 2], "page int, band int, low double, high double")
    points = table(spark, sf, "lineitem").select(*LINE, "l_extendedprice", F.lit(1).alias("page"))
    put = match.contained(points, F.broadcast(bands), ["page"], "l_extendedprice", "low", "high", ["band"])
    return put.groupBy("l_orderkey").agg(F.count("*").alias("cells"), F.count_if(F.col("band").isNull()).alias("outside"), (F.count("band") - F.count_distinct("band")).alias("collisions"))


@query("""WITH c AS (SELECT p_size, CAST(row_number() OVER (ORDER BY p_size) AS INTEGER) AS number, min(CAST(p_retailprice AS DECIMAL(20,2))) AS centre FROM part GROUP BY p_size)
SELECT p_partkey, (SELECT arg_min(number, [abs(CAST(p.p_retailprice AS DECIMAL(20,2)) - centre), number]) FROM c) AS number FROM part p""")
def nearest_column(spark, sf):
    part = table(spark, sf, "part").withColumn("price", F.col("p_retailprice").cast("decimal(20,2)"))
    centres = part.groupBy("p_size").agg(F.min("price").alias("centre"))
    centres = centres.select(F.row_number().over(Window.orderBy("p_size")).alias("number"), "centre", F.lit(1).alias("page"))  # as many rows as sizes
    return match.nearest(part.select("p_partkey", "price", F.lit(1).alias("page")), F.broadcast(centres), ["page"], "price", "centre", "number").select("p_partkey", "number")


@query("""WITH e AS (SELECT user_id, event_id % 4 AS sheet, event_id, CAST(event_id * 37 % 500 AS DOUBLE) AS x0, CAST(event_id * 37 % 500 + 5 + event_id % 40 AS DOUBLE) AS x1 FROM events),
g AS (SELECT user_id, event_id % 4 AS sheet, event_id AS g, CAST(event_id * 61 % 500 AS DOUBLE) AS g0, CAST(event_id * 61 % 500 + 30 + event_id % 90 AS DOUBLE) AS g1 FROM events),
s AS (SELECT event_id, g, CASE WHEN least(x1, g1) - greatest(x0, g0) > 0 THEN (least(x1, g1) - greatest(x0, g0)) / greatest(least(x1 - x0, g1 - g0), 1e-6) ELSE 0 END AS o FROM e JOIN g USING (user_id, sheet))
SELECT event_id, arg_max(g, [CAST(round(o * 1e6) AS BIGINT), g]) AS heading, CAST(max(round(o * 1e6)) AS BIGINT) AS share FROM s WHERE o >= 0.4 GROUP BY event_id""")
def overlap_best(spark, sf):
    """Every event is a cell and a heading; a page is a quarter of a user's events."""
    rows = table(spark, sf, "events").withColumn("sheet", F.col("event_id") % 4)
    at = lambda k: (F.col("event_id") * k % 500).cast("double")
    cells = rows.select("user_id", "sheet", "event_id", at(37).alias("x0"), (at(37) + 5 + F.col("event_id") % 40).alias("x1"))
    heads = rows.select("user_id", "sheet", "event_id", at(61).alias("g0"), (at(61) + 30 + F.col("event_id") % 90).alias("g1"))
    best = match.best_overlap(cells, heads, ["user_id", "sheet"], "event_id", 0.4)
    return cells.join(best, ["user_id", "sheet", "x0", "x1"]).select("event_id", "heading", "share")


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, CAST(event_id * 37 % 500 AS DOUBLE) AS x0, CAST(event_id * 37 % 500 + 5 + event_id % 40 AS DOUBLE) AS x1 FROM events),
g AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id AS g, CAST(event_id * 61 % 500 AS DOUBLE) AS g0, CAST(event_id * 61 % 500 + 30 + event_id % 90 AS DOUBLE) AS g1 FROM events),
s AS (SELECT event_id, g, CASE WHEN least(x1, g1) - greatest(x0, g0) > 0 THEN (least(x1, g1) - greatest(x0, g0)) / greatest(least(x1 - x0, g1 - g0), 1e-6) ELSE 0 END AS o FROM e JOIN g USING (user_id, day))
SELECT event_id, arg_max(g, [CAST(round(o * 1e6) AS BIGINT), g]) AS heading, CAST(max(round(o * 1e6)) AS BIGINT) AS share FROM s WHERE o >= 0.4 GROUP BY event_id""")
def overlap_best_all(spark, sf):
    """Every event is a cell and a heading; a page is a user's day."""
    rows = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    at = lambda k: (F.col("event_id") * k % 500).cast("double")
    cells = rows.select("user_id", "day", "event_id", at(37).alias("x0"), (at(37) + 5 + F.col("event_id") % 40).alias("x1"))
    heads = rows.select("user_id", "day", "event_id", at(61).alias("g0"), (at(61) + 30 + F.col("event_id") % 90).alias("g1"))
    best = match.best_overlap(cells, heads, ["user_id", "day"], "event_id", 0.4)
    return cells.join(best, ["user_id", "day", "x0", "x1"]).select("event_id", "heading", "share")


@query("""SELECT p_partkey, (lag(x1) OVER w + x0) / 2 AS "left", (x1 + lead(x0) OVER w) / 2 AS "right" FROM
  (SELECT p_partkey, p_partkey // 40 AS page, CAST(p_partkey * 10 AS DOUBLE) AS x0, CAST(p_partkey * 10 + p_size % 7 AS DOUBLE) AS x1 FROM part) WINDOW w AS (PARTITION BY page ORDER BY x0)""")
def midpoint_domain(spark, sf):
    cells = table(spark, sf, "part").select("p_partkey", F.expr("p_partkey div 40").alias("page"), (F.col("p_partkey") * 10).cast("double").alias("x0"), (F.col("p_partkey") * 10 + F.col("p_size") % 7).cast("double").alias("x1"))
    return match.midpoint_domains(cells, ["page"], "x0").select("p_partkey", "left", "right")


@query("""WITH b AS (SELECT page_id, g.k AS band, CAST(g.k * 10 AS DOUBLE) AS y0, CAST(g.k * 10 + 12 + page_id % 5 AS DOUBLE) AS y1, 1 + (page_id * 7 + g.k * 3) % 6 AS cells FROM pages, (SELECT unnest(range(0, 12)) AS k) g),
p AS (SELECT page_id, CAST(page_id * 13 % 110 AS DOUBLE) AS y FROM pages)
SELECT page_id, CAST(arg_max(band, [cells, -band]) AS BIGINT) AS band, CAST(max(cells) AS BIGINT) AS cells FROM p JOIN b USING (page_id) WHERE y >= y0 AND y <= y1 AND cells > 1 GROUP BY page_id""")
def widest_band(spark, sf):
    k = F.col("k")
    rows = table(spark, sf, "pages").select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("k"))
    size = (1 + (F.col("page_id") * 7 + k * 3) % 6).cast("int")
    band = F.struct((k * 10).cast("double").alias("y0"), k.alias("band_no"), (k * 10 + 12 + F.col("page_id") % 5).cast("double").alias("y1"), F.sequence(F.lit(1), size).alias("cells"))
    pages = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(band)).alias("bands"))
    found = pages.withColumn("b", geometry.widest_band(F.col("bands"), (F.col("page_id") * 13 % 110).cast("double"))).where("b is not null")
    return found.select("page_id", F.col("b.band_no").alias("band"), F.size("b.cells").cast("long").alias("cells"))


@query("""WITH b AS (SELECT page_id, g.k AS box, CAST(g.k * 11 % 50 AS DOUBLE) AS x0, CAST(g.k * 11 % 50 + 10 + g.k * 7 % 60 AS DOUBLE) AS x1 FROM pages, (SELECT unnest(range(0, 20)) AS k) g),
p AS (SELECT page_id, CAST(page_id * 17 % 100 AS DOUBLE) AS x FROM pages)
SELECT page_id, CAST(arg_min(box, [x1 - x0, box]) AS BIGINT) AS box, min(x1 - x0) AS width FROM p JOIN b USING (page_id) WHERE x >= x0 AND x < x1 GROUP BY page_id""")
def smallest_box(spark, sf):
    pages = table(spark, sf, "pages").select("page_id")
    k = F.col("k")
    boxes = pages.select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("k"))
    boxes = boxes.select("page_id", k.alias("box"), (k * 11 % 50).cast("double").alias("x0"), (k * 11 % 50 + 10 + k * 7 % 60).cast("double").alias("x1"))
    points = pages.withColumn("x", (F.col("page_id") * 17 % 100).cast("double"))
    width = F.col("x1") - F.col("x0")
    put = match.contained(points, boxes.withColumn("width", width), ["page_id"], "x", "x0", "x1", ["width", "box"], "inner")
    return put.select("page_id", "box", "width")


@query("""SELECT a.event_id, min(b.event_id) AS twin FROM events a JOIN events b ON a.user_id = b.user_id AND abs(a.value - b.value) <= 0.6 AND abs(a.event_id % 50 - b.event_id % 50) <= 0.6 AND a.event_id <> b.event_id GROUP BY a.event_id""")
def tolerance_equality(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "value", (F.col("event_id") % 50).cast("double").alias("place"))
    return match.near_pairs(e, ["user_id"], "value", "place", "event_id", 0.6).groupBy("event_id").agg(F.min("twin").alias("twin"))


@query("""WITH RECURSIVE e AS (SELECT user_id, CAST(epoch(ts) AS DOUBLE) AS y, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)) AS n FROM (SELECT DISTINCT user_id, ts FROM events)),
c AS (SELECT user_id, n, y, y AS anchor, 1 AS cluster FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.y, CASE WHEN e.y - c.anchor <= 90000 THEN c.anchor ELSE e.y END, CASE WHEN e.y - c.anchor <= 90000 THEN c.cluster ELSE c.cluster + 1 END FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
SELECT event_id, CAST(cluster AS INTEGER) AS cluster, CAST(anchor AS DOUBLE) AS anchor FROM events JOIN c ON events.user_id = c.user_id AND CAST(epoch(ts) AS DOUBLE) = c.y""")
def anchor_cluster(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    rows = rows.withColumn("y", F.col("us") / 1e6)
    return cluster.anchor_clusters(rows, ["user_id"], "y", 90000.0).select("event_id", "cluster", "anchor")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS t, l_quantity % 3 = 0 AS numeric, row_number() OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
i AS (SELECT *, coalesce(sum(CAST(numeric AS INTEGER)) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM c)
SELECT l_orderkey, CAST(island AS BIGINT) AS island, coalesce(string_agg(t, ' ' ORDER BY n) FILTER (WHERE NOT numeric), '') AS label FROM i GROUP BY l_orderkey, island HAVING bool_or(numeric)""")
def running_label(spark, sf):
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("text"), F.when(F.col("l_quantity") % 3 == 0, F.col("l_quantity")).alias("number"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("cells"))
    labels = cover.running_labels(F.col("cells"), "string", lambda label, c: label)
    return rows.select("l_orderkey", F.posexplode(labels).alias("island", "label")).withColumn("island", F.col("island").cast("long"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, min(CASE WHEN l_quantity > 45 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS stop FROM lineitem) WHERE stop IS NULL OR l_linenumber < stop""")
def prefix_until_total(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("rows"))
    live = geometry.before_stop(F.col("rows"), lambda r: r["l_quantity"] > 45, "l_linenumber")
    return rows.select("l_orderkey", F.explode(live).alias("r")).select("l_orderkey", "r.l_linenumber", "r.l_partkey", "r.l_suppkey")


@query("""SELECT p_partkey, coalesce(b.field, t.field) AS field, CASE WHEN b.field IS NOT NULL THEN 'ancestor' WHEN t.field IS NOT NULL THEN 'leaf' END AS level FROM part
  LEFT JOIN (VALUES ('Brand#11 ECONOMY', 'a'), ('Brand#22 STANDARD', 'b'), ('Brand#33 PROMO', 'c')) AS b(k, field) ON b.k = p_brand || ' ' || split_part(p_type, ' ', 1)
  LEFT JOIN (VALUES ('ECONOMY', 'd'), ('LARGE', 'e'), ('SMALL', 'f')) AS t(k, field) ON t.k = split_part(p_type, ' ', 1)""")
def key_fallback_map(spark, sf):
    known = {"Brand#11 ECONOMY": "a", "Brand#22 STANDARD": "b", "Brand#33 PROMO": "c", "ECONOMY": "d", "LARGE": "e", "SMALL": "f"}
    leaf = F.split_part("p_type", F.lit(" "), F.lit(1))
    found = table(spark, sf, "part").select("p_partkey", leaf.alias("leaf"), match.first_known(F.array(F.concat_ws(" ", "p_brand", leaf), leaf), known).alias("hit"))
    return found.select("p_partkey", F.col("hit.value").alias("field"), F.when(F.col("hit.key") == F.col("leaf"), "leaf").when(F.col("hit.key").isNotNull(), "ancestor").alias("level"))


@query("""WITH m AS (SELECT * FROM (VALUES ('STANDARD', true, 0, 'std'), ('PROMO', true, 1, 'promo'), ('STANDARD BRUSHED', true, 2, 'late'), ('ECONOMY ANODIZED TIN', false, 3, 'exact')) AS m(key, prefix, ord, total))
SELECT p_partkey, coalesce((SELECT total FROM m WHERE key = p_type), (SELECT arg_min(total, ord) FROM m WHERE prefix AND starts_with(p_type, key))) AS total FROM part""")
def prefix_lookup(spark, sf):
    at = match.exact_or_prefix(F.col("p_type"), [("STANDARD", True), ("PROMO", True), ("STANDARD BRUSHED", True), ("ECONOMY ANODIZED TIN", False)])
    return table(spark, sf, "part").select("p_partkey", F.get(F.array(*map(F.lit, ("std", "promo", "late", "exact"))), at).alias("total"))


@query("""SELECT n_nationkey, CAST(c.code AS INTEGER) AS code FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (VALUES ('africa', 1), ('asia', 2), ('europe', 3)) AS c(name, code) ON lower(r_name) = c.name""")
def code_lookup(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", classify.code_of(F.col("r_name"), {"africa": 1, "asia": 2, "europe": 3}, "^the ").alias("code"))


RULES = [("prose", "whole", 4, r"\bthe\b|\bder\b"), ("prose", "start", 3, r"^[A-Z][a-z]"), ("table", "whole", 6, r"\|"), ("table", "start", -5, "The"), ("noise", "whole", 5, "[#$%&]{3}"), ("noise", "start", 3, "[!]{2}"), ("mail", "whole", 2, "@[a-z]")]
_CASE = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, {w} AS w, {i} AS i FROM t WHERE regexp_matches({'text' if scope == 'whole' else 'head'}, '{p}')" for i, (label, scope, w, p) in enumerate(RULES))


@query(f"""WITH t AS (SELECT doc_id, text, left(text, 60) AS head FROM documents WHERE text IS NOT NULL), h AS ({_CASE}),
s AS (SELECT doc_id, label, CAST(sum(w) AS INTEGER) AS score, min(i) AS first FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS n, lead(label) OVER w AS second, lead(score) OVER w AS second_score FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, first))
SELECT doc_id, label AS best, score, second, second_score, coalesce(score - second_score < 4, false) AS ambiguous FROM t LEFT JOIN (SELECT * FROM r WHERE n = 1 AND score > 0) USING (doc_id)""")
def weighted_classify(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    got = match.scored({"whole": F.col("text"), "start": F.substring("text", 1, 60)}, RULES, 4)
    return docs.select("doc_id", *[got[c].alias(c) for c in ("best", "score", "second", "second_score", "ambiguous")])


SECTIONS = {"any": "<(p|div)", "article": "<article[^>]*>", "titled": "<title>[^<]*</title>"}
_HITS = " UNION ALL ".join(f"SELECT page_id, '{n}' AS name, {i} AS i, length(regexp_extract(html, '{p}', 0)) AS n FROM pages WHERE regexp_matches(html, '{p}')" for i, (n, p) in enumerate(SECTIONS.items()))


@query(f"""WITH h AS ({_HITS}) SELECT page_id, arg_min(name, [-n, i]) AS section, CASE WHEN count(*) > 1 THEN string_agg(name, ' / ' ORDER BY -n, i) END AS ambiguous FROM pages LEFT JOIN h USING (page_id) GROUP BY page_id""")
def longest_match_section(spark, sf):
    section, ambiguous = match.longest_pattern(F.col("html"), SECTIONS)
    return table(spark, sf, "pages").select("page_id", section.alias("section"), ambiguous.alias("ambiguous"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders)
SELECT a.o_orderkey, arg_max(b.o_orderkey, [epoch_us(b.o_orderdate), b.o_orderkey]) AS above FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate AND b.o_orderdate >= a.o_orderdate - INTERVAL 240 DAY AND b.o_orderstatus <> 'P' GROUP BY a.o_orderkey""")
def nearest_above(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), (F.col("o_orderstatus") != "P").alias("fits"))
    above = match.last_before(o, ["o_custkey"], "at", "o_orderkey", 240 * 86_400_000_000, F.col("fits"))
    return o.select("o_orderkey", above.alias("above")).where("above is not null")


@query("""SELECT o_orderkey, CAST(level AS INTEGER) AS level FROM (SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC) AS level FROM orders) WHERE level <= 3""")
def last_levels(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", F.year("o_orderdate").alias("year"))).alias("o"))
    levels = per.withColumn("levels", geometry.last_levels(F.transform("o", lambda x: x["year"]), 3))
    rows = levels.select("levels", F.explode("o").alias("o"))
    return rows.select("o.o_orderkey", F.array_position("levels", F.col("o.year")).cast("int").alias("level")).where("level > 0")


@query("""WITH e AS (SELECT user_id, event_id, CAST(event_id * 7 % 60 AS DOUBLE) AS a, CAST(event_id * 11 % 40 AS DOUBLE) AS b FROM events)
SELECT DISTINCT user_id, a, b FROM e""", name="distinct_boxes")
def distinct_boxes(spark, sf):
    at = lambda k, m: (F.col("event_id") * k % m).cast("double")
    pairs = F.sort_array(F.collect_set(F.struct(at(7, 60).alias("a"), at(11, 40).alias("b"))))  # 120 at most
    kept = table(spark, sf, "events").groupBy("user_id").agg(cluster.pair_anchors(pairs, 0.0).alias("kept"))
    return kept.select("user_id", F.explode("kept").alias("p")).select("user_id", "p.a", "p.b")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id % 8 AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 8) AS n FROM (SELECT DISTINCT user_id, event_id % 8 AS event_id FROM events)),
c AS (SELECT user_id, n, a AS anchor, a FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.a - c.anchor <= 1 THEN c.anchor ELSE e.a END, e.a FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
SELECT user_id, CAST(count(DISTINCT anchor) AS INTEGER) AS bands FROM c GROUP BY user_id""")
def band_cluster(spark, sf):
    a = (F.col("event_id") % 8).cast("double")
    pairs = F.sort_array(F.collect_set(F.struct(a.alias("a"), a.alias("b"))))
    return table(spark, sf, "events").groupBy("user_id").agg(F.size(cluster.pair_anchors(pairs, 1.0)).alias("bands"))


@query("""WITH RECURSIVE d AS (SELECT DISTINCT user_id, CAST(event_id * 7 % 60 AS DOUBLE) AS a, CAST(event_id * 7 % 60 + 5 + event_id * 11 % 40 AS DOUBLE) AS b FROM events),
e AS (SELECT user_id, a, b, row_number() OVER (PARTITION BY user_id ORDER BY a, b) AS n FROM d),
c AS (SELECT user_id, n, [{'a': a, 'b': b}] AS kept FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, CASE WHEN len(list_filter(c.kept, lambda k: abs(k.a - e.a) <= 6 AND abs(k.b - e.b) <= 6)) > 0 THEN c.kept ELSE list_append(c.kept, {'a': e.a, 'b': e.b}) END FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1),
l AS (SELECT user_id, arg_max(kept, n) AS kept FROM c GROUP BY user_id), u AS (SELECT user_id, unnest(kept) AS p FROM l)
SELECT user_id, p.a AS y0, p.b AS y1 FROM u""")
def band_pairs(spark, sf):
    """Bands (y0, y1) of every event, without those near an earlier one of the user."""
    y0 = (F.col("event_id") * 7 % 60).cast("double")
    pairs = F.sort_array(F.collect_set(F.struct(y0.alias("a"), (y0 + 5 + F.col("event_id") * 11 % 40).alias("b"))))  # 120 at most
    kept = table(spark, sf, "events").groupBy("user_id").agg(cluster.pair_anchors(pairs, 6.0).alias("kept"))
    return kept.select("user_id", F.explode("kept").alias("p")).select("user_id", F.col("p.a").alias("y0"), F.col("p.b").alias("y1"))


COVERS = [
    ("Caja de Compensación Los Andes\nC.C.A.F.\nAsignación Familiar", "DETALLE DE PAGO DE COTIZACIONES PREVISIONALES", "ccaf", 18, None, "Caja de Compensación Los Andes", "ccaf-cotizaciones"),
    ("AFP Modelo\nFONDO DE PENSIONES\nSIS", "DETALLE DE PAGO DE COTIZACIONES PARA TRABAJOS PESADOS", "afp", 17, "afc", "AFP Modelo", "afp-trabajos-pesados"),
    ("Fondo Nacional de Salud\nIPS", "DETALLE DE PAGO", "fonasa", 18, None, "Fonasa", "fonasa-detalle"),
    ("Isapre Colmena", "DETALLE DE PAGO", "isapre", 20, None, "Isapre", "isapre-detalle"),
    ("Asociación Chilena de Seguridad\nACHS", "DETALLE DE PAGO", "mutual", 16, None, "Mutual", "mutual-detalle"),
    ("Administradora de Fondos de Cesantía\nAFC Chile\nSeguro de Cesantía", "DETALLE DE PAGO", "afc", 17, None, "AFC", "afc-detalle"),
    ("Municipalidad", "DETALLE DE PAGO", None, None, None, "(no reconocida)", None),
    ("Mutual\nFonasa", "OTRA COSA", "fonasa", 10, "mutual", "Fonasa", None),
    ("Caja de Compensación La Araucana", "DETALLE DE PAGO DE OTRAS PRESTACIONES", "ccaf", 10, None, "Caja de Compensación La Araucana", "ccaf-prestaciones"),
]
_WANT = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in (n, *c[2:])) + ")" for n, c in enumerate(COVERS))


@query(f"""SELECT o_orderkey, profile, CAST(score AS INTEGER) AS score, second, coalesce(profile = 'fonasa' AND second = 'mutual', false) AS ambiguous, institution, section
FROM orders JOIN (VALUES {_WANT}) AS c(k, profile, score, second, institution, section) ON o_orderkey % {len(COVERS)} = k""")
def institution_profiles(spark, sf):
    """A cover of each institution, of none and of two, with an order's number on it: its profile, name and section."""
    k = F.col("o_orderkey") % len(COVERS)
    pick = lambda at: F.get(F.array(*[F.lit(c[at]) for c in COVERS]), k.cast("int"))
    lines = F.concat(F.lit("COMPROBANTE\nNúmero de Folio: "), F.col("o_orderkey").cast("string"), F.lit("\n"), pick(0))
    docs = classify.classified(table(spark, sf, "orders").select("o_orderkey", pick(1).alias("title"), lines.alias("lines")))
    section, _ = classify.section_of(F.col("profile"), F.col("title"))
    return docs.select("o_orderkey", "profile", F.col("score").cast("int").alias("score"), "second", "ambiguous", "institution", section.alias("section"))
