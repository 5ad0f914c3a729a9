"""Queries over all rows of their tables, and the operators that make that possible."""

import datetime
import random

from pyspark.sql import functions as F

from ledgerloom.operators import cluster, match
from ledgerloom.plans import catalogue


def events(spark, path, n):
    day = datetime.datetime(2026, 1, 1)
    rows = [(i, day + datetime.timedelta(hours=i % 40), i % 5, '{"a": "%d", "b": "%d"}' % (i % 2, i % 4)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_fixture_diff_reaches_every_event(spark, tmp_path):
    sf = events(spark, tmp_path, 2405)
    rows = catalogue.queries()["fixture_diff_all"](spark, sf).collect()
    changed = {(r["k"], r["path"]) for r in rows if r["kind"] == "changed"}
    assert changed == {(k, p) for k in range(1202) for p in "ab"}
    assert {(r["k"], r["path"]) for r in rows if r["kind"] == "absent"} == {(1202, "a"), (1202, "b")}


def test_overlap_and_bands_reach_every_event(spark, tmp_path):
    sf = events(spark, tmp_path, 600)
    best = catalogue.queries()["overlap_best_all"](spark, sf)
    assert {r["event_id"] % 3 for r in best.collect()} == {0, 1, 2}
    assert best.where("heading % 60 <> 0").count() > 0
    bands = catalogue.queries()["band_pairs"](spark, sf)
    assert bands.where("y0 <> y1").count() == bands.count() > bands.select("user_id").distinct().count()


def test_best_overlap_against_all_pairs(spark):
    rnd = random.Random(3)
    cells = [(rnd.randrange(3), float(a := rnd.randrange(-50, 200)), float(a + rnd.randrange(0, 60))) for _ in range(120)]
    heads = [(rnd.randrange(3), n, float(a := rnd.randrange(-50, 200)), float(a + rnd.randrange(0, 150))) for n in range(60)]
    want = {}
    for p, x0, x1 in cells:
        for q, g, g0, g1 in heads:
            if p == q and (w := min(x1, g1) - max(x0, g0)) > 0 and (o := w / max(min(x1 - x0, g1 - g0), 1e-6)) >= 0.4:
                want[p, x0, x1] = max(want.get((p, x0, x1), (0, 0)), (int(o * 1e6 + 0.5), g))
    got = match.best_overlap(spark.createDataFrame(cells, "page int, x0 double, x1 double"), spark.createDataFrame(heads, "page int, g int, g0 double, g1 double"), ["page"], "g", 0.4)
    assert {(r["page"], r["x0"], r["x1"]): (r["share"], r["heading"]) for r in got.collect()} == want


def test_best_overlap_of_repeated_ranges(spark):
    rows = [(0, 0.0, 10.0)] * 400
    heads = [(0, n, 0.0, 10.0) for n in range(400)]
    got = match.best_overlap(spark.createDataFrame(rows, "page int, x0 double, x1 double"), spark.createDataFrame(heads, "page int, g int, g0 double, g1 double"), ["page"], "g", 0.4)
    assert [tuple(r) for r in got.collect()] == [(0, 0.0, 10.0, 399, 1000000)]


def test_pair_anchors_use_both_values(spark):
    pairs = spark.createDataFrame([([(1.0, 9.0), (1.0, 20.0), (2.0, 9.0), (9.0, 9.0)],)], "p array<struct<a double, b double>>")
    assert pairs.select(F.size(cluster.pair_anchors(F.col("p"), 1.0))).first()[0] == 3


def test_clusters_of_a_group_of_any_size(spark):
    """One user holds nearly all rows, in more than 2 ^ 20 clusters; ties, nulls and null keys."""
    n = 1_100_000
    rows = spark.range(n).select(F.lit("a").alias("u"), (F.col("id") * 3.0).alias("y"))
    got = cluster.anchor_clusters(rows, ["u"], "y", 2.5)
    assert got.agg(F.max("cluster"), F.count_distinct("cluster"), F.sum(F.expr("int(anchor <> y)"))).first() == (n, n, 0)
    rnd = random.Random(2)
    small = [(rnd.choice(["a", "b", None]), rnd.choice([None, rnd.randrange(60) / 4])) for _ in range(400)]
    want = []
    for u in ("a", "b", None):
        anchor, number = None, 0
        for y in sorted({y for k, y in small if k == u and y is not None}):
            if anchor is None or y - anchor > 2.5:
                anchor, number = y, number + 1
            want += [(u, y, number, anchor)] * small.count((u, y))
        want += [(u, None, None, None)] * small.count((u, None))
    got = cluster.anchor_clusters(spark.createDataFrame(small, "u string, y double"), ["u"], "y", 2.5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert spark.createDataFrame([([float(k) for k in range(n)],)], "a array<double>").select(cluster.rank_in(F.col("a"), F.lit(n - 1.0))).first()[0] == n


def test_overlap_of_ranges_of_any_width(spark):
    rnd = random.Random(3)

    def some(n):
        out = []
        for k in range(n):
            x, w = rnd.uniform(-1e6, 1e6) if k % 2 else float(rnd.randrange(-64, 64)), rnd.choice([0.0, 0.25, 1.0, 2.0, 3.0, 64.0, 1e4, 1e9]) * rnd.choice([1, rnd.random()])
            out.append((k % 3, k, x, x + w))
        return out

    cells, heads = some(300), some(200)
    share = lambda a, b, c, d: max(0.0, (min(b, d) - max(a, c)) / max(min(b - a, d - c), 1e-6))
    want = {}
    for u, _, a, b in cells:
        hits = [(round(share(a, b, c, d) * 1e6), h) for v, h, c, d in heads if u == v and a < b and c < d and share(a, b, c, d) >= 0.4]
        if hits:
            want[u, a, b] = max(hits)
    got = match.best_overlap(spark.createDataFrame(cells, "u int, k int, x0 double, x1 double"), spark.createDataFrame(heads, "u int, h int, g0 double, g1 double"), ["u"], "h", 0.4)
    assert {(r["u"], r["x0"], r["x1"]): (r["share"], r["heading"]) for r in got.collect()} == want
    none = match.best_overlap(spark.createDataFrame([], "u int, k int, x0 double, x1 double"), spark.createDataFrame(heads, "u int, h int, g0 double, g1 double"), ["u"], "h", 0.4)
    assert none.count() == 0
