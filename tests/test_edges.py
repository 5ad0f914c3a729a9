"""Indexes of sorted edges against a look at every range or centre."""

import random

import pytest
from ledgerloom.operators import edges
from pyspark.sql import functions as F

RANGES = "array<struct<a:double,b:double>>"


def first_holding(ranges, x):
    return next((i for i, (a, b) in enumerate(ranges) if None not in (x, a, b) and a <= x < b), None)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40])
def test_first_range_of_any_arrangement(spark, n):
    """Overlapping, equal, empty, reversed and half-known ranges; points on edges, outside and null."""
    rng = random.Random(n)
    ends = [None, *map(float, range(12))]
    ranges = [(rng.choice(ends), rng.choice(ends)) if n > 2 else (rng.randrange(6) / 2, 6.0 + rng.randrange(6)) for _ in range(n)]
    points = [None, -1.0, *(k / 2 for k in range(26))]
    rows = spark.createDataFrame([(x, ranges) for x in points], f"x double, r {RANGES}").withColumn("index", edges.cover_index(F.col("r"), "a", "b"))
    got = rows.select("x", edges.place_of(F.col("index"), F.col("x")).alias("i")).collect()
    assert [(r.x, r.i) for r in got] == [(x, first_holding(ranges, x)) for x in points]


@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_nearest_centre_and_ties(spark, n):
    """Equal centres, halfway points, centres without a place: the least number of equally near ones."""
    rng = random.Random(n)
    centres = [(float(rng.randrange(8)) if rng.random() < 0.9 or n < 3 else None, i) for i in range(n)]
    points = [None, -3.0, *(k / 2 for k in range(20))]
    rows = spark.createDataFrame([(x, centres) for x in points], "x double, c array<struct<at:double,i:int>>").withColumn("index", edges.centre_index(F.col("c"), "at", "i"))
    got = rows.select("x", edges.nearest_of(F.col("index"), F.col("x")).alias("i")).collect()
    want = [None if x is None else min(((abs(x - at), i) for at, i in centres if at is not None), default=(0, None))[1] for x in points]
    assert [r.i for r in got] == want


def test_no_array_at_all(spark):
    row = spark.createDataFrame([(1.0, None)], f"x double, r {RANGES}")
    assert row.select(edges.place_of(edges.cover_index(F.col("r"), "a", "b"), F.col("x"))).first()[0] is None


def test_ties_of_decimals_are_exact(spark):
    """0.2 is halfway between 0.1 and 0.3; as doubles it is nearer to 0.3."""
    rows = spark.sql("SELECT CAST(x AS DECIMAL(20,2)) AS x, array(named_struct('at', CAST(0.1 AS DECIMAL(20,2)), 'i', 1), named_struct('at', CAST(0.3 AS DECIMAL(20,2)), 'i', 2)) AS c FROM VALUES ('0.20'), ('0.29') AS t(x)")
    got = rows.select("x", edges.nearest_of(edges.centre_index(F.col("c"), "at", "i"), F.col("x")).alias("i")).collect()
    assert {(str(r.x), r.i) for r in got} == {("0.20", 1), ("0.29", 2)}
