"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over edges; nothing is collected. A round's
result is written to the shared folder, so plans stay short and a lost executor costs one round.

The root of a giant group has an edge to every member. Such hubs don't meet their rows in one
task: the few nodes with more than 1 / SHARE of all edges are broadcast, and no key of the
joins has more rows than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A node with more than FEW edges and more than 1 / SHARE of all is a hub. Every edge counts for two
#: nodes at most, so there are no more than 2 SHARE hubs.
FEW, SHARE = 100_000, 5_000


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows(a, b) with m of least(a, m, degree), which has every a of rows."""
    most = max(FEW, edges // SHARE)
    if 2 * edges <= most:  # no degree can be larger
        return rows.join(least.select("a", "m"), "a")
    hubs = least.where(F.col("degree") > most).select("a", F.col("m").alias("_hub"))
    put = rows.join(F.broadcast(hubs), "a", "left")
    near = put.where("_hub is not null").select("a", "b", F.col("_hub").alias("m"))
    rest = put.where("_hub is null").select("a", "b").join(least.where(F.col("degree") <= most).select("a", "m"), "a")
    return near.unionByName(rest.select("a", "b", "m"))


def _star(edges: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star step over n edges; edges hold (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree"))
    large = _with_least(both, least, n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    rest = _with_least(large, low, n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the component's smallest node.

    Self-loops and repeated edges don't matter; nodes without an edge are not listed; an
    empty edge table gives an empty result. Rounds grow with the logarithm of the longest chain.
    """
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), compact=True)
    seen = _digest(now)
    while seen[0]:
        now = materialize(_star(now, seen[0]), compact=True)
        after = _digest(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
