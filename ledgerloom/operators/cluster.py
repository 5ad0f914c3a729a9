"""Greedy clustering by anchors: a value joins the cluster whose first member is near enough.

They differ from gaps-and-islands by lag(): values 0, 2, 4 with tolerance 2.5 are two clusters, not
one. For groups that a page bounds they are folds over a sorted array inside one expression; groups
of any size are read as sorted streams of their distinct values, of which one anchor is remembered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchors(sorted_values: Column, tolerance: float) -> Column:
    """The first members of the clusters of a sorted array."""
    start = F.array().cast("array<double>")
    return F.aggregate(sorted_values, start, lambda a, v: F.when((F.size(a) > 0) & (v - F.element_at(a, -1) <= tolerance), a).otherwise(F.array_append(a, v)))


def halvings(sorted_values: Column) -> Column:
    """The steps of a binary search in a sorted array."""
    bits = F.ceil(F.log2(F.size(sorted_values) + F.lit(1.0))).cast("int")
    return F.transform(F.sequence(bits, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))


def rank_in(sorted_values: Column, value: Column, steps: Column | None = None) -> Column:
    """How many of a sorted array's values are at most a value, by binary search; steps are its halvings if they
    are known."""
    steps = halvings(sorted_values) if steps is None else steps
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(sorted_values, low + step - 1) <= value, low + step).otherwise(low))


def page_clusters(rows: DataFrame, on: list[str], value: str, tolerance: float) -> DataFrame:
    """rows with cluster (1, 2, ...) and anchor, the cluster's first value; groups are as small as pages."""
    found = rows.groupBy(*on).agg(anchors(F.sort_array(F.collect_set(F.col(value).cast("double"))), tolerance).alias("_anchors"))
    number = rank_in(F.col("_anchors"), F.col(value).cast("double"))
    return rows.join(found, on).withColumn("cluster", number).withColumn("anchor", F.get("_anchors", F.col("cluster") - 1)).drop("_anchors")


def anchor_clusters(rows: DataFrame, on: list[str], value: str, tolerance: float) -> DataFrame:
    """rows with cluster (1, 2, ...) and anchor, the cluster's first value, for groups of any size.

    The distinct values of a group pass one task in order, one at a time; rows are joined to theirs by
    group and value. Rows without a value are in no cluster (null); null keys are a group like others.
    """
    at = range(len(on))
    values = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(on)], F.col(value).cast("double").alias("_v")).distinct()
    keys = [f"_k{n}" for n in at]

    def walk(batches):
        group, anchor, number = None, 0.0, 0
        for b in batches:
            out: tuple[list, list] = ([], [])
            for *key, v in zip(*(c.to_pylist() for c in b.columns)):
                if key != group:
                    group, anchor, number = key, v, 1
                elif v - anchor > tolerance:
                    anchor, number = v, number + 1
                out[0].append(number)
                out[1].append(anchor)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[0], pa.int32()), pa.array(out[1], pa.float64())], names=[*b.schema.names, "cluster", "anchor"])

    schema = ", ".join([*(f"_k{n} {rows.schema[c].dataType.simpleString()}" for n, c in enumerate(on)), "_v double, cluster int, anchor double"])
    placed = values.repartition(*keys).sortWithinPartitions(*keys, "_v").mapInArrow(walk, schema)
    same = [rows[c].eqNullSafe(placed[k]) for c, k in zip(on, keys)] + [rows[value].cast("double") == placed["_v"]]
    met = same[0]
    for condition in same[1:]:
        met = met & condition
    return rows.join(placed, met, "left").select(*[rows[c] for c in rows.columns], "cluster", "anchor")


def pair_anchors(sorted_pairs: Column, tolerance: float) -> Column:
    """Of an array of structs, sorted, those whose first two fields aren't both near an earlier kept one's."""
    near = lambda k, p: (F.abs(k["a"] - p["a"]) <= tolerance) & (F.abs(k["b"] - p["b"]) <= tolerance)
    empty = F.slice(sorted_pairs, 1, 0)
    return F.aggregate(sorted_pairs, empty, lambda kept, p: F.when(F.exists(kept, lambda k: near(k, p)), kept).otherwise(F.array_append(kept, p)))


def first_near(kept: Column, a: Column, b: Column, tolerance: float) -> Column:
    """The 1-based place of the first kept pair near (a, b)."""
    return F.array_position(F.transform(kept, lambda k: (F.abs(k["a"] - a) <= tolerance) & (F.abs(k["b"] - b) <= tolerance)), True)
