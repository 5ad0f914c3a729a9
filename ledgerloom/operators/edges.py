"""Look-up of the first range that holds a point, and of the nearest centre, by sorted edges.

The ends of a group's ranges cut the axis into gaps, and within a gap the first range that covers a point is
the same throughout. An index holds the sorted ends and that range for each gap, once for a group; a point
then takes a binary search instead of a look at every range. Both are expressions. Numbers keep their type, so
decimals are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cluster import halvings, rank_in


def let(value: Column, then) -> Column:
    """then(value), with value worked out once for each row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sorted(values: Column) -> Column:
    return F.sort_array(F.array_distinct(F.array_compact(values)))


def cover_index(ranges: Column, low: str, high: str) -> Column:
    """struct<edges, cover, steps>: the sorted ends of an array of ranges, and for the gap from each end to the next
    the 0-based place of the first range with low <= x < high there, null for none. Ranges without an end or
    of no width cover nothing; the index of null is null, and that of no ranges is empty."""
    first = lambda e: F.nullif(F.array_position(F.transform(ranges, lambda r: (r[low] <= e) & (e < r[high])), True), F.lit(0)) - 1
    ends = _sorted(F.concat(F.transform(ranges, lambda r: r[low]), F.transform(ranges, lambda r: r[high])))
    return let(ends, lambda es: F.when(es.isNotNull(), F.struct(es.alias("edges"), F.transform(es, lambda e: first(e).cast("int")).alias("cover"), halvings(es).alias("steps"))))


def place_of(index: Column, x: Column) -> Column:
    """The 0-based place of the first range of an index that holds x; null for none or without x."""
    return F.get(index["cover"], rank_in(index["edges"], x, index["steps"]) - 1)


def centre_index(centres: Column, at: str, number: str) -> Column:
    """struct<edges, number, steps>: the sorted distinct places of an array of centres and the least number at each."""
    least = lambda e: F.array_min(F.transform(F.filter(centres, lambda c: c[at] == e), lambda c: c[number]))
    places = _sorted(F.transform(centres, lambda c: c[at]))
    return let(places, lambda es: F.when(es.isNotNull(), F.struct(es.alias("edges"), F.transform(es, least).alias("number"), halvings(es).alias("steps"))))


def nearest_of(index: Column, x: Column) -> Column:
    """The number of the centre nearest to x, the least one of equally near ones; null without centres or x."""

    def nearer(rank: Column) -> Column:
        side = lambda k: F.when(F.get(index["edges"], k).isNotNull(), F.struct(F.abs(x - F.get(index["edges"], k)).alias("d"), F.get(index["number"], k).alias("n")))
        return F.array_min(F.array(side(rank - 1), side(rank)))["n"]

    return F.when(x.isNotNull(), let(rank_in(index["edges"], x, index["steps"]), nearer))
