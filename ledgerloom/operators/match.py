"""Joins that databases lack: containment, nearest, overlap, fallback keys, prefixes, patterns.

Those that join take equality keys (`on`) besides their condition, and a key that data decides, so
they are planned as hash or sort-merge joins with a residual condition. Tables of literals aren't
joined at all: they are maps and arrays inside an expression, so looking them up moves no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .edges import centre_index, cover_index, nearest_of, place_of


def gathered(rows: DataFrame, on: list[str], order: list[str], name: str) -> DataFrame:
    """One row for each `on` with its rows as a sorted array of structs; groups are pages,
    documents or bands, whose size the printed form bounds."""
    rest = [c for c in rows.columns if c not in on and c not in order]
    return rows.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))


def contained(points: DataFrame, ranges: DataFrame, on: list[str], x: str, low: str, high: str, order: list[str], how: str = "left") -> DataFrame:
    """Each point with the first range of its group, by order, that has low <= x < high."""
    indexed = gathered(ranges, on, order, "_ranges").withColumn("_index", cover_index(F.col("_ranges"), low, high))
    put = points.join(indexed, on, how)
    hit = F.get("_ranges", place_of(F.col("_index"), F.col(x)))
    names = [c for c in ranges.columns if c not in on]
    out = put.withColumn("_hit", hit).select(*points.columns, *[F.col("_hit")[c].alias(c) for c in names if c not in points.columns])
    return out if how == "left" else out.where(F.col(low).isNotNull())


def nearest(points: DataFrame, centres: DataFrame, on: list[str], x: str, centre: str, number: str) -> DataFrame:
    """Each point with the number of its group's nearest centre, the first of equally near ones."""
    grouped = gathered(centres.select(*on, number, centre), on, [number], "_centres")
    indexed = grouped.select(*on, centre_index(F.col("_centres"), centre, number).alias("_index"))
    return points.join(indexed, on, "left").select(*points.columns, nearest_of(F.col("_index"), F.col(x)).alias(number))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The common part of two ranges over the narrower one's width, 0 if they don't touch."""
    width = F.least(a1, b1) - F.greatest(a0, b0)
    return F.when(width > 0, width / F.greatest(F.least(a1 - a0, b1 - b0), F.lit(1e-6))).otherwise(0.0)


def best_overlap(cells: DataFrame, heads: DataFrame, on: list[str], head: str, least: float) -> DataFrame:
    """(on, x0, x1, heading, share in millionths) for each distinct range x0, x1 of cells: of the
    heads of its group that it overlaps by a share of `least` (above 0) or more, the largest share
    rounded and then the largest head. heads have g0, g1.

    Equal ranges are merged first. A range has a level, the power of two that its width reaches, and
    lies in two or three of the level's stretches of the axis. Two ranges meet at the wider one's level: it
    waits in its own stretches, and the narrower one calls at those above its own, two or three a level. So a
    range is as many rows as there are levels, however wide it is, and each pair meets once, in the
    first stretch that both have.
    """
    level = lambda a, b: F.ceil(F.log2(F.col(b) - F.col(a))).cast("int")
    ranges = {"x": cells.select(*on, "x0", "x1").distinct().where("x0 < x1").withColumn("_lx", level("x0", "x1"))}
    ranges["g"] = heads.groupBy(*on, "g0", "g1").agg(F.max(head).alias("heading")).where("g0 < g1").withColumn("_lg", level("g0", "g1"))
    top = {s: ranges[s].agg(F.max(f"_l{s}")).first()[0] for s in ranges}  # one number each
    near = lambda s, at: [F.floor(F.col(f"{s}{n}") / F.pow(F.lit(2.0), at)) for n in (0, 1)]

    def stretched(s: str, levels: Column) -> DataFrame:
        """The stretches of one side's ranges at some levels; _s is the first of a level."""
        put = ranges[s].withColumn("_level", F.explode(levels))
        first, last = near(s, F.col("_level"))
        return put.withColumn(f"_s{s}", first).withColumn("_at", F.explode(F.sequence(first, last)))

    def met(narrow: str, wide: str, below: Column) -> DataFrame:
        if None in top.values():
            return stretched(narrow, F.array(F.col(f"_l{narrow}"))).join(stretched(wide, F.array(F.col(f"_l{wide}"))), [*on, "_level", "_at"])
        calls = F.when(F.col(f"_l{narrow}") <= top[wide], F.sequence(F.col(f"_l{narrow}"), F.lit(top[wide])))
        return stretched(narrow, calls).join(stretched(wide, F.array(F.col(f"_l{wide}"))), [*on, "_level", "_at"]).where(below)

    names = [*on, "x0", "x1", "g0", "g1", "heading", "_sx", "_sg", "_at"]
    pairs = met("x", "g", F.col("_lx") <= F.col("_lg")).select(*names).unionByName(met("g", "x", F.col("_lg") < F.col("_lx")).select(*names))
    pairs = pairs.where(F.col("_at") == F.greatest("_sx", "_sg"))
    pairs = pairs.withColumn("o", overlap(F.col("x0"), F.col("x1"), F.col("g0"), F.col("g1"))).where(F.col("o") >= least)
    scored = pairs.withColumn("share", F.round(F.col("o") * 1e6).cast("long"))
    return scored.groupBy(*on, "x0", "x1").agg(F.max_by("heading", F.struct("share", "heading")).alias("heading"), F.max("share").alias("share"))


def midpoint_domains(rows: DataFrame, on: list[str], order: str, x0: str = "x0", x1: str = "x1") -> DataFrame:
    """rows with left and right: halfway to the neighbours; null at the ends."""
    w = Window.partitionBy(*on).orderBy(order)
    return rows.withColumns({"left": (F.lag(x1).over(w) + F.col(x0)) / 2, "right": (F.col(x1) + F.lead(x0).over(w)) / 2})


def near_pairs(rows: DataFrame, on: list[str], a: str, b: str, row: str, tolerance: float) -> DataFrame:
    """(row, twin) for every two rows of a group whose a and b both differ by tolerance at most.

    Rows are joined by cells as wide as the tolerance, each with the nine around its own, so a row
    meets its neighbours only, however large the group is.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(tolerance))
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    one = rows.select(*on, row, a, b).withColumn("_ca", around(a)).withColumn("_cb", around(b))
    two = rows.select(*on, F.col(row).alias("twin"), F.col(a).alias("_a"), F.col(b).alias("_b"), cell(a).alias("_ca"), cell(b).alias("_cb"))
    close = (F.abs(F.col(a) - F.col("_a")) <= tolerance) & (F.abs(F.col(b) - F.col("_b")) <= tolerance)
    return one.join(two, [*on, "_ca", "_cb"]).where(close & (F.col(row) != F.col("twin"))).select(row, "twin")


def last_before(rows: DataFrame, on: list[str], at: str, value: str, within: int, where: Column) -> Column:
    """The value (the largest of several) of the last row of the group that qualifies, strictly before
    a row's integer place and no more than `within` before it: one sort, no join."""
    w = Window.partitionBy(*on).orderBy(at).rangeBetween(-within, -1)
    return F.max(F.when(where, F.struct(F.col(at), F.col(value)))).over(w)[value]


def _literal_map(table: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def first_known(keys: Column, table: dict[str, str]) -> Column:
    """struct<key, value>: the first of an array of keys that a table of literals knows; null for none."""
    known = _literal_map(table)
    tried = F.transform(keys, lambda k: F.struct(k.alias("key"), F.try_element_at(known, k).alias("value")))
    return F.get(F.filter(tried, lambda t: t["value"].isNotNull()), F.lit(0))


def exact_or_prefix(label: Column, entries: list[tuple[str, bool]]) -> Column:
    """The place in a list of literals (key, prefix) of the entry whose key is the label, or else of
    the first prefix entry that begins it; null for none."""
    exact = F.try_element_at(_literal_map({k: n for n, (k, _) in reversed(list(enumerate(entries)))}), label)
    heads = [(k, n) for n, (k, prefix) in enumerate(entries) if prefix]
    if not heads:
        return exact
    begins = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in heads]), lambda h: label.startswith(h["k"]))
    return F.coalesce(exact, F.get(begins, F.lit(0))["n"])


def longest_pattern(text: Column, patterns: dict[str, str]) -> tuple[Column, Column]:
    """(name of the pattern with the longest match, names of all that match in that order or
    null if it is the only one); the first listed wins ties."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), F.struct((-F.length(F.regexp_extract(text, p, 0))).alias("n"), F.lit(i).alias("i"), F.lit(name).alias("name"))) for i, (name, p) in enumerate(patterns.items())]))
    ordered = F.sort_array(hits)
    return F.get(ordered, F.lit(0))["name"], F.when(F.size(ordered) > 1, F.array_join(F.transform(ordered, lambda h: h["name"]), " / "))


def scored(texts: dict[str, Column], rules: list[tuple[str, str, int, str]], margin: int) -> dict[str, Column]:
    """Weighted rules (label, scope, weight, pattern) over named texts.

    Columns best, score, second, second_score, ambiguous and evidence: the label with the most
    points, first by its first matching rule at ties; null if that isn't above zero. The rules
    are unrolled into one expression.
    """
    labels = list(dict.fromkeys(r[0] for r in rules))
    hit = lambda r: texts[r[1]].rlike(r[3])
    entries = []
    for label in labels:
        own = [(i, r) for i, r in enumerate(rules) if r[0] == label]
        total = sum((F.when(hit(r), F.lit(r[2])).otherwise(0) for _, r in own), F.lit(0))
        first = F.least(*[F.when(hit(r), F.lit(i)) for i, r in own], F.lit(None).cast("int")) if len(own) > 1 else F.when(hit(own[0][1]), F.lit(own[0][0]))
        proof = F.array_compact(F.array(*[F.when(hit(r), F.concat_ws(":", F.lit(r[1]), F.lit(str(r[2])), F.trim(F.regexp_extract(texts[r[1]], r[3], 0)))) for _, r in own]))
        entries.append(F.when(first.isNotNull(), F.struct((-total).alias("n"), first.alias("i"), F.lit(label).alias("label"), proof.alias("proof"))))
    ordered = F.sort_array(F.array_compact(F.array(*entries)))
    top, next_ = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    won = top["n"] < 0
    return {
        "best": F.when(won, top["label"]),
        "score": F.when(won, -top["n"]),
        "second": F.when(won, next_["label"]),
        "second_score": F.when(won, -next_["n"]),
        "ambiguous": F.coalesce(won & (next_["n"] - top["n"] < margin), F.lit(False)),
        "evidence": F.when(won, F.array_join(top["proof"], "; ")),
    }
