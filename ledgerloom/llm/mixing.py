"""Mixing sources to target weights by hierarchical budgets.

Documents hang on leaves of a domain - language - source tree. A token budget goes down from
the root: a node's children share it by their weights, but none gets more than its subtree can
give (its tokens times max_epochs). What a child can't take is shared among its siblings, and
only what all of them can't take goes to the parent's siblings. Shares are whole tokens, rounded
down: less than a token for each child stays unused.

Domains and languages are few and shared out on the driver. Sources may be as many as web hosts:
they stay in a table. Under one parent every source gets min(capacity, level x weight) for one
level, and that level is found by sums over the table: sources that are full at a level leave the
others a higher one, until no more are full.

A leaf's budget is whole epochs of all its documents and a prefix of one more: the documents
in the order of a seeded hash of (epoch, doc_id), as long as their tokens fit. The hash is of
the id and the text, so only rows that agree in both have one place; of those at the end of the prefix
as many copies are taken as fit. The prefix ends at one hash value. It is found from token sums over 1,024 ranges of the hash, then over 1,024
ranges of the one in which the budget ends, and so on until that range is small. So no leaf is
ever sorted in one task, and the selection itself is a filter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

LEAF = ("domain", "lang", "source")
KEYS = ["_d", "_l", "_s"]
#: Bits of the hash by which ranges get narrower, and documents that a last range holds at most if
#: their hashes differ.
RANGE_BITS, LAST_RANGE = 10, 50_000
#: A leaf with more than FEW documents and more than 1 / SHARE of all is joined by broadcast (no more than
#: SHARE leaves can be), so that no key of a shuffled join is hot.
FEW, SHARE = 100_000, 5_000


@dataclass(frozen=True)
class Mix:
    """Target weights by tree path, 1 where a path is not named; budget as a share of all tokens."""

    share: float = 0.6
    max_epochs: int = 2
    seed: int = 11
    weights: dict[tuple[str, ...], float] = field(default_factory=dict)


#: Documents name no domain: sources are dealt to four by a checksum of their names.
DOMAINS = 4
PRODUCTION = Mix(
    weights={("domain0",): 4, ("domain1",): 3, ("domain2",): 2, ("domain3",): 1} | {(f"domain{d}", lang): w for d in range(DOMAINS) for lang, w in {"en": 5, "es": 2, "de": 2, "fr": 1}.items()}
)


def domain_of(source: Column) -> Column:
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % DOMAINS).cast("string"))


def token_estimate(text: Column) -> Column:
    """Words of a text, the unit of the budget; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def poured(weights: list[float], capacities: list[int], budget: int) -> list[int]:
    """budget shared by weight under capacities: what one can't hold goes to the others."""
    level, open_ = _level(float(sum(weights)), budget, lambda x: [(c, w) for w, c in zip(weights, capacities) if _full(c, w, x)])
    return [c if _full(c, w, (level, open_)) else int(level * w / open_) if open_ > 0 else 0 for w, c in zip(weights, capacities)]


def _full(capacity: float, weight: float, level: tuple[float, float]) -> bool:
    return weight > 0 and float(capacity) * level[1] <= level[0] * weight


def _level(weight: float, budget: float, full) -> tuple[float, float]:
    """(left, open): open children get left / open tokens for each unit of weight; full(level)
    lists the (capacity, weight) of children that can't hold that much."""
    level = (float(budget), weight)
    while level[1] > 0:
        done = full(level)
        after = (float(budget - sum(c for c, _ in done)), weight - sum(w for _, w in done))
        if after == level:
            break
        level = after
    return level


def budgets(totals: dict[tuple, int], mix: Mix, depth: int = 2) -> dict[tuple, int]:
    """The token budget of every node of this depth; totals holds the nodes' tokens."""
    shares = {(): int(mix.share * sum(totals.values()))}
    for n in range(1, depth + 1):
        room: dict[tuple, int] = {}
        for path, tokens in totals.items():
            room[path[:n]] = room.get(path[:n], 0) + mix.max_epochs * tokens
        below: dict[tuple, int] = {}
        for parent, budget in shares.items():
            names = sorted(p for p in room if p[:-1] == parent)
            below |= zip(names, poured([mix.weights.get(p, 1.0) for p in names], [room[p] for p in names], budget))
        shares = below
    return shares


def _leaves(docs: DataFrame) -> DataFrame:
    """docs with d, l, s: the leaf's names, none null."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    domain = named("domain") if "domain" in docs.columns else domain_of(named("source"))
    return docs.withColumns({"_d": domain, "_l": named("lang"), "_s": named("source")})


def _own(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _order(seed: int) -> Column:
    """The place of a document in the order of its leaf's last epoch."""
    return F.xxhash64(F.lit(seed), F.col("_full"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("_own"))


def _at_leaf(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows joined to table by leaf; table's large leaves (_large) are broadcast, the others shuffled."""
    large = table.where("_large")
    if large.isEmpty():
        return rows.join(table, KEYS)
    more = [c for c in table.columns if c not in KEYS]
    put = rows.join(F.broadcast(large), KEYS, "left")
    rest = put.where("_large is null").drop(*more).join(table.where("not _large"), KEYS)
    return put.where("_large").unionByName(rest)


def _leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves(KEYS, _tokens) with _budget.

    One row for each pair of domain and language comes to the driver, as many as configuration
    and languages make; leaves are summed up where they are, once for each rise of the levels.
    """
    spark = leaves.sparkSession
    named = [(*p, float(w)) for p, w in mix.weights.items() if len(p) == 3]
    weights = spark.createDataFrame(named, "_d string, _l string, _s string, _named double")  # of the configuration
    parents = ["_d", "_l"]
    rows = leaves.join(F.broadcast(weights), KEYS, "left").select(*KEYS, "_tokens", "_large", (F.col("_tokens") * mix.max_epochs).alias("_room"), F.coalesce("_named", F.lit(1.0)).alias("_w"))
    sums = {(r["_d"], r["_l"]): r for r in rows.groupBy(*parents).agg(F.sum("_tokens").alias("n"), F.sum("_w").alias("w")).collect()}
    shares = budgets({p: r["n"] for p, r in sums.items()}, mix) if sums else {}
    levels = {p: (float(shares[p]), float(r["w"])) for p, r in sums.items()}

    def leveled():
        table = spark.createDataFrame([(*p, *v) for p, v in levels.items()], "_d string, _l string, _left double, _open double")
        # comparisons are those of poured(), in doubles
        return rows.join(F.broadcast(table), parents).withColumn("_full_up", (F.col("_w") > 0) & (F.col("_room").cast("double") * F.col("_open") <= F.col("_left") * F.col("_w")))

    while levels:
        full = leveled().where("_full_up and _open > 0").groupBy(*parents).agg(F.sum("_room").alias("c"), F.sum("_w").alias("w")).collect()
        after = levels | {(r["_d"], r["_l"]): (float(shares[r["_d"], r["_l"]] - r["c"]), float(sums[r["_d"], r["_l"]]["w"] - r["w"])) for r in full}
        if after == levels:
            break
        levels = after
    share = F.when(F.col("_full_up"), F.col("_room")).when(F.col("_open") > 0, F.floor(F.col("_left") * F.col("_w") / F.col("_open"))).otherwise(0)
    return leveled().select(*KEYS, "_tokens", "_large", share.cast("long").alias("_budget"))


def _prefix_ends(tokens: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """(KEYS, _cut, _next, _take) of each leaf with a rest: the last hash of its prefix, null for an empty one; the
    hash after it, and how many of the equal documents there still fit."""
    placed = _at_leaf(tokens, table.where("_rest > 0")).select(*KEYS, "_rest", "n_tokens", _order(seed).alias("h"))
    placed, ends, bits = materialize(placed.withColumn("_before", F.lit(0).cast("long"))), None, 0
    while True:
        rows, bits = placed, bits + RANGE_BITS
        if ends is not None:
            rows = _at_leaf(placed.drop("_before"), ends).where(F.shiftright("h", 64 - bits + RANGE_BITS) == F.col("_range")).drop("_range", "_n", "_large")
        sums = rows.groupBy(*KEYS, "_rest", "_before", F.shiftright("h", 64 - bits).alias("_range")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("_n"))
        reached = F.col("_before") + F.sum("n").over(Window.partitionBy(*KEYS).orderBy("_range"))  # 1,024 rows at most
        over = sums.withColumn("_reached", reached).where("_reached > _rest and _reached - n <= _rest")
        found = over.select(*KEYS, "_range", (F.col("_reached") - F.col("n")).alias("_before"), "_n")
        ends = materialize(found.join(table.select(*KEYS, "_large"), KEYS), compact=True)
        largest = ends.agg(F.max("_n")).first()[0] or 0
        if largest <= LAST_RANGE or bits + RANGE_BITS > 62:
            break
    last = _at_leaf(placed.drop("_before"), ends).where(F.shiftright("h", 64 - bits) == F.col("_range"))
    by_hash = last.groupBy(*KEYS, "_rest", "_range", "_before", "h").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("_equal"))
    reached = F.col("_before") + F.sum("n").over(Window.partitionBy(*KEYS).orderBy("h"))
    fits = F.col("_reached") <= F.col("_rest")
    least = F.when(F.col("_range") > -(1 << (bits - 1)), F.shiftleft("_range", 64 - bits) - 1)  # none fits: all before the range
    take = F.when(F.col("n") > 0, F.expr("(_rest - _reached + n) * _equal div n"))
    after = F.min(F.when(~fits, F.struct("h", take.alias("take"))))
    ends = by_hash.withColumn("_reached", reached).groupBy(*KEYS).agg(F.coalesce(F.max(F.when(fits, F.col("h"))), F.max(least)).alias("_cut"), after.alias("_after"))
    return ends.select(*KEYS, "_cut", F.col("_after.h").alias("_next"), F.coalesce("_after.take", F.lit(0)).alias("_take"))


def plan(docs: DataFrame, mix: Mix = PRODUCTION) -> tuple[DataFrame, DataFrame]:
    """(selection table, token table). The first has a row for each leaf: _d, _l, _s, _tokens,
    _budget, _full (whole epochs), _cut (the last hash of the prefix, null for none), _next and _take (see
    _prefix_ends); the second has doc_id, _d, _l, _s, _own (a hash of the text), n_tokens for every row of docs. Both are written tables, so
    Spark knows their size and broadcasts the first only where it is small.
    """
    tokens = materialize(_leaves(docs).select("doc_id", "_d", "_l", "_s", _own(F.col("text")).alias("_own"), token_estimate(F.col("text")).alias("n_tokens")))
    leaves = materialize(tokens.groupBy(*KEYS).agg(F.sum("n_tokens").alias("_tokens"), F.count("*").alias("_docs")), compact=True)
    most = max(FEW, (leaves.agg(F.sum("_docs")).first()[0] or 0) // SHARE)
    leaves = leaves.withColumn("_large", F.col("_docs") > most).drop("_docs")
    some = F.col("_tokens") > 0
    parts = {"_full": F.when(some, F.expr("_budget div _tokens")).otherwise(0), "_rest": F.when(some, F.col("_budget") % F.col("_tokens")).otherwise(0)}
    shares = materialize(_leaf_budgets(leaves, mix).withColumns(parts), compact=True)
    table = shares.join(_prefix_ends(tokens, shares, mix.seed), KEYS, "left").select(*KEYS, "_tokens", "_budget", "_large", "_full", "_cut", "_next", "_take")
    return materialize(table, compact=True), tokens


def _selected(rows: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """rows with _epoch, once for each epoch in which their leaf takes them."""
    placed = _at_leaf(rows, table).withColumn("_h", _order(seed))
    at_end = F.coalesce((F.col("_h") == F.col("_next")) & (F.col("_take") > 0), F.lit(False))
    # equal documents at the end of a prefix: a few rows of each leaf, but for copies without an id
    number = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.lit(0)))
    ends = placed.where(at_end).withColumn("_copies", F.col("_full") + (number <= F.col("_take")).cast("long"))
    inside = placed.where(~at_end).withColumn("_copies", F.col("_full") + F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False)).cast("long"))
    return inside.unionByName(ends).where("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))


def select_tokens(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch): every document that is taken, once for
    each epoch in which it is.

    docs has doc_id and text, and may have domain, lang and source; null names are the empty
    name, a null text has no tokens. Leaves without tokens give nothing. Rows with one
    doc_id (or none) and one text have one place in the order; where the prefix ends there, as many of
    them as fit are taken, no matter which. No rows give no rows. Texts of any length are counted whole.
    """
    table, tokens = plan(docs, mix)
    return _selected(tokens, table, mix.seed).select("doc_id", F.col("_d").alias("domain"), F.col("_l").alias("lang"), F.col("_s").alias("source"), "n_tokens", F.col("_epoch").alias("epoch"))


def mixed(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """The rows of docs that select_tokens takes, with docs' columns, once for each epoch.

    Null and empty texts, repeated rows, columns of any name and no rows at all are treated as there.
    """
    table, _ = plan(docs, mix)
    named = [c for c in ("doc_id", *LEAF) if c in docs.columns]
    rows = _leaves(docs.select(*named, _own(F.col("text")).alias("_own"), F.struct(*docs.columns).alias("_row")))
    return _selected(rows, table, mix.seed).select("_row.*")
