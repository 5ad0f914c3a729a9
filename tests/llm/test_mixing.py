import random
from collections import defaultdict
from fractions import Fraction

import pytest
import xxhash

from ledgerloom.llm import mixing
from ledgerloom.llm.mixing import Mix, budgets, poured

SCHEMA = "doc_id long, text string, lang string, source string, domain string, n_tokens string"


def test_pouring():
    assert poured([1, 1], [100, 100], 50) == [25, 25]
    assert poured([1, 1, 2], [5, 100, 100], 80) == [5, 25, 50]
    assert poured([1, 1], [5, 7], 80) == [5, 7]
    assert poured([0, 1], [50, 10], 30) == [0, 10]
    assert poured([1, 1, 1], [10, 10, 10], 11) == [3, 3, 3] and poured([], [], 9) == []
    assert poured([0, 1], [50, 10], 10) == [0, 10] and poured([2, 1], [0, 9], 6) == [0, 6]


def test_siblings_take_a_shortage_before_ancestors_do():
    totals = {("a", "en", "x"): 10, ("a", "en", "y"): 500, ("a", "de", "z"): 500, ("b", "en", "w"): 500}
    got = budgets(totals, Mix(share=400.5 / 1510, max_epochs=1), 3)
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 90, ("a", "de", "z"): 100, ("b", "en", "w"): 200}
    got = budgets(totals | {("a", "en", "y"): 20}, Mix(share=400.5 / 1030, max_epochs=1), 3)
    assert got[("a", "en", "x")] == 10 and got[("a", "en", "y")] == 20 and got[("a", "de", "z")] == 170 and got[("b", "en", "w")] == 200


def _hash(seed, full, doc_id, text):
    """xxhash64 of four columns (int and three longs, of which the last is the text's own), chained as Spark chains its seed."""
    own = xxhash.xxh64_intdigest(text.encode(), seed=42)
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little", signed=True), seed=42)
    for v in (full, doc_id, own - (1 << 64) if own >> 63 else own):
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed=h)
    return h - (1 << 64) if h >> 63 else h


def plain_budgets(totals, mix):
    """Down the tree by exact fractions: a child that can't hold its share takes what it can, and
    the others share again."""
    out = {}

    def pour(path, budget, leaves):
        if len(path) == 3:
            out[path] = budget
            return
        children = {}
        for leaf in leaves:
            children.setdefault(leaf[: len(path) + 1], []).append(leaf)
        room = {c: mix.max_epochs * sum(totals[x] for x in below) for c, below in children.items()}
        weight = {c: Fraction(mix.weights.get(c, 1)) for c in children}
        open_, left, got = {c for c in children if weight[c] > 0}, Fraction(budget), dict.fromkeys(children, 0)
        while open_:
            share = left / sum(weight[c] for c in open_)
            full = {c for c in open_ if room[c] <= share * weight[c]}
            if not full:
                got |= {c: int(share * weight[c]) for c in open_}
                break
            got |= {c: room[c] for c in full}
            left -= sum(room[c] for c in full)
            open_ -= full
        for c, below in children.items():
            pour(c, got[c], below)

    pour((), int(mix.share * sum(totals.values())), list(totals))
    return out


def brute(rows, mix):
    leaves = defaultdict(list)
    for d, t, lang, source, domain, _ in rows:
        leaves[(domain or "", lang or "", source or "")].append((d, len((t or "").split()), t or ""))
    shares = plain_budgets({k: sum(n for _, n, _ in v) for k, v in leaves.items()}, mix)
    out = []
    for leaf, docs in leaves.items():
        total = sum(n for _, n, _ in docs)
        if not total:
            continue
        full, rest = divmod(shares[leaf], total)
        out += [(d, *leaf, n, e) for d, n, _ in docs for e in range(full)]
        groups = defaultdict(list)
        for d, n, t in docs:
            groups[_hash(mix.seed, full, -1 if d is None else d, t)].append((d, n))
        used = 0
        for h in sorted(groups):
            fit = [x for k, x in enumerate(groups[h], 1) if used + k * x[1] <= rest]
            if not rest:
                break
            out += [(d, *leaf, n, full) for d, n in fit]
            used += sum(n for _, n in fit)
            if len(fit) < len(groups[h]):
                break
    return sorted(out, key=str)


@pytest.mark.parametrize("share,epochs", [(0.05, 2), (0.6, 2), (1.7, 2), (3.0, 2), (0.9, 3)])
def test_against_brute_force(spark, share, epochs):
    rnd = random.Random(7)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 50, 400])), rnd.choice(["en", "en", "de", None]), rnd.choice(["s0"] * 6 + ["s1", "s2", None]), rnd.choice(["a", "b"]), "clash") for i in range(400)]
    rows += [(5, "again w", "en", "s0", "a", None), (None, None, None, None, None, None), (None, "x y", "en", "s0", "a", None), (900, "", "xx", "empty", "c", None), rows[0]]
    mix = Mix(share=share, max_epochs=epochs, weights={("a",): 3, ("a", "en"): 2, ("b", "de", "s1"): 5})
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.select_tokens(df, mix)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, mix)
    whole = mixing.mixed(df, mix)
    assert whole.columns == df.columns and whole.count() == got.count()
    clashing = df.withColumnsRenamed({"n_tokens": "_full"}).withColumn("_d", mixing.F.lit("kept"))
    again = mixing.mixed(clashing, mix)
    assert again.columns == clashing.columns and again.where("_d = 'kept'").count() == got.count()


def test_ranges_are_narrowed(spark, monkeypatch):
    """Many documents in a leaf, most of them after the first 1,024 ranges; and many sources."""
    monkeypatch.setattr(mixing, "RANGE_BITS", 2)
    monkeypatch.setattr(mixing, "LAST_RANGE", 5)
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 9)), "en", rnd.choice(["big"] * 20 + [f"host{k}" for k in range(60)]), "a", None) for i in range(900)]
    rows += [(77, "same id", "en", "big", "a", None)] * 30 + [(-1, "x " * 90000, "en", "long", "b", None)]
    mix = Mix(share=0.4, max_epochs=2, weights={("a", "en", "big"): 30, ("a", "en", "host3"): 0})
    got = mixing.select_tokens(spark.createDataFrame(rows, SCHEMA), mix)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, mix)


def test_empty_and_no_domain(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.select_tokens(empty).count() == 0 and mixing.mixed(empty).count() == 0
    df = spark.createDataFrame([(i, "a b c", "en", f"src{i % 5}") for i in range(200)], "doc_id long, text string, lang string, source string")
    taken = mixing.select_tokens(df).toPandas()
    assert 300 < taken.n_tokens.sum() <= 360 and set(taken.domain) <= {f"domain{d}" for d in range(4)}


@pytest.mark.parametrize("seed", [11, 5, 3])
@pytest.mark.parametrize("texts", ["all differ", "without an id all equal"])
def test_the_budget_is_met_when_a_third_has_no_id(spark, seed, texts):
    rows = [(i if i % 3 else None, f"w{i if i % 3 or texts == 'all differ' else 0} " + "a b c d e f g h i"[: 2 * (i % 3 * 2)], "en", "s", "d", "x") for i in range(3000)]
    total = sum(len(r[1].split()) for r in rows)
    mix = Mix(share=0.5, max_epochs=1, seed=seed)
    got = [tuple(r) for r in mixing.select_tokens(spark.createDataFrame(rows, SCHEMA), mix).collect()]
    assert total // 2 - 10 < sum(r[4] for r in got) <= total // 2
    assert sorted(got, key=str) == sorted(brute(rows, mix), key=str)
    assert mixing.mixed(spark.createDataFrame(rows, SCHEMA), mix).count() == len(got)


def test_large_leaves_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 30)
    monkeypatch.setattr(mixing, "LAST_RANGE", 4)
    rnd = random.Random(8)
    rows = [(i, "w " * rnd.randrange(1, 30), "en", "hot" if i % 3 == 0 else f"s{i % 40}", "d", "x") for i in range(400)]
    mix = Mix(share=0.4, max_epochs=2, seed=2)
    got = sorted((tuple(r) for r in mixing.select_tokens(spark.createDataFrame(rows, SCHEMA), mix).collect()), key=str)
    assert got == sorted(brute(rows, mix), key=str)
