import hashlib
import random
import re

import pytest

from ledgerloom.llm import spotsigs

SCHEMA = "doc_id long, text string, last string, at long"


ANCHORS = set(
    "a an and are as at be by for from had has have he in is it its not of on or that the they this to was were which with you al como con de del el en es la las lo los no para por que se su un una y "
    "als an auf aus das dem den der des die ein eine er für im in ist mit nicht sich sie und von zu au avec ce dans de des du elle en est et il la le les ne ou par pas pour qui sur un une".split()
)


def plain_signatures(text):
    """The set of signatures as the words themselves."""
    words = re.findall(r"\w+", text.lower())
    out = set()
    chain: list[str] = []  # the content words that follow, the nearest first
    for w in reversed(words):
        if w not in ANCHORS:
            chain = [w, *chain[:1]]
        elif len(chain) == 2:
            out.add((w, *chain))
    if out or not words:
        return out
    return {tuple(words[n : n + 3]) for n in range(len(words) - 2)} if len(words) > 2 else {tuple(words)}


def like(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    rows = sorted(((d is not None, d or 0, (t or "").encode(), t or "", d) for d, t in rows))
    out = []
    for n, (*_, t, d) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][3]
        k = len(t) // 4
        e = t[: len(t) - k] + following[:k]
        a, b, c = map(plain_signatures, (t, e, following))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), frozenset(a), frozenset(b), like(a, b), like(a, c)))
    return sorted(out, key=lambda r: (str(r[0]), r[2]))


@pytest.mark.parametrize("n", [1, 2, 7, 150])
def test_against_brute_force(spark, n):
    rnd = random.Random(n)
    words = ["the", "of", "und", "de"] + ["w%d" % i for i in range(80)] + ["É", "😀"]
    rows = [(rnd.randrange(-500, 5000), " ".join(rnd.choices(words, k=rnd.choice([0, 1, 2, 5, 60, 300])))) for _ in range(n)]
    rows += [(4, "the long one of und " * 30000)] if n == 7 else []
    rows += [(None, "no id"), (3, None), (3, ""), (3, "a the b c"), (3, "a the b c")] if n > 2 else []
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, spotsigs.compare_neighbours(df).collect()), key=lambda r: (str(r[0]), r[2]))
    want = brute(rows)
    plain = [r[:3] + r[5:] for r in want]
    assert [r[:3] + r[5:] for r in got] == plain
    # fingerprints are equal where the sets are, and only there
    by_set, by_text = {}, {}
    for g, w in zip(got, want):
        for f, x in ((g[3], w[3]), (g[4], w[4])):
            assert by_set.setdefault(x, f) == f and by_text.setdefault(f, x) == x


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert spotsigs.compare_neighbours(df).count() == 0 and spotsigs.spot_signatures(df).count() == 0


def test_signatures_follow_anchors():
    sigs = spotsigs.signatures
    assert len(sigs("")) == 0 and len(sigs(" \n!")) == 0
    assert len(sigs("alpha")) == 1 and len(sigs("alpha beta gamma delta")) == 2
    a, b = sigs("noise noise the alpha beta"), sigs("other start THE alpha -- beta.")
    assert a.tolist() == b.tolist() and len(a) == 1
    assert spotsigs.jaccard(a, sigs("")) == 0.0 and spotsigs.jaccard(sigs(""), sigs("")) == 1.0


def test_length_partitions_keep_every_similar_pair(spark):
    df = spark.range(0, 400).selectExpr("cast(id as int) n")
    part = {r["n"]: r["p"] for r in df.select("n", spotsigs.length_partition(df["n"]).alias("p")).collect()}
    for large in range(1, 400):
        for small in range(1, large + 1):
            if small >= 0.8 * large:
                assert 0 <= part[large] - part[small] <= 1


def test_pruning_only_rules_out_what_is_below():
    rnd = random.Random(0)
    import numpy as np

    for _ in range(300):
        a, b = (np.unique(np.array(rnd.choices(range(30), k=rnd.randrange(1, 30)), np.uint64)) for _ in range(2))
        full = spotsigs.jaccard(a, b)
        assert spotsigs.jaccard(a, b, 0.8) == full or full < 0.8


def groups(rows, threshold=0.8):
    sets = [plain_signatures(t or "") for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if like(sets[i], sets[j]) >= threshold:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        known = [x for x in (least.get(find(i)), d) if x is not None]
        least[find(i)] = min(known) if known else None
    return sorted(((d, least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("most,block", [(32, 4000), (3, 4000), (3, 4)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, most, block):
    monkeypatch.setattr(spotsigs, "PAIRWISE_BUCKET", most)
    monkeypatch.setattr(spotsigs, "BLOCK", block)
    rnd = random.Random(11)
    words = ["the", "of", "und", "de", "in"] + ["w%d" % i for i in range(400)]
    rows = [(100 + i, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 4, 80, 200])))) for i in range(50)]
    for i in range(60):  # edited copies, in a chain and around one text
        t = (rows[-1][1] if i % 3 == 0 else max((r[1] for r in rows[:50]), key=len)).split()
        for _ in range(rnd.randrange(6)):
            if t:
                t[rnd.randrange(len(t))] = "n%d" % rnd.randrange(900)
        rows.append((i, " ".join(t)))
    passage = "the rare one of words that nobody else has in a text "
    rows += [(700 + i, passage + " ".join(rnd.choices(words, k=20 + i))) for i in range(12)]  # one signature shared by unlike texts
    rows += [(500, None), (501, ""), (502, rows[3][1]), (502, rows[3][1]), (None, rows[60][1]), (None, "of its own the kind alone")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    assert sorted(map(tuple, spotsigs.near_duplicates(df).collect()), key=str) == groups(rows)
    assert spotsigs.near_duplicates(df.limit(0)).count() == 0


def test_forest_of_a_block_connects_what_is_alike():
    import numpy as np

    rnd = random.Random(5)
    for _ in range(40):
        sets = [sorted(rnd.sample(range(30), rnd.randrange(1, 12))) for _ in range(40)]
        sets += [sorted({*s, 77}) for s in sets[:8]]
        sizes, values = np.array([len(s) for s in sets]), np.concatenate([np.array(s, np.int64) for s in sets])
        a, b = spotsigs._group_forest(np.arange(len(sets)), sizes, values, 0.8)
        assert len(a) < len(sets) and all(like(set(sets[x]), set(sets[y])) >= 0.8 for x, y in zip(a, b))
        up = list(range(len(sets)))
        find = lambda x: x if up[x] == x else find(up[x])
        for x, y in zip(a, b):
            up[find(x)] = find(y)
        for x in range(len(sets)):
            for y in range(x):
                assert like(set(sets[x]), set(sets[y])) < 0.8 or find(x) == find(y)
