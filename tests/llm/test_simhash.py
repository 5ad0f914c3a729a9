import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash
from ledgerloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, fp string"


def brute(rows):
    def fp(t):
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    fps = [fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "clash") for d, t in rows], SCHEMA)
    out = simhash.near_duplicates(df).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id")
    return sorted(map(tuple, out.collect()))


def test_against_brute_force(spark):
    rnd = random.Random(5)
    words = ["w%d" % i for i in range(300)] + ["ÄB", "Éa", "x y"]
    rows = [(1000 + i, " ".join(rnd.choices(words, k=rnd.choice([1, 2, 3, 40, 200, 900])))) for i in range(60)]
    base = rows[-1][1].split()
    for i in range(80):  # near copies of two texts, and exact copies
        t = list((base, rows[5][1].split())[i % 2])
        t[rnd.randrange(len(t))] = "changed%d" % (i % 30)
        rows.append((i, " ".join(t)))
    rows += [(5000, None), (4000, ""), (4001, " \n\t "), (4002, "A b"), (4003, "a\tB"), rows[0], (6000, "lang " * 30000)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_every_pair_within_three_bits_shares_a_key():
    rnd = random.Random(1)
    masks = simhash.key_masks()
    for _ in range(3000):
        x = sum(1 << b for b in rnd.sample(range(64), 3)) if rnd.random() < 0.9 else 1 << rnd.randrange(64)
        assert any(x & m == 0 and simhash.linked(np.array([x], np.uint64), s)[0] for s, m in masks)
    far = np.array([sum(1 << b for b in rnd.sample(range(64), 4)) for _ in range(500)], np.uint64)
    assert not any(simhash.linked(far, s).any() for s in range(8))


def test_large_bucket_gives_a_forest(spark):
    rnd = random.Random(2)
    fps = sorted({sum(1 << b for b in range(0, 48, 4) if rnd.random() < 0.5) for _ in range(600)})
    signed = [(simhash._signed(f),) for f in fps]
    edges = simhash.link_edges(spark.createDataFrame(signed, "fp long"))
    assert edges.count() < 24 * len(fps)
    roots = {r["root"] for r in connected_components(edges).collect()}
    assert len(roots) == 1


def test_large_buckets_are_split(spark, monkeypatch):
    """With buckets of 16 at most, texts that share many bits are found as without a bound."""
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rnd = random.Random(7)
    fps = {rnd.getrandbits(64) for _ in range(30)} | {sum(1 << b for b in rnd.sample(range(20, 64), rnd.randrange(9))) for _ in range(400)}
    fps |= {f ^ sum(1 << b for b in rnd.sample(range(64), 3)) for f in sorted(fps)[:60]}
    fps = sorted(fps)
    edges = simhash.link_edges(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"))
    got = {}
    for node, root in map(tuple, connected_components(edges).collect()):
        got.setdefault(root, set()).add(node & (1 << 64) - 1)
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                up[find(x)] = find(y)
    want = {}
    for f in fps:
        want.setdefault(find(f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_a_bucket_over_many_batches_is_passed_on_whole(monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rows = [(1, 0, 5, f) for f in range(3)] + [(2, 1, 6, f) for f in range(100)] + [(3, 0, 5, f) for f in range(2)]
    import pyarrow as pa

    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int8(), pa.int64(), pa.int64()))]
    whole = pa.RecordBatch.from_arrays(columns, names=["key", "start", "mask", "fp"])
    for size in (1, 7, 40, 200):
        out = pa.Table.from_batches(list(simhash._links(whole.slice(i, size) for i in range(0, len(rows), size)))).to_pylist()
        assert sorted(r["a"] for r in out if r["b"] is None) == list(range(100)) and {(r["mask"], r["start"]) for r in out if r["b"] is None} == {(6, 1)}
        assert {x for r in out if r["b"] is not None for x in (r["a"], r["b"])} == {0, 1, 2}


def test_hubs_are_broadcast(spark, monkeypatch):
    from ledgerloom.llm import components

    monkeypatch.setattr(components, "FEW", 3)
    monkeypatch.setattr(components, "SHARE", 40)
    edges = [(5, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 212)] + [(150, 3), (7, 1000), (1000, 6)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {3: 3, 5: 3} | {i: 3 for i in range(100, 160)} | {i: 200 for i in range(200, 213)} | {6: 6, 7: 6, 1000: 6}


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, None)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_no_rows_and_long_texts(spark):
    long = " ".join(random.Random(6).choices(["w%d" % i for i in range(3000)], k=60000))
    df = spark.createDataFrame([(4, long, "en", "x"), (2, long + " again", "en", "y"), (9, "else here now", "en", "z")], SCHEMA)
    assert simhash.keep_representatives(df.limit(0)).count() == 0 and simhash.keep_representatives(df.limit(0)).columns == df.columns
    assert sorted(r["doc_id"] for r in simhash.keep_representatives(df).collect()) == [2, 9]


def test_one_row_stays_of_each_group(spark):
    rows = [(3, "a b c d", "en", "x"), (1, "a b c d", "en", "y"), (1, "a b c d", "en", "y"), (9, "q r s t u", "en", "z"), (None, None, None, None)]
    out = simhash.keep_representatives(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "lang", "fp"]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, 1), (False, 9), (True, 0)]
    assert out.select(F.count("*")).first()[0] == 3
    clashing = spark.createDataFrame([(1, "a b c", 5), (2, "a b c", 6)], "doc_id long, text string, kept_id int")
    assert [tuple(r) for r in simhash.keep_representatives(clashing).collect()] == [(1, "a b c", 5)]


def test_unlike_rows_that_share_or_lack_an_id_all_stay(spark):
    rnd = random.Random(9)
    unlike = [" ".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(8)]
    rows = [(None, t, "en", "x") for t in unlike[:4]] + [(None, unlike[0], "en", "again")]
    rows += [(7, unlike[4], "en", "x"), (7, unlike[5], "en", "x"), (7, unlike[5], "en", "again")]
    rows += [(None, unlike[6], "en", "copy"), (3, unlike[6], "en", "x"), (8, unlike[6], "en", "copy"), (7, unlike[7], "en", "copy"), (2, unlike[7], "en", "x")]
    out = simhash.keep_representatives(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(None, t) for t in unlike[:4]] + [(7, unlike[4]), (7, unlike[5]), (3, unlike[6]), (2, unlike[7])]
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == sorted(want, key=repr)
