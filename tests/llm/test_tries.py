import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerloom.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 int"


def plain(rows):
    """The nodes the direct way: a dictionary of all prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - (abs(c) % 20) * (1 if c >= 0 else -1))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own_saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[x] for x in children.get(p, [])) or 1
        saved[p] = own_saved + sum(saved[x] for x in children.get(p, []))
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, tries.prefix_nodes(df).collect()), key=str)


def made(n, seed, words=3, longest=7):
    """Conversations that share beginnings, copies of each other, a very common first turn and one long one."""
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 3 == 0:
            turns = [("user", "the common turn"), ("assistant", "and its answer"), ("user", "again")]
        elif c % 7 == 0:
            turns = [("system", "you are"), *[("user", f"w{rnd.randrange(2)} w")] * rnd.randrange(3)]
        else:
            turns = [(rnd.choice(["user", "assistant"]), " ".join(f"w{rnd.randrange(words)}" for _ in range(rnd.randrange(3)))) for _ in range(rnd.randrange(1, longest))]
        if c == 5:
            turns = [("user", f"turn {k % 4}") for k in range(120)]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard, chunk", [(2_000, 50_000), (60, 100), (1, 50_000), (1, 2)])
def test_against_the_direct_way(spark, monkeypatch, shard, chunk):
    monkeypatch.setattr(tries, "SHARD", shard)
    monkeypatch.setattr(tries, "CHUNK", chunk)
    rows = made(150, shard)
    assert run(spark, rows) == plain(rows)


def test_edges(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "a", "b")]) == []
    only = [(c, 0, None, None) for c in range(8)]  # many are without turns once rebuilt
    assert run(spark, only) == plain(only)
    none = [(c, 0, "a", "b") for c in range(1, 19) if zlib.crc32(str(c).encode()) % 4 > 0]  # no base, no turns left
    assert run(spark, none) == plain(none) and len(plain(none)) == 1
    odd = [(-3, None, "a", "b"), (-3, -1, None, "c  c\u000bc"), (-3, 2, "a", None), (-3, 2, "a", None), (-20, 1, "x", "y" * 200_000), (-23, 5, "a:", "b"), (0, 1, "a", ":b"), (1 << 60, 1, "", ""), (-(1 << 60), 1, "", "")]
    assert run(spark, odd) == plain(odd)


def test_louds_bits(spark):
    #      a     b            level order: a b | c d | e
    #     c d
    #     e
    level, parent = np.array([0, 0, 1, 1, 2]), np.array([-1, -1, 0, 0, 2])
    labels = np.array([[1, 0], [2, 0], [3, 0], [4, 0], [5, 0]])
    trie, number = tries.Louds.build(level, parent, labels)
    assert number.tolist() == [1, 2, 3, 4, 5]
    assert "".join("01"[int(b)] for b in trie.bits) == "110" + "110" + "0" + "10" + "0" + "0"
    assert trie.parents().tolist() == [0, 0, 1, 1, 3] and trie.degrees().tolist() == [2, 2, 0, 1, 0, 0]
    assert trie.rolled_up(np.array([0, 1, 10, 100, 1000, 10000])).tolist() == [11111, 11101, 10, 10100, 1000, 10000]


def test_written_tries_hold_every_light_node(spark):
    rows = made(60, 3)
    trie = tries.build(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    found = tries.louds_tries(trie).collect()
    for r in found:
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: r["n_bits"]]
        assert bits.sum() == len(r["labels"]) and (bits == 0).sum() == len(r["labels"]) + 1
    assert sum(len(r["labels"]) for r in found) == len(plain(rows)) - 1
