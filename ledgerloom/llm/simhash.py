"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprints: texts are lower-cased in A-Z, cut into words and 3-word shingles; a bit of the
64-bit fingerprint is set if it is set in over half of the shingles' XXH64 values (seed 42).

Links: two fingerprints link at 3 or fewer differing bits. A fingerprint is a ring of eight
8-bit segments. If two differ in at most 3 bits, some start i exists from which every chain of
l consecutive segments differs in at most floor(3 l / 8) bits: budgets 0 0 1 1 1 2 2 3. So
segments i and i+1 are equal, and two of the three after them are; those 24 sets of 32 equal
bits are the join keys. A candidate from a key must also keep the chain budgets of its start
(5, 6 and 7 segments) before its whole Hamming distance is counted.

Equal texts and equal fingerprints are merged before any key is made, so a group of copies
costs one row. Inside a key's bucket only a spanning forest of its links leaves the task. A
bucket of more than BUCKET fingerprints isn't held or searched by a task: its rows are passed
on, and the next round keys them by a further quarter of their free bits, one of which is equal
in a pair that differs in 3 bits, until no bucket is large.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, id_text, materialize, texts
from .components import connected_components

SEED, SHINGLE, MAX_BITS, SEGMENTS = 42, 3, 3, 8
#: Buckets up to this size are compared pair by pair at once, larger ones by a forest search.
PAIRWISE_BUCKET = 8
#: Buckets over this size are split by further bits.
BUCKET = 20_000
#: Edges gathered in a task before they are reduced to a forest.
FOREST_EDGES = 200_000

_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_KEYED = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("fp", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64()), ("start", pa.int8())])
_FOUND = "a long, b long, mask long, start byte"


def fingerprint(text: str) -> int:
    """The fingerprint of one text as an unsigned integer; 0 without words."""
    words = text.encode().lower().split()  # bytes: lower() is A-Z only, split() is \x20\x09-\x0D
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else list(map(b" ".join, zip(words, words[1:], words[2:])))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles)).view(np.uint64)[0])


def text_key(text: Column) -> Column:
    """What tells apart rows that share a doc_id or have none; null texts sort last."""
    return F.coalesce(F.md5(text), F.lit("null"))


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """(doc_id, fp long): the fingerprint of every row, its 64 bits as a signed long; keyed:
    (doc_id, key, fp) with the text's key."""
    schema, rows = _FP, id_text(docs)
    if keyed:
        schema, rows = _KEYED, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("key"))

    def run(batches):
        for b in batches:
            values = np.fromiter(map(fingerprint, texts(b.column(1))), np.uint64, b.num_rows)
            yield batch(schema, b.column(0), *b.columns[2:], pa.array(values.view(np.int64)))

    return rows.mapInArrow(run, "doc_id long, key string, fp long" if keyed else "doc_id long, fp long")


def key_masks() -> list[tuple[int, int]]:
    """(start, mask): the 24 sets of segments that a pair within the budgets must share."""
    out = []
    for i in range(SEGMENTS):
        for skipped in (2, 3, 4):
            segments = [(i + j) % SEGMENTS for j in range(5) if j != skipped]
            out.append((i, sum(0xFF << (8 * s) for s in segments)))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(x: np.ndarray, start: int) -> np.ndarray:
    """Which differences x keep the chain budgets from this start and have at most 3 bits."""
    ring = x if not start else (x >> np.uint64(8 * start)) | (x << np.uint64(64 - 8 * start))
    ok = np.ones(len(x), bool)
    for length in (5, 6, 7):
        ok &= np.bitwise_count(ring & np.uint64((1 << (8 * length)) - 1)) <= MAX_BITS * length // SEGMENTS
    ok[ok] = np.bitwise_count(x[ok]) <= MAX_BITS
    return ok


def _forest(fps: np.ndarray, start: int) -> tuple[list, list]:
    """Edges that connect what is linked within one bucket, each fingerprint reached once."""
    a, b, rest = [], [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            hit = linked(rest ^ u, start)
            new, rest = rest[hit], rest[~hit]
            a.append(np.full(len(new), u, np.uint64))
            b.append(new)
            queue.extend(new)
    return a, b


def _starts(keys: np.ndarray, starts: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Where the buckets of sorted rows begin."""
    new = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1]) | (masks[1:] != masks[:-1])
    return np.flatnonzero(np.r_[True, new])


def _bucket_edges(keys: np.ndarray, starts: np.ndarray, masks: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked within each of the whole buckets of sorted rows."""
    if not len(fps):
        return fps, fps
    first = _starts(keys, starts, masks)
    sizes = np.diff(np.r_[first, len(keys)])
    a, b = [], []
    small = np.repeat((sizes > 1) & (sizes <= PAIRWISE_BUCKET), sizes)
    bucket = np.repeat(np.arange(len(first)), sizes)[small]
    s, f = starts[small], fps[small]
    for d in range(1, PAIRWISE_BUCKET):
        at = np.flatnonzero(bucket[d:] == bucket[:-d]) if len(bucket) > d else []
        if not len(at):
            break
        for start in range(SEGMENTS):
            mine = at[s[at] == start]
            ok = mine[linked(f[mine] ^ f[mine + d], start)]
            a.append(f[ok])
            b.append(f[ok + d])
    for g in np.flatnonzero(sizes > PAIRWISE_BUCKET):
        x, y = _forest(fps[first[g] : first[g] + sizes[g]], int(starts[first[g]]))
        a += x
        b += y
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _reduced(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """The same connections as a star for each group."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x], x = root, p
        return root

    for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    return nodes, [find(x) for x in nodes]


def _edge_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = _reduced(a, b)
    return batch(_EDGE, a, b, pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int8()))


def _passed_on(rows: list[np.ndarray]) -> pa.RecordBatch:
    _, starts, masks, fps = rows
    return batch(_EDGE, pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64()), pa.array(masks), pa.array(starts))


def _links(batches):
    """Sorted (key, start, mask, fp) rows of a partition to edges, and to rows without b for what
    is in large buckets. A bucket may span batches; no more than BUCKET rows of one are held."""
    held = [np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0, np.int64), np.empty(0, np.uint64)]
    large = None  # the bucket that is being passed on
    a, b, n = [], [], 0
    for part in batches:
        rows = [part.column(0).to_numpy(), part.column(1).to_numpy().astype(np.int8), part.column(2).to_numpy(), part.column(3).to_numpy().view(np.uint64)]
        if large is not None:
            k = int(((rows[0] == large[0]) & (rows[1] == large[1]) & (rows[2] == large[2])).sum())
            if k:
                yield _passed_on([r[:k] for r in rows])
            if k == len(rows[0]):
                continue
            rows, large = [r[k:] for r in rows], None
        held = [np.concatenate(x) for x in zip(held, rows)]
        if not len(held[0]):
            continue
        first = _starts(*held[:3])
        sizes = np.diff(np.r_[first, len(held[0])])
        whole = np.repeat((sizes <= BUCKET) & (np.arange(len(first)) < len(first) - 1), sizes)
        over = np.repeat(sizes > BUCKET, sizes)
        if over.any():
            yield _passed_on([h[over] for h in held])
            if over[-1]:
                large = [h[-1] for h in held[:3]]
        x, y = _bucket_edges(*(h[whole] for h in held))
        held = [h[~whole & ~over] for h in held]
        a.append(x)
        b.append(y)
        n += len(x)
        if n > FOREST_EDGES:
            yield _edge_rows(np.concatenate(a), np.concatenate(b))
            a, b, n = [], [], 0
    x, y = _bucket_edges(*held)
    yield _edge_rows(np.concatenate([*a, x]), np.concatenate([*b, y]))


_KEYS = pa.schema([("mask", pa.int64()), ("start", pa.int8()), ("fp", pa.int64())])


def _split(batches):
    """Rows (fp, mask, start) of large buckets, four times: with each quarter of the free bits
    added to the mask. A pair with at most 3 differences has none in one of the quarters."""
    for part in batches:
        fps, masks, starts = (part.column(i).to_numpy() for i in range(3))
        for mask in np.unique(masks):
            mine = masks == mask
            free = [bit for bit in range(64) if not int(mask) >> bit & 1]
            for quarter in range(MAX_BITS + 1):
                wider = int(mask) & (1 << 64) - 1 | sum(1 << bit for bit in free[quarter :: MAX_BITS + 1])
                yield batch(_KEYS, pa.array(np.full(mine.sum(), _signed(wider))), pa.array(starts[mine].astype(np.int8)), pa.array(fps[mine]))


def link_edges(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly what links among the distinct fingerprints (fp)."""
    keys = F.array(*[F.struct(F.lit(_signed(mask)).alias("mask"), F.lit(start).cast("byte").alias("start")) for start, mask in key_masks()])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("k.mask", "k.start", "fp")
    edges = None
    while True:
        keyed = rows.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "start", "mask", "fp")
        found = materialize(keyed.repartition("key").sortWithinPartitions("key", "start", "mask").mapInArrow(_links, _FOUND))
        new = found.where("b is not null").select("a", "b")
        edges = new if edges is None else edges.unionByName(new)
        large = found.where("b is null")
        if large.isEmpty():
            return edges
        rows = large.select("a", "mask", "start").mapInArrow(_split, "mask long, start byte, fp long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text, ...).

    component_id is the smallest doc_id reachable over links, the row's own included. A null
    text counts as empty; texts without words have fingerprint 0 and link like others. Rows
    that repeat a doc_id are each returned; a null doc_id never becomes a component's id unless
    all its rows have none. Other columns of docs are ignored. No rows give no rows. Texts of any
    length are taken whole.
    """
    rows = materialize(fingerprints(docs))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), compact=True)
    roots = connected_components(link_edges(distinct.select("fp")))
    member = distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "first_id")
    smallest = member.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = materialize(member.join(smallest, "root").select("fp", "least_id"), compact=True)
    by_fp = distinct.join(named, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component: exactly one for each, that with its
    smallest doc_id; a row without one only where all of the component's rows have none.

    Components are told apart by their root fingerprint and rows by doc_id and text, so unlike
    texts that share a doc_id or have none each stay. Of rows that repeat both, one stays.
    A null text counts as empty, as does one without words; empty texts are one component. Texts
    of any length are taken whole. No rows give no rows. Columns are those of docs, whatever their
    names.
    """
    rows = fingerprints(docs, keyed=True).groupBy("fp", "doc_id", "key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "key", "n")).alias("first")
    distinct = materialize(rows.groupBy("fp").agg(first), compact=True)
    roots = connected_components(link_edges(distinct.select("fp")))
    member = distinct.join(roots, distinct.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("root"), "first")
    chosen = materialize(member.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.key").alias("kept_key"), F.col("first.n").alias("n")), compact=True)
    kept = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["kept_id"]) & (text_key(docs["text"]) == chosen["kept_key"]), "left_semi")
    if chosen.where("n > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])  # sorts whole texts, so only where rows repeat


def hex_fingerprint(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
