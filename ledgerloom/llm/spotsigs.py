"""SpotSigs document fingerprints.

A signature is a common word (the anchor) with the chain of the next two content words after
it; a document's fingerprint is the set of its signatures' 64-bit hashes. Function words, page
furniture and lists carry few anchors, so the set follows the running text. A text without a
signature takes chains of three from every word; a shorter one is a single signature of all
its words. Only a text without words has the empty set.

Fingerprints are partitioned by set length: with Jaccard >= t two sets' lengths differ by a
factor of 1/t at most, so partition bounds grow by 1/t and a set meets its own partition and
the next one only. Within that, a comparison ends as soon as the lengths rule t out.

The search for near-duplicates links all sets of Jaccard >= t without making all pairs of a group.
Sets meet in buckets, by the rarest of their signatures. First every set is compared with one set
of each of its buckets, which joins most groups of near copies. Then only buckets whose sets are
not yet one group are searched, small ones by pairs from different groups, large ones in blocks of
bounded size, of each of which only a forest of links leaves the task.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, id_text, materialize, texts
from .components import connected_components
from .rules import STOP_WORDS

CHAIN = 2
THRESHOLD = 0.8
#: Buckets up to this size make candidate pairs; larger ones are searched for a forest in blocks of
#: so many sets, two of them at a time.
PAIRWISE_BUCKET, BLOCK = 32, 4_000
#: Words whose hashes a worker remembers.
KEPT = 300_000

_WORD = re.compile(r"\w+")
_ANCHORS = frozenset(STOP_WORDS)
_SETS = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("signatures", pa.list_(pa.int64()))])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_COMPARED = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


class _Hashes(dict):
    """Words to an odd 64-bit hash for anchors, an even one for content words."""

    def __missing__(self, word: str) -> int:
        found = xxhash.xxh64_intdigest(word.encode()) >> 1 << 1 | (word in _ANCHORS)
        if len(self) < KEPT:
            self[word] = found
        return found


@lru_cache(1)
def _hashes() -> _Hashes:
    return _Hashes()


def _mix(parts: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(parts[0]), 0x243F6A8885A308D3, np.uint64)
    for p in parts:
        out = (out ^ p) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def signatures(text: str) -> np.ndarray:
    """The sorted signature hashes of a text."""
    words = list(map(_hashes().__getitem__, _WORD.findall(text.lower())))
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(words, np.uint64)
    anchor = (h & np.uint64(1)).astype(bool)
    at, content = np.flatnonzero(anchor), np.flatnonzero(~anchor)
    first = np.searchsorted(content, at)
    whole = first + CHAIN <= len(content)
    if whole.any():
        at, first = at[whole], first[whole]
        return np.unique(_mix([h[at], *(h[content[first + k]] for k in range(CHAIN))]))
    if len(h) > CHAIN:
        return np.unique(_mix([h[k : len(h) - CHAIN + k] for k in range(CHAIN + 1)]))
    return _mix([h[k : k + 1] for k in range(len(h))])


def digest(found: np.ndarray) -> str:
    """A fingerprint as a string: equal for equal sets."""
    return xxhash.xxh3_128_hexdigest(found.tobytes())


def jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 where lengths alone rule the threshold out.
    Two empty sets are alike, an empty and another one are not."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < threshold * large or not small:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def length_partition(n: Column, threshold: float = THRESHOLD) -> Column:
    """The partition of a set of n signatures: bounds grow by 1 / threshold."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9))).otherwise(F.lit(-1)).cast("int")


def spot_signatures(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint string, signatures array<long> sorted as unsigned, n, part int) for every
    row of docs(doc_id, text, ...). A null text counts as empty; repeated rows are each returned; texts of any
    length are taken whole; no rows give no rows."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [signatures(t) for t in texts(part.column(1))]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(digest, found), pa.string()), lists], schema=_SETS)

    sets = id_text(docs).mapInArrow(run, "doc_id long, fingerprint string, signatures array<long>").withColumn("n", F.size("signatures"))
    return sets.withColumn("part", length_partition(F.col("n"), threshold))


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(node, n, part, sig): the signatures by which a set may be found.

    Signatures are ordered by how many sets have them, rare ones first. Two sets of Jaccard
    >= t share one among the first n - ceil(t n) + 1 of either. Those that no other set has come
    first and find nothing, so only shared ones are passed on.
    """
    each = sets.select("node", F.explode("signatures").alias("sig"))
    shared = each.join(each.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1"), "sig")
    ranked = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("s")).join(sets.select("node", "n", "part"), "node")
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) + 1
    left = F.greatest(length - (F.col("n") - F.size("s")), F.lit(0)).cast("int")
    return ranked.select("node", "n", "part", F.explode(F.slice("s", 1, left)).alias("s")).select("node", "n", "part", F.col("s.sig").alias("sig"))


def _buckets(found: DataFrame) -> DataFrame:
    """found in buckets (bucket, sig): a set stands in its own length partition's and, as a guest, in
    those of the next one. Sets that are both guests meet in their own."""
    both = F.explode(F.array(F.struct(F.col("part").alias("bucket"), F.lit(True).alias("own")), F.struct((F.col("part") + 1).alias("bucket"), F.lit(False).alias("own"))))
    rest = [c for c in found.columns if c != "part"]
    return found.select(*rest, both.alias("b")).select(*rest, "b.bucket", "b.own")


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose lengths and then sets are alike enough."""
    left = sets.select(F.col("node").alias("a"), F.col("signatures").alias("x"), F.col("n").alias("an"))
    right = sets.select(F.col("node").alias("b"), F.col("signatures").alias("y"), F.col("n").alias("bn"))
    near = F.least("an", "bn") >= F.lit(threshold) * F.greatest("an", "bn") - F.lit(1e-9)
    both = F.size(F.array_intersect("x", "y"))
    alike = F.when(near, both >= F.lit(threshold) * (F.col("an") + F.col("bn") - both) - F.lit(1e-9))
    return pairs.join(left, "a").join(right, "b").where(alike).select("a", "b")


def _stars(rows: DataFrame) -> DataFrame:
    """(a, b): every set with the first own set of each of its buckets."""
    first = rows.where("own").groupBy("bucket", "sig").agg(F.min("node").alias("a"))
    return rows.join(first, ["bucket", "sig"]).where("node <> a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, b): the pairs of buckets of bounded size, of sets that aren't in one group yet."""
    a = rows.where("own").select("bucket", "sig", F.col("node").alias("a"), F.col("root").alias("_ar"))
    b = rows.select("bucket", "sig", F.col("node").alias("b"), F.col("root").alias("_br"), "own")
    pairs = a.join(b, ["bucket", "sig"]).where((F.col("_ar") != F.col("_br")) & (~F.col("own") | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _group_forest(nodes: np.ndarray, sizes: np.ndarray, values: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is alike among some sets, each reached once. Shared signatures are
    counted by inverted lists of the sets that aren't reached yet."""
    starts = np.r_[0, np.cumsum(sizes)]
    ids = np.unique(values, return_inverse=True)[1]
    alive = np.ones(len(nodes), bool)
    a, b = [], []

    def inverted():
        owner = np.repeat(np.arange(len(nodes)), sizes)
        kept = alive[owner]
        order = np.argsort(ids[kept], kind="stable")
        return owner[kept][order], np.r_[0, np.cumsum(np.bincount(ids[kept], minlength=ids.max() + 1 if len(ids) else 0))]

    owner, bounds = inverted()
    listed = left = len(nodes)
    for seed in range(len(nodes)):
        if not alive[seed]:
            continue
        alive[seed], left, queue = False, left - 1, [seed]
        while queue and left:
            u = queue.pop()
            if 2 * left < listed:
                owner, bounds = inverted()
                listed = left
            mine = ids[starts[u] : starts[u + 1]]
            met = [owner[bounds[k] : bounds[k + 1]] for k in mine]
            both = np.bincount(np.concatenate(met), minlength=len(nodes)) if met else np.zeros(len(nodes), int)
            hit = np.flatnonzero(alive & (both > 0) & (both >= threshold * (sizes[u] + sizes - both) - 1e-9))
            a.append(np.full(len(hit), nodes[u]))
            b.append(nodes[hit])
            alive[hit] = False
            left -= len(hit)
            queue.extend(hit.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (nodes[:0], nodes[:0])


def _forests(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that connect what is alike in large buckets. rows has size, that of the bucket: it
    is dealt to blocks, and every two blocks are searched together, so no task holds more than two
    blocks of a bucket however large it is."""

    def edges(held):
        nodes, sizes, values = (np.concatenate(x) for x in zip(*held))
        return batch(_EDGES, *_group_forest(nodes, sizes, values, threshold))

    def run(batches):
        at, held = None, []
        for part in batches:
            keys = np.stack([part.column(i).to_numpy() for i in range(4)], 1)
            lists = part.column(5)
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            nodes, values = part.column(4).to_numpy(), lists.flatten().to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
                if i == j:
                    continue
                if held and at != keys[i].tolist():
                    yield edges(held)
                    held = []
                at = keys[i].tolist()
                held.append((nodes[i:j], np.diff(ends[i : j + 1]), values[ends[i] : ends[j]]))
        if held:
            yield edges(held)

    n = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.withColumns({"_n": n, "_i": F.pmod(F.xxhash64("node"), F.lit(1 << 30)).cast("int") % n})
    dealt = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).where("_n = 1 or _i <> _j")
    key = ["bucket", "sig", "lo", "hi"]
    dealt = dealt.select(F.col("bucket").cast("long").alias("bucket"), "sig", F.least("_i", "_j").cast("long").alias("lo"), F.greatest("_i", "_j").cast("long").alias("hi"), "node")
    wide = dealt.join(sets.select("node", "signatures"), "node").select(*key, "node", "signatures")
    return wide.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, component_id) for every row of docs(doc_id, text, ...): documents are linked at a
    Jaccard similarity of their signature sets of threshold or more, and component_id is the
    smallest doc_id reachable over links, the row's own included.

    Documents of equal sets are one node. A null text counts as empty; texts without words have
    the empty set and are one component. Rows that repeat a doc_id are each returned; a null doc_id
    is a component's id only where all its rows have none. Other columns are ignored; texts of any
    length are taken whole; no rows give no rows.
    """
    rows = materialize(spot_signatures(docs, threshold).withColumn("row", F.monotonically_increasing_id()))
    groups = materialize(rows.groupBy("fingerprint").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id")), compact=True)
    sets = rows.join(groups.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n", "part", "signatures")
    found = materialize(_prefixes(sets, threshold), compact=True)
    sets = materialize(sets.join(found.select("node").distinct(), "node", "left_semi"))
    first = materialize(_alike(_stars(_buckets(found)), sets, threshold), compact=True)
    roots = connected_components(first)
    joined = _buckets(found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    open_ = joined.groupBy("bucket", "sig").agg(F.count("*").alias("size"), F.min("root").alias("_low"), F.max("root").alias("_high"), F.bool_or("own").alias("_own")).where("_low <> _high and _own")
    rest = materialize(joined.join(open_.select("bucket", "sig", "size"), ["bucket", "sig"]), compact=True)
    more = _alike(_pairs(rest.where(F.col("size") <= PAIRWISE_BUCKET)), sets, threshold).unionByName(_forests(rest.where(F.col("size") > PAIRWISE_BUCKET), sets, threshold))
    roots = connected_components(first.unionByName(more))
    member = groups.join(roots, "node").select("fingerprint", "root", "first_id")
    named = member.join(member.groupBy("root").agg(F.min("first_id").alias("least_id")), "root").select("fingerprint", "least_id")
    by_set = materialize(groups.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("least_id", "first_id").alias("component_id")), compact=True)
    return rows.join(by_set, "fingerprint").select("doc_id", "component_id")


def _bucket(bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most doc_id, by binary search; 0 for a null id."""
    if not bounds:
        return F.lit(0)
    table = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(table, low + step - 1) <= F.col("doc_id"), low + step).otherwise(low))


def in_id_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, last): docs ranged over partitions and sorted by doc_id, then text.

    After its own rows every partition holds, marked last, the first document of the next one
    (of the first one at the end), so each row's successor is in its task. Whole texts are
    shuffled once; bounds and first ids are one number for each partition.
    """
    spark, rows = docs.sparkSession, id_text(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    rows = rows.withColumn("at", _bucket(bounds))
    firsts = sorted((r["at"], r["first"]["doc_id"]) for r in rows.groupBy("at").agg(F.min(F.struct("doc_id")).alias("first")).collect())
    heads = [(before[0], head[1]) for before, head in zip([firsts[-1], *firsts[:-1]], firsts)] if firsts else []
    ghosts = spark.createDataFrame(heads, "to int, head long")  # one row for each partition
    extra = rows.join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("to").alias("at"), F.lit(True).alias("last"))
    both = rows.select("doc_id", "text", "at", F.lit(False).alias("last")).unionByName(extra)
    return both.repartitionById(len(bounds) + 1, F.col("at")).sortWithinPartitions("at", "last", "doc_id", "text").select("doc_id", "text", "last")


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many characters from the start of the next."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    For every row of docs(doc_id, text, ...): doc_id, n_chars (code points), edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next, the Jaccard similarity to the
    edited text and to the next document by ascending doc_id (null first, equal ids by text;
    after the last, the first). A null text counts as empty; a lone document follows itself.
    Other columns are ignored; no rows give no rows.
    """

    def run(batches):
        before = None
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part, out = b.slice(at, 1000), []
                for doc_id, text, last in zip(part.column(0).to_pylist(), texts(part.column(1)), part.column(2).to_pylist()):
                    if last and before is None:
                        continue
                    own = signatures(text)
                    if before is not None:
                        i, t, s = before
                        changed = edited(t, text)
                        e = signatures(changed)
                        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), digest(s), digest(e), jaccard(s, e), jaccard(s, own)))
                    before = None if last else (doc_id, text, own)
                if out:
                    yield batch(_COMPARED, *zip(*out))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_id_order(docs).mapInArrow(run, schema)
