"""The prefix trie of conversations: succinct level-order tries for prefix shards, upper levels apart.

1. Turns get their place in their conversation and a digest; from here on no text is moved.
   Conversations are rebuilt, and a chained digest names each prefix.
2. Conversations that are equal are one path with a count, and the digest of their ids.
3. A prefix with more than SHARD turns of distinct paths below it is heavy. Where a path leaves the
   heavy prefixes a shard begins, so a shard is bounded, however many conversations share its
   beginning. A task takes whole shards, CHUNK turns at a time, and numpy builds one level-order
   trie of them: a LOUDS bit vector (a 1 for each child and a 0 to end, for each node, level by level) and
   the arrays of labels. The parents read off the bits carry the sums upwards, level by level from
   the last.
4. The heavy prefixes and the root are merged by Spark. What a shard's top or a heavy prefix adds is
   booked on one path, that of its smallest member; running sums from a path's end to its beginning give
   what the path adds to each heavy prefix on it, and one aggregate adds paths up.

A conversation's turns are put in order by a sort that can spill and pass a task one after another.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, batch, materialize, small_batches

#: Turns below a prefix from which it is heavy; turns of which tries are built at a time, from whole shards.
SHARD, CHUNK = 2_000, 50_000
#: Conversations with the same id but for the rest by REBASED begin like the one with rest 0, by fewer than HEADS turns.
REBASED, HEADS = 20, 4
#: Ids that are written out together before the digest of a path's members, as a power of two.
ID_BITS = 12
NO_MEMBERS = hashlib.sha256(b"").hexdigest()

_KEYED = pa.schema([("conv_id", pa.int64()), ("length", pa.int64()), ("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("words", pa.int64())])
_ENDS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("rep", pa.int64()), ("m", pa.int64()), ("sha", pa.string())])
_NODES = pa.schema([(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("sha", pa.string()), ("top", pa.bool_())])
_TRIES = pa.schema([("bits", pa.binary()), ("n_bits", pa.int64()), ("labels", pa.list_(pa.binary()))])
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


@dataclass(frozen=True)
class Louds:
    """Tries under one super-root (node 0) in level order: bits, two halves of each node's label (its prefix
    digest) from node 1 on, and the first node of each level."""

    bits: np.ndarray
    labels: np.ndarray
    levels: np.ndarray

    @classmethod
    def build(cls, level: np.ndarray, parent: np.ndarray, labels: np.ndarray) -> tuple["Louds", np.ndarray]:
        """The tries of nodes with a level, a parent (-1: the super-root) and labels, and each node's number in them."""
        n = len(level)
        number = np.zeros(n + 1, np.int64)  # the last entry stands for parent -1
        by_level = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[by_level], np.arange(level.max(initial=-1) + 2))
        order = np.empty(n, np.int64)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            here = by_level[lo:hi]
            here = here[np.lexsort((labels[here, 1], labels[here, 0], number[parent[here]]))]
            order[lo:hi] = here
            number[here] = np.arange(lo + 1, hi + 1)
        degrees = np.bincount(number[parent], minlength=n + 1)
        bits = np.ones(2 * n + 1, bool)
        bits[np.cumsum(degrees) + np.arange(n + 1)] = False
        return cls(bits, labels[order], bounds + 1), number[:n]

    def parents(self) -> np.ndarray:
        """Of nodes 1, 2, ...: the zeros before a node's own 1 count the nodes before its parent's."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def degrees(self) -> np.ndarray:
        """Children of nodes 0, 1, ...: the ones between two zeros."""
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """values of nodes 0, 1, ... summed over subtrees, level by level from the last."""
        total, parents = values.copy(), self.parents()
        for lo, hi in zip(self.levels[-2::-1], self.levels[:0:-1]):
            np.add.at(total, parents[lo - 1 : hi - 1], total[lo:hi])
        return total


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, label, words) of each turn, in order of turn; ties go by label, a digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    label = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", label.alias("label"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "label"))
    return turns.select("conv_id", pos.cast("long").alias("pos"), "label", "words")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, base, h, taken, length) of each conversation: it begins with the first `taken` turns of base,
    goes on with its own after its first h, and has length turns when rebuilt."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    named = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % REBASED, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS})
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    return named.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, length, depth, k1, k2, words) of each turn of the rebuilt conversations: (k1, k2) is the chained
    digest of all labels up to there."""
    tails = turns.join(convs, "conv_id").where("pos > h").select("conv_id", "length", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "label", "words")
    heads = turns.where(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base").join(convs, "base").where("pos <= h")
    rows = tails.unionByName(heads.select("conv_id", "length", F.col("pos").alias("depth"), "label", "words"))

    def chain(batches):
        at, state = None, b""
        for b in batches:
            keys = []
            for conv, label in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if conv != at:
                    at, state = conv, b""
                state = hashlib.blake2b(state + label, digest_size=16).digest()
                keys.append(state)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield batch(_KEYED, *(b.column(c) for c in (0, 1, 2)), k[:, 0].copy(), k[:, 1].copy(), b.column(4))

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return ordered.mapInArrow(chain, "conv_id long, length long, depth long, k1 long, k2 long, words long")


def paths_ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(k1, k2, rep, m, sha) of each distinct rebuilt conversation: its smallest id, how many are equal and the
    digest of their ids; (0, 0) for those without turns. Ids are written out in blocks, then digested in order."""
    ends = paths.where("depth = length").select("k1", "k2", "conv_id").unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id"))
    ids = F.array_sort(F.collect_list("conv_id"))  # 2 ^ ID_BITS at most
    blocks = ends.groupBy("k1", "k2", F.shiftright("conv_id", ID_BITS).alias("block")).agg(F.min("conv_id").alias("rep"), F.count("*").alias("m"), F.array_join(ids.cast("array<string>"), ",").alias("ids"))

    def digest(batches):
        at, rep, m, sha = None, 0, 0, None
        for b in batches:
            done = []
            for k1, k2, first, n, text in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "rep", "m", "ids"))):
                if (k1, k2) != at:
                    if at is not None:
                        done.append((*at, rep, m, sha.hexdigest()))
                    at, rep, m, sha = (k1, k2), first, 0, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.encode())
                m += n
            if done:
                yield batch(_ENDS, *map(list, zip(*done)))
        if at is not None:
            yield batch(_ENDS, [at[0]], [at[1]], [rep], [m], [sha.hexdigest()])

    return blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").mapInArrow(digest, "k1 long, k2 long, rep long, m long, sha string")


def heavy_prefixes(rows: DataFrame) -> DataFrame:
    """(k1, k2, depth, conv_id, n_convs, words, sha) of prefixes with more than SHARD turns of distinct paths from them on."""
    sums = rows.groupBy("k1", "k2", "depth").agg(F.min("rep").alias("conv_id"), F.sum("m").alias("n_convs"), F.max("words").alias("words"), F.max("sha").alias("sha"), F.sum(F.col("length") - F.col("depth") + 1).alias("below"))
    return sums.where(F.col("below") > SHARD).drop("below")


def _whole_shards(batches):
    """Arrow batches as tables of whole shards with CHUNK turns or so."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            s1, s2 = (table.column(c).to_numpy() for c in ("s1", "s2"))
            new = np.flatnonzero((s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])) + 1
            if len(new):
                yield table.slice(0, new[-1])
                held, n = table.slice(new[-1]).to_batches(), len(table) - new[-1]
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _forest(table: pa.Table) -> tuple[Louds, pa.RecordBatch]:
    """The tries of whole shards, whose rows are in order of shard, path and depth, and their nodes."""
    col = lambda c: table.column(c).to_numpy()
    k1, k2, rep, depth, m = map(col, ("k1", "k2", "rep", "depth", "m"))
    order = np.lexsort((k2, k1))
    fresh = np.r_[True, (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)]
    node = np.empty(len(k1), np.int64)
    node[order] = np.cumsum(fresh) - 1
    first = order[fresh]  # a row of each node
    begins = np.r_[True, np.diff(rep) != 0]  # a path lies in one shard
    start = np.maximum.accumulate(np.where(begins, np.arange(len(rep)), 0))
    before = np.where(begins, -1, np.r_[-1, node[:-1]])
    trie, number = Louds.build((depth - depth[start])[first], before[first], np.stack([k1[first], k2[first]], 1))
    n = len(first) + 1
    at = number[node]
    n_convs, conv = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    np.add.at(n_convs, at, m)
    np.minimum.at(conv, at, rep)
    words, level, up = (np.zeros(n, np.int64) for _ in range(3))
    words[number], level[number], up[number] = col("words")[first], depth[first], col("up")[first]
    degrees, parents = trie.degrees(), trie.parents()
    leaves = trie.rolled_up((degrees == 0).astype(np.int64))
    saved = trie.rolled_up(np.r_[0, (n_convs[1:] - 1) * words[1:]])
    sha = np.full(n, None, object)
    ended = np.flatnonzero(table.column("sha").is_valid().to_numpy())
    sha[at[ended]] = table.column("sha").take(pa.array(ended)).to_pylist()
    top = parents == 0
    nodes = batch(_NODES, conv[1:], level[1:], np.where(top, up[1:], conv[parents]), n_convs[1:], degrees[1:], leaves[1:], saved[1:], pa.array(sha[1:], pa.string()), top)
    return trie, nodes


@dataclass(frozen=True)
class Trie:
    """Written tables of a trie: convs, ends, the heavy prefixes, and rows (marked): each distinct path's
    prefixes with heavy (a heavy prefix's conv_id), up (the conv_id of a heavy parent) and the shard (s1, s2)."""

    convs: DataFrame
    ends: DataFrame
    heavy: DataFrame
    marked: DataFrame
    root_conv: int
    root_convs: int

    def shards(self) -> DataFrame:
        return self.marked.where("heavy is null").repartition("s1", "s2").sortWithinPartitions("s1", "s2", "rep", "depth")


def build(conversations: DataFrame) -> Trie | None:
    """The written tables from which tries and nodes are made; None if there is no conversation."""
    small_batches(conversations.sparkSession)
    turns = materialize(placed(conversations))
    convs = materialize(lengths(turns))
    root_convs, root_conv = convs.agg(F.count("*"), F.min("conv_id")).first()
    if not root_convs:
        return None
    paths = materialize(prefixes(turns, convs))
    ends = materialize(paths_ends(paths, convs))
    rows = paths.withColumnRenamed("conv_id", "rep").join(ends.select("rep", "m", F.col("sha").alias("_sha")), "rep")
    rows = materialize(rows.select("rep", "m", "length", "depth", "k1", "k2", "words", F.when(F.col("depth") == F.col("length"), F.col("_sha")).alias("sha")))
    heavy = materialize(heavy_prefixes(rows), compact=True)
    named = rows.join(heavy.select("k1", "k2", F.col("conv_id").alias("heavy")), ["k1", "k2"], "left")
    along = Window.partitionBy("rep").orderBy("depth")
    light = F.col("heavy").isNull()
    marks = {
        "s1": F.first(F.when(light, F.col("k1")), ignorenulls=True).over(along),
        "s2": F.first(F.when(light, F.col("k2")), ignorenulls=True).over(along),
        "up": F.coalesce(F.last("heavy", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(root_conv)),
    }
    return Trie(convs, ends, heavy, materialize(named.withColumns(marks)), root_conv, root_convs)


def louds_tries(trie: Trie) -> DataFrame:
    """(bits, n_bits, labels): the shards' tries, several shards under a super-root; bits are packed, highest first,
    and labels are the 16 bytes of each node's prefix digest, in level order."""

    def run(batches):
        for table in _whole_shards(batches):
            louds, _ = _forest(table)
            yield batch(_TRIES, [np.packbits(louds.bits).tobytes()], [len(louds.bits)], [[bytes(x) for x in np.ascontiguousarray(louds.labels).view("V16").ravel()]])

    return trie.shards().mapInArrow(run, "bits binary, n_bits long, labels array<binary>")


def shard_nodes(trie: Trie) -> DataFrame:
    """The nodes of all shards; top marks those under the root or a heavy prefix."""

    def run(batches):
        for table in _whole_shards(batches):
            _, nodes = _forest(table)
            for at in range(0, nodes.num_rows, 2_000):
                yield nodes.slice(at, 2_000)

    return trie.shards().mapInArrow(run, f"{NODES}, sha string, top boolean")


def upper_nodes(trie: Trie, nodes: DataFrame) -> DataFrame:
    """The root and the heavy prefixes, from the tops of shards and the paths through heavy prefixes."""
    zero = F.lit(0).cast("long")
    tops = nodes.where("top")
    on_paths = trie.marked.where("heavy is not null").select("rep", "depth", zero.alias("leaves"), zero.alias("saved"), "heavy", "up")
    nothing = F.lit(None).cast("long")
    added = tops.select(F.col("conv_id").alias("rep"), "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).unionByName(
        trie.heavy.select(F.col("conv_id").alias("rep"), "depth", zero.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    )
    from_end = Window.partitionBy("rep").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = added.withColumns({"heavy": nothing, "up": nothing}).unionByName(on_paths).select("heavy", "up", "depth", F.sum("leaves").over(from_end).alias("leaves"), F.sum("saved").over(from_end).alias("saved"))
    sums = running.where("heavy is not null").groupBy(F.col("heavy").alias("conv_id"), "depth").agg(F.min("up").alias("parent_conv_id"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    sums = materialize(sums, compact=True)
    children = tops.select("parent_conv_id", "depth").unionByName(sums.select("parent_conv_id", "depth"))
    children = children.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    heavy = trie.heavy.select("conv_id", "depth", "n_convs", "sha").join(sums, ["conv_id", "depth"]).join(children, ["conv_id", "depth"])
    names = [*(c.split()[0] for c in NODES.split(", ")), "sha"]
    no_sha = F.lit(None).cast("string")
    parts = added.select("leaves", "saved", zero.alias("n"), no_sha.alias("sha")).unionByName(children.where("depth = 0").select(zero.alias("leaves"), zero.alias("saved"), F.col("n_children").alias("n"), no_sha.alias("sha")))
    parts = parts.unionByName(trie.ends.where("k1 = 0 and k2 = 0").select(zero.alias("leaves"), zero.alias("saved"), zero.alias("n"), "sha"))
    total = parts.agg(*(F.coalesce(F.sum(c), zero).alias(to) for c, to in (("leaves", "n_leaves"), ("saved", "saved_tokens"), ("n", "n_children"))), F.max("sha").alias("sha"))
    root = total.withColumns(
        {"conv_id": F.lit(trie.root_conv).cast("long"), "depth": zero, "parent_conv_id": nothing, "n_convs": F.lit(trie.root_convs).cast("long"), "n_leaves": F.greatest("n_leaves", F.lit(1).cast("long"))}
    )
    return heavy.select(*names).unionByName(root.select(*names))


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node
    of the prefix trie of the rebuilt conversations.

    Turns are ordered by turn, null first; turns of the same number go by a digest of role and text, and
    repeated rows are turns of their own. Null roles and texts are empty; texts are digested and counted
    whole. Rows without a conv_id belong to no conversation. Conversations without turns once rebuilt are
    members of the root. No conversation gives no nodes. Other columns, of any name, are ignored.
    """
    trie = build(conversations)
    if trie is None:
        return conversations.sparkSession.createDataFrame([], f"{NODES}, ends_sha256 string")
    nodes = materialize(shard_nodes(trie))
    return nodes.drop("top").unionByName(upper_nodes(trie, nodes)).select("*", F.coalesce("sha", F.lit(NO_MEMBERS)).alias("ends_sha256")).drop("sha")
