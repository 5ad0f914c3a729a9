"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is lower-cased and cut into words; its features are the hashed words, their first four to
seven letters (for inflected words), pairs and triples of neighbours, and skip-grams: pairs with one
or two words between. Each counts once. FTRL-proximal gives every coordinate its own learning rate
and an L1 penalty, so most weights are exactly zero; the others are broadcast, at most BUCKETS
numbers.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, id_text, materialize, texts
from .labelled import held_out, training_rows

FOLDS, HELD, THRESHOLD = 4, 2, 0.3
#: Labelled rows that a model may be fitted on, the bytes that their bucket numbers may take on the driver (4 each),
#: and passes over them.
TRAIN_ROWS, TRAIN_BYTES, EPOCHS = 12_000, 400 << 20, 4
#: Hash buckets: the bound of what is broadcast (8 bytes for each weight).
BUCKETS = 1 << 20
ALPHA, BETA, L1, L2 = 0.3, 1.0, 8.0, 0.01
#: Letters of a word's starts.
STARTS = (4, 5, 6, 7)
#: Words whose hashes a worker remembers.
KEPT = 200_000

_WORD = re.compile(r"\w+")
_FEATURES = pa.schema([("label", pa.int32()), ("features", pa.binary())])
_COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int32())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


class _Hashes(dict):
    """Words to rows of a table: the hash of the word, then those of its starts."""

    def __init__(self):
        self.table = np.zeros((1 << 12, 1 + len(STARTS)), np.uint64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = [xxhash.xxh64_intdigest(f"{k}{word[:k]}".encode()) if k else xxhash.xxh64_intdigest(f"w{word}".encode()) for k in (0, *STARTS)]
        self[word] = at
        return at

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > KEPT:
            self.clear()
        at = list(map(self.__getitem__, words))
        return self.table[at]


@lru_cache(1)
def _hashes() -> _Hashes:
    return _Hashes()


# odd multipliers that tell the kinds of pairs and the sides of a pair apart
_NEAR, _NEXT, _OVER, _TWO, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x94D049BB133111EB))


def buckets(text: str) -> np.ndarray:
    """The buckets of a text's features, with repeats, in any order; none without words."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.int32)
    hashed = _hashes().of(words)
    w = hashed[:, 0]
    pairs = (w[:-1] * _NEAR ^ w[1:]) * _MIX
    grams = [pairs, (pairs[:-1] * _NEXT ^ w[2:]) * _MIX, (w[:-2] * _OVER ^ w[2:]) * _MIX, (w[:-3] * _TWO ^ w[3:]) * _MIX]
    return (np.concatenate([hashed.ravel(), *grams]) >> np.uint64(44)).astype(np.int32)


def feature_ids(text: str) -> np.ndarray:
    """The distinct buckets of a text's features, in order."""
    return np.unique(buckets(text))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-max(-35.0, min(35.0, x)))))


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, buckets, weights): the weights that are not zero after FTRL-proximal passes."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    bias, bias_n = float(np.log(rate / (1 - rate))), 1.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2), 0.0)
            g = _sigmoid(bias + w.sum()) - labels[i]
            n[at] = ni + g * g
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            bias_n += g * g
            bias -= 0.1 * g / np.sqrt(bias_n)
    w = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    at = np.flatnonzero(w)
    return bias, at.astype(np.int32), w[at].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAIN_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """A model from at most `limit` labelled rows outside the held-out fold.

    Executors hash the sample's texts and write bucket numbers; those come to the driver one partition
    at a time, in the order of a hash of theirs, until all are there or TRAIN_BYTES are. A text moves a coordinate by less than 1 in a pass, so one that no more than
    L1 / EPOCHS texts have never gets a weight: such buckets are left out beforehand, which changes
    no weight. Without rows of both classes the model is their rate alone.
    """
    sample = training_rows(id_text(docs), labels, label, FOLDS, HELD, limit).select("text", "label")

    def count(batches):
        n = np.zeros(BUCKETS, np.int32)
        for b in batches:
            for t in texts(b.column(0)):
                n[feature_ids(t)] += 1
        at = np.flatnonzero(n).astype(np.int32)
        yield batch(_COUNTS, pa.array(at), pa.array(n[at]))

    counts = sample.mapInArrow(count, "bucket int, n int").groupBy("bucket").agg(F.sum("n").alias("n"))
    usable = np.zeros(BUCKETS, bool)
    usable[counts.where(F.col("n") * EPOCHS > L1).select("bucket").toArrow().column(0).to_numpy()] = True  # BUCKETS rows at most
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(usable))

    def run(batches):
        kept = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            found = [ids[kept[ids]].tobytes() for ids in map(feature_ids, texts(b.column(0)))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.binary())], schema=_FEATURES)

    table = materialize(sample.mapInArrow(run, "label int, features binary"))
    rows, found, size = [], [], 0
    for r in table.orderBy(F.xxhash64("features"), "label").toLocalIterator():  # whatever order partitions came in
        if (size := size + len(r["features"])) > TRAIN_BYTES:
            break
        rows.append(np.frombuffer(r["features"], np.int32))
        found.append(r["label"])
    y = np.array(found, float)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return float(np.log(rate / (1 - rate))), np.empty(0, np.int32), np.empty(0, np.float32)
    return train(rows, y)


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text, ...).

    A null or empty text gets the score of the bias. Repeated rows are each returned; a null doc_id
    isn't held out; texts of any length are taken whole; no rows give no rows. Other columns of
    docs are never read.
    """
    bias, at, weights = model
    known = docs.sparkSession.sparkContext.broadcast((at, weights))

    def run(batches):
        dense = np.zeros(BUCKETS, np.float32)
        dense[known.value[0]] = known.value[1]

        def total(text: str) -> float:
            found = buckets(text)
            return float(dense[np.unique(found[dense[found] != 0])].sum(dtype=np.float64))  # few have a weight

        for b in batches:
            yield batch(_SCORES, b.column(0), [_sigmoid(bias + total(t)) for t in texts(b.column(1))])

    scored = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
