"""Token counts of whole texts without token ids.

No piece of a whitespace-splitting SentencePiece model has its space mark after another
character, so merges never cross the start of a run of marks: a text is a bag of pre-tokens
(a run of spaces and what follows up to the next space) and its count is the sum of theirs.

1. Tasks count their pre-tokens; the shuffled sums are the corpus vocabulary, and every
   distinct pre-token is encoded once. Those of more than LONG characters go by their digest, so
   keys are short; they are encoded by the tasks that meet them.
2. The join to the documents' frequencies has two parts. The most frequent HEAD pre-tokens are
   broadcast, at most HEAD keys of LONG characters or a digest each, and joined in the tasks that
   count the documents.
3. All other pre-tokens of a document, with their frequencies, are shuffled and joined. Each is
   less frequent than HEAD others, so no key is hot. Sums by document end the work.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, id_text, materialize, texts

MARK = "▁"
HEAD, LONG = 300_000, 64
#: Distinct pre-tokens that a task holds before it passes its counts on.
HELD = 300_000
CONTEXT_LIMIT = 4096

_RUN = re.compile(f"{MARK}+[^{MARK}]*")
_COUNTS = pa.schema([("p", pa.string()), ("n", pa.int64()), ("pieces", pa.int64())])
_PIECES = pa.schema([("p", pa.string()), ("freq", pa.int64()), ("n_pieces", pa.int64())])
_FLAT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("rows", pa.int64()), ("n_bytes", pa.int64()), ("head", pa.int64()), ("p", pa.string()), ("n", pa.int64())])


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space mark; none of an empty text."""
    if not text:
        return []
    if text[0] == " " or "  " in text or MARK in text:
        return [m[1:] for m in _RUN.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def key(word: str) -> str:
    """What a pre-token is joined by: itself, or a mark and its digest if it is long."""
    return word if len(word) <= LONG else "\1" + hashlib.sha256(word.encode()).hexdigest()


@lru_cache(4)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    wide = [i for i in range(model.get_piece_size()) if MARK in model.id_to_piece(i).lstrip(MARK)]
    if wide:
        raise ValueError(f"pieces of {path} cross spaces, so pre-tokens cannot be counted apart: {wide[:3]}")
    return model


def piece_counts(path: str, words: list[str]) -> list[int]:
    """Pieces of each pre-token, as it stands inside a text."""
    model = _model(path)
    counts = list(map(len, model.encode([w.replace(MARK, " ") for w in words], num_threads=1)))
    if "" in words:  # a single space before the end of a text; alone, the model would drop it
        alone = len(model.encode("a ")) - len(model.encode("a"))
        counts = [n if w else alone for w, n in zip(words, counts)]
    return counts


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """(p, freq, n_pieces): the key of every distinct pre-token of docs, its frequency and pieces."""

    def counted(held: Counter) -> pa.RecordBatch:
        words = list(held)
        long = [w for w in words if len(w) > LONG]
        known = dict(zip(long, piece_counts(path, long))) if long else {}
        return batch(_COUNTS, list(map(key, words)), list(held.values()), [known.get(w) for w in words])

    def count(batches):
        held: Counter = Counter()
        for b in batches:
            for t in texts(b.column(1)):
                held.update(pretokens(t))
                if len(held) > HELD:
                    yield counted(held)
                    held.clear()
        yield counted(held)

    def encode(batches):
        for b in batches:
            pieces = b.column(2)
            todo = pieces.is_null()
            new = piece_counts(path, b.column(0).filter(todo).to_pylist())
            yield batch(_PIECES, b.column(0), b.column(1), pc.replace_with_mask(pieces, todo, pa.array(new, pa.int64())))

    counts = id_text(docs).mapInArrow(count, "p string, n long, pieces long")
    counts = counts.groupBy("p").agg(F.sum("n").alias("freq"), F.max("pieces").alias("pieces"))
    return counts.mapInArrow(encode, "p string, freq long, n_pieces long")


def _head_frequency(vocab: DataFrame) -> int:
    """The least frequency at which no more than HEAD pre-tokens are left."""
    levels = vocab.groupBy(F.floor(F.log2("freq") * 8).cast("int").alias("level")).count()
    room, least = HEAD, None
    for level, n in sorted(map(tuple, levels.collect()), reverse=True):  # one row for an eighth of a power of two
        if n > room:
            break
        room, least = room - n, level
    return math.ceil(2 ** (least / 8) - 1e-9) if least is not None else 1 << 62


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of docs(doc_id, text, ...).

    A null text counts as empty: 0 bytes and 0 tokens. Rows that repeat a doc_id, or a whole
    row, are each returned. Other columns are ignored. Texts of any length are counted whole. No rows
    give no rows.
    """
    spark = docs.sparkSession
    vocab = materialize(vocabulary(docs, model_path))
    least = _head_frequency(vocab)
    in_head = F.col("freq") >= least
    head = vocab.where(in_head).select("p", "n_pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(head.column(0).to_pylist(), head.column(1).to_pylist())))

    def lookup(batches):
        table, met = known.value, 0
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids, sizes, sums, hashes, words, freqs, lengths = part.column(0).to_pylist(), [], [], [], [], [], []
                for t in texts(part.column(1)):
                    raw = t.encode()
                    sizes.append(len(raw))
                    hashes.append(xxhash.xxh64_intdigest(raw) - (1 << 63))
                    total, before = 0, len(words)
                    met += 1
                    words.append(f"\0{met}")  # the document's own row: its key matches nothing that counts
                    freqs.append(0)
                    for w, n in Counter(pretokens(t)).items():
                        w = key(w)
                        pieces = table.get(w)
                        if pieces is None:
                            words.append(w)
                            freqs.append(n)
                        else:
                            total += n * pieces
                    sums.append(total)
                    lengths.append(len(words) - before)
                starts = np.cumsum([0, *lengths[:-1]]) if lengths else np.empty(0, int)
                own = np.zeros(len(words), np.int64)
                own[starts] = 1
                spread = lambda x: np.repeat(np.array(x, np.int64), lengths)
                at_doc = np.repeat(np.arange(len(ids)), lengths)
                yield batch(_FLAT, pa.array(ids, pa.int64()).take(pa.array(at_doc)), spread(hashes), own, spread(sizes) * own, spread(sums) * own, words, freqs)

    flat = id_text(docs).mapInArrow(lookup, "doc_id long, th long, rows long, n_bytes long, head long, p string, n long")
    rest = vocab.where(~in_head).select("p", "n_pieces")
    by_doc = flat.join(rest, "p", "left").groupBy("doc_id", "th").agg(
        F.sum("rows").alias("rows"), F.sum("n_bytes").alias("n_bytes"), (F.sum("head") + F.sum(F.coalesce(F.col("n_pieces") * F.col("n"), F.lit(0)))).alias("n_tokens")
    )
    # copies of a row fell into one group: hand each its share
    return by_doc.select("doc_id", (F.col("n_bytes") / F.col("rows")).cast("long").alias("n_bytes"), (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("_copy")).drop("_copy")
