"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

The encoder never merges. An Aho-Corasick automaton over the vocabulary gives the longest token
at every position; tokens are laid left to right, and a token may follow another only if the
pair is compatible: merging the two tokens' own characters would not join across their border
earlier. Where the longest token doesn't fit, its longest prefix that is a token is tried, then
the token before it. Each position is given up once at most, so the work is linear, and the
result is exactly that of the merges.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, texts

#: fixed value: how byte-level BPE cuts a text before it merges
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker keeps of pre-tokens and of pairs that it has met.
KEPT_WORDS, KEPT_PAIRS, KEPT_CHARS = 160_000, 80_000, 32
#: Rows of an Arrow batch that goes back to the JVM.
OUT_ROWS = 500


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 letters for
    themselves, all others by the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Decoder:
    """Where each id's bytes begin and end in one string."""

    def __init__(self, path: str):
        spec, to_byte = _spec(path), byte_letters()
        by_id = {i: bytes(to_byte[c] for c in token) for token, i in spec["model"]["vocab"].items() if all(c in to_byte for c in token)}
        by_id |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        pieces = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.offsets = np.cumsum([0, *map(len, pieces)])
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, by gathering every id's bytes from the offset table."""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        shift = starts - np.cumsum(sizes) + sizes
        return self.blob[np.repeat(shift, sizes) + np.arange(sizes.sum())].tobytes().decode("utf-8", "replace")


class Vocabulary:
    """A byte-level BPE vocabulary file. Tokens are numbered here by merge order: the bytes,
    then each merge's result; ids of the file are mapped at the end."""

    def __init__(self, path: str):
        spec = _spec(path)
        model, to_byte = spec["model"], byte_letters()
        raw = lambda token: bytes(to_byte[c] for c in token)
        ids = model["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        letters = [c for c in to_byte if c in ids]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        order = {c: n for n, c in enumerate(letters)}
        self.left, self.right = list(range(len(letters))), list(range(len(letters)))
        self.pair: dict[tuple[int, int], int] = {}
        names = list(letters)
        for a, b in merges:
            x, y = order[a], order[b]
            n = order.setdefault(a + b, len(names))
            if n == len(names):
                names.append(a + b)
                self.left.append(x)
                self.right.append(y)
            self.pair.setdefault((x, y), n)
        self.bytes = [raw(name) for name in names]
        self.ids = [ids[name] for name in names]
        self.length = list(map(len, self.bytes))
        known = {b: n for n, b in enumerate(self.bytes)}
        self.prefix = [next((known[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in known), -1) for b in self.bytes]
        self.automaton = ahocorasick.Automaton()
        for b, n in known.items():
            self.automaton.add_word(b.decode("latin-1"), n)
        self.automaton.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.met: dict[int, bool] = {}  # by left token << 32 | right token
        self.words: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether a followed by b stays two tokens: taken apart from the latest merge back, no
        merge across the border would have come before the merges that made the two sides."""
        x, y, limit = a, b, 1 << 62
        while True:
            if self.pair.get((x, y), limit) < limit:
                ok = False
                break
            # undo the later of the two merges; at a tie of one token with itself the right one is later
            if x > y:
                limit = x
                if self.left[x] == x:
                    ok = True
                    break
                x = self.right[x]
            else:
                limit = y + 1
                if self.left[y] == y:
                    ok = self._left_down(x, y, limit)
                    break
                y = self.left[y]
        if len(self.met) < KEPT_PAIRS:
            self.met[a << 32 | b] = ok
        return ok

    def _left_down(self, x: int, y: int, limit: int) -> bool:
        """compatible() once the right side is a single byte: only the left side is taken apart."""
        while self.left[x] != x:
            limit = min(limit, x)
            x = self.right[x]
            if self.pair.get((x, y), limit) < limit:
                return False
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """Token numbers of one pre-token."""
        n, length, prefix, known = len(word), self.length, self.prefix, self.met.get
        longest = [0] * (n + 1)
        for end, token in self.automaton.iter(word.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # ends grow, so the longest comes last
        open_at = bytearray(b"\1") * (n + 1)
        laid: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            end = at + length[token]
            fits = open_at[end] and (last < 0 or known(last << 32 | token))
            if fits is None:
                fits = self.compatible(last, token)
            if fits:
                laid.append(token)
                at, last, token = end, token, longest[end]
            elif (shorter := prefix[token]) >= 0:
                token = shorter
            else:
                open_at[at] = 0
                token = laid.pop()
                last = laid[-1] if laid else -1
                at -= length[token]
        return laid

    def word_ids(self, word: str) -> bytes:
        """The ids of one pre-token as 32-bit integers, remembered for short ones."""
        if (found := self.words.get(word)) is None:
            ids = self.ids
            found = np.array([ids[t] for t in self.encode_word(word.encode())], np.int32).tobytes()
            if len(self.words) < KEPT_WORDS and len(word) <= KEPT_CHARS:
                self.words[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; special tokens written out in it count as themselves."""
        out, at = [], 0
        if self.special_pattern is not None:
            for m in self.special_pattern.finditer(text):
                out += map(self.word_ids, self.pattern.findall(text[at : m.start()]))
                out.append(np.int32(self.special[m[0]]).tobytes())
                at = m.end()
        out += map(self.word_ids, self.pattern.findall(text[at:] if at else text))
        return np.frombuffer(b"".join(out), np.int32)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs(doc_id, text, ...).

    A null or empty text has no ids. Repeated rows are each returned; other columns are ignored; texts of any
    length are taken whole; no rows give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        voc = vocabulary(path)
        for b in batches:
            for at in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(at, OUT_ROWS)
                found = [voc.encode(t) for t in texts(part.column(1))]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], schema=schema)

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) for rows of encoded(doc_id, ids, ...); null or no ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches):
        table = decoder(path)
        for b in batches:
            for at in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(at, OUT_ROWS)
                lists = part.column(1)
                flat, ends = lists.flatten().to_numpy(), np.cumsum(np.r_[0, lists.value_lengths().fill_null(0).to_numpy()])
                decoded = [table.decode(flat[i:j]) for i, j in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, text) for every row of docs(doc_id, text, ...): its ids, and the text
    decoded from them again. decode(encode(docs)) in one Python worker a task instead of two in a chain,
    so an executor holds half the workers.

    A null or empty text has no ids and decodes to the empty text. Repeated rows are each returned;
    other columns are ignored; texts of any length are taken whole; no rows give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches):
        voc, table = vocabulary(path), decoder(path)
        for b in batches:
            for at in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(at, OUT_ROWS)
                found = [voc.encode(t) for t in texts(part.column(1))]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(map(table.decode, found), pa.string())], schema=schema)

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """Counts and digests of decode's rows."""
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return decoded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
