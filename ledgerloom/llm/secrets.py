"""Secret scans: pattern matches, and candidates confirmed by the structure of what they encode.

Base kinds, leftmost and non-overlapping for each kind:
  assign  a credential name, an assignment sign and a value of 12 characters or more
  access  AKIA and capitals or digits, 18 characters or more
  hex     a run of lower-case hex digits, 16 or more
Confirmed kinds, reported only if their bytes parse, never by their length alone:
  jwt     a signed token: a base64url header that is a JSON object with "alg", a payload, a
          signature (empty in an unsigned token)
  pem     an armoured private key: its base64 body is DER, an OpenSSH key, OpenPGP packets that
          begin with a secret key, or the ciphertext that its DEK-Info header tells of. Line breaks
          may be real or written as backslash and letter, as in JSON and source code
  der     a private key without armour, in base64 or hex, on one line or several: a DER sequence
          whose nested lengths add up, or an OpenSSH key whose fields do
Base64 of base64 or of armour counts as what it holds. A key or token may stand directly after
letters and digits, and ends where its own lengths say: every run of encoded characters is decoded
once for each way to align it, and searched for beginnings. Only base64 of base64 has to begin a run.
The work is linear in the text but for keys that only seem to nest: it is then that of walking their values.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, small_batches, texts

# fixed values: the base patterns
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
# fixed values: the candidates
TOKEN_HEAD, TOKEN_MARK = re.compile(r"[A-Za-z0-9_-]{14,}"), re.compile(r"e[wy]")
TOKEN_REST = re.compile(r"\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?")
ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*): ?(.*)")
DER_START = re.compile(rb"(?=\x30(?:[\x00-\x7f]|\x81[\x80-\xff]|\x82[\x01-\xff].|\x83[\x01-\xff]..|\x84[\x01-\xff]...)\x02\x01[\x00-\x03])", re.DOTALL)
HEX_KEY, LISTED_HEX = re.compile(r"30:?[0-9A-Fa-f]{2}"), re.compile(r"(?:\\x[0-9A-Fa-f]{2}){7,}|0x[0-9A-Fa-f]{2}(?:,\s*0x[0-9A-Fa-f]{2}){6,}")
OPENSSH, PEM_START = b"openssh-key-v1\0", b"-----BEGIN "
# fixed values: runs of encoded bytes, and what may stand between the lines of a wrapped one
RUN64, RUN16 = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f:]+")
WRAP = re.compile(r"[ \t\"',\\+]*(?:\r?\n|(?:\\+r)?\\+n)[ \t\"',]*")
DEK_INFO = re.compile(r"[A-Z0-9-]+,(?:[0-9A-Fa-f]{2})+")
#: The smallest private key is a sequence of a version and an empty value: 7 bytes.
LEAST_KEY = 7

KINDS = ("assign", "access", "hex", "jwt", "pem", "der")
BASE = KINDS[:3]
ASSIGN_CHARS, ACCESS_CHARS = 12, 18


def _starters() -> str:
    """A pattern of the two characters that a base64 run begins with if it holds a key: those of a DER
    sequence (tag 0x30), an OpenSSH key, armour or a signed token, and of base64 of all these, again
    and again until nothing new comes (the first two characters decide the next two)."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    plain = [b"\x30" + bytes([n]) for n in range(256)] + [OPENSSH, PEM_START]
    found = {base64.b64encode(p)[:2] for p in plain} | {b"ey", b"ew"}
    new = found
    while new:
        new = {base64.b64encode(p)[:2] for p in new} - found
        found |= new
    by_first: dict[str, str] = {}
    for p in sorted(x.decode() for x in found - {b"ey", b"ew"}):
        by_first[p[0]] = by_first.get(p[0], "") + p[1]
    assert all(c in letters for c in by_first)
    return "|".join(f"{a}[{re.escape(b)}]" for a, b in by_first.items())


BASE64_KEY = re.compile(rf"(?<![A-Za-z0-9])(?:{_starters()})(?=[A-Za-z0-9+/_-]{{{-(-LEAST_KEY * 8 // 6) - 2}}})")
PLAIN64 = re.compile(r"(?=(?:M[A-P]|b3|LS)[A-Za-z0-9+/_-]{8})")  # the first letters of a DER sequence, an OpenSSH key, armour
NESTED = re.compile(rf"(?:{_starters()}|e[wy])".encode())


def unbase64(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, padded or not; None if it isn't base64."""
    text = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_head(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, where the content begins, where it ends) of the DER value at a place."""
    if at + 2 > end:
        return None
    tag, at = data[at], at + 1
    if tag & 0x1F == 0x1F:  # a tag of several bytes
        while at < end and data[at] & 0x80:
            at += 1
        at += 1
        if at >= end:
            return None
    size, at = data[at], at + 1
    if size >= 0x80:
        n = size & 0x7F
        if not n or at + n > end:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        if size < 0x80 or n > 1 and size >> (8 * (n - 1)) == 0:
            return None
        at += n
    return tag, at, at + size


class Der:
    """Bytes whose DER values are walked from many places. What walks have found is kept: how far
    valid values follow a place without a gap, and the places where no valid value begins; so walks
    that meet don't go the same way twice."""

    def __init__(self, data: bytes):
        self.data, self.far, self.dead, self.whole = data, {}, set(), set()

    def fills(self, begin: int, end: int) -> bool:
        """Whether DER values fill the bytes from begin to end exactly; constructed ones must nest likewise, to any depth."""
        todo = [[begin, end, []]]  # where, the end, places on the way
        while todo:
            at, end, way = todo[-1]
            if at == end:
                self._met(way, at)
                todo.pop()
                if todo:
                    outer = todo[-1]
                    self.whole.add(outer[0])
                    outer[2].append(outer[0])
                    outer[0] = at
                continue
            if at < (far := self.far.get(at, 0)) <= end:
                way.append(at)
                todo[-1][0] = far
                continue
            head = None if at in self.dead else _der_head(self.data, at, len(self.data))
            if head is None or head[2] > end:
                if head is None:
                    self.dead.add(at)
                self._met(way, at)
                for at, _, way in todo[:-1]:
                    self.dead.add(at)
                    self._met(way, at)
                return False
            if head[0] & 0x20 and at not in self.whole:
                todo.append([head[1], head[2], []])
            else:
                way.append(at)
                todo[-1][0] = head[2]
        return True

    def _met(self, way: list[int], at: int) -> None:
        for place in way:
            self.far[place] = at

    def key_size(self, at: int) -> int | None:
        """How many bytes the private key has that begins at a place: a DER sequence that begins with a version
        number 0 to 3 and holds further values, or an OpenSSH key whose length-prefixed fields fit."""
        if self.data.startswith(OPENSSH, at):
            return _openssh_size(self.data, at)
        head = _der_head(self.data, at, len(self.data)) if self.data[at : at + 1] == b"\x30" else None
        if head is None or head[2] > len(self.data) or not re.match(rb"\x02\x01[\x00-\x03]", self.data[head[1] : head[1] + 3]):
            return None
        after = head[1] + 3
        return head[2] - at if after < head[2] and self.fills(after, head[2]) else None


def _openssh_size(data: bytes, begin: int) -> int | None:
    """How many bytes the OpenSSH key at a place of data has by its fields' lengths."""
    at = begin + len(OPENSSH)
    step = lambda at: at + 4 + int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else len(data) + 1
    for _ in range(3):  # cipher, key derivation and its options
        at = step(at)
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    for _ in range(keys + 1):  # public keys, then the private ones
        if (at := step(at)) > len(data):
            return None
    return at - begin


def private_key(data: bytes | None) -> bool:
    """Whether bytes are a private key, from their first to their last."""
    size = Der(data).key_size(0) if data else None
    return size is not None and (size == len(data) or data.startswith(OPENSSH))


def _secret_packets(data: bytes) -> bool:
    """Whether bytes are OpenPGP packets whose lengths add up, a secret key first."""
    at, first = 0, None
    while at < len(data):
        head, at = data[at], at + 1
        if not head & 0x80:
            return False
        if head & 0x40:  # new format
            tag, size = head & 0x3F, data[at] if at < len(data) else 224
            if size < 192:
                at += 1
            elif size < 224:
                size, at = (size - 192 << 8) + int.from_bytes(data[at + 1 : at + 2], "big") + 192, at + 2
            elif size == 255:
                size, at = int.from_bytes(data[at + 1 : at + 5], "big"), at + 5
            else:
                return False
        else:
            tag, n = head >> 2 & 15, 1 << (head & 3)
            if n == 8:
                return False
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        first = tag if first is None else first
        at += size
    return at == len(data) and first in (5, 7)


def armoured_key(body: str, label: str) -> bool:
    """Whether what stands inside armour is a private key."""
    headers, lines = {}, []
    for line in re.sub(r"\\+[rnt]", "\n", body).split("\n"):
        line = re.sub(r"^[\"'`]|[\"'`]\s*[,+;]?$", "", line.strip().rstrip("\\").rstrip())
        if m := HEADER.fullmatch(line):
            headers[m[1]] = m[2]
        elif not (line.startswith("=") and label.endswith("BLOCK")):  # a checksum
            lines.append(line)
    data = unbase64("".join(lines))
    if not data:
        return False
    if label.endswith("BLOCK"):
        return _secret_packets(data)
    if "DEK-Info" in headers:
        return DEK_INFO.fullmatch(headers["DEK-Info"].strip()) is not None and len(data) % 8 == 0
    return private_key(data) or data[0] == 0x30 and Der(data).fills(0, len(data))


def _object_start(data: bytes) -> int | None:
    """Where the JSON object begins that ends data: braces outside strings are counted from the end. A quote
    ends or begins a string unless an odd number of backslashes stands before it."""
    depth, inside = 0, False
    for m in reversed(list(re.finditer(rb'\\*"|[{}]', data.rstrip()))):
        if m[0].endswith(b'"'):
            inside ^= len(m[0]) % 2 == 1
        elif not inside:
            depth += 1 if m[0] == b"}" else -1
            if depth <= 0:
                return m.start() if depth == 0 else None
    return None


def _tokens(text: str) -> list[tuple[str, int, int]]:
    """Signed tokens: a run of base64url whose end is a JSON object with "alg", then payload and signature;
    an encrypted one has two parts more. Each run is decoded once for each alignment of a mark in it."""
    out, taken = [], 0
    for run in TOKEN_HEAD.finditer(text):
        if run.start() < taken or not text.startswith(".", run.end()) or not (rest := TOKEN_REST.match(text, run.end())) or unbase64(rest[1]) is None:
            continue
        chars, best = run[0], None
        for r in sorted({m.start() % 4 for m in TOKEN_MARK.finditer(chars)}):
            data = unbase64(chars[r:])
            start = _object_start(data) if data and data.rstrip().endswith(b"}") else None
            if start is None or start % 3:
                continue
            try:
                head = json.loads(data[start:])
            except (ValueError, UnicodeDecodeError, RecursionError):
                continue
            if isinstance(head, dict) and isinstance(head.get("alg"), str):
                at = run.start() + r + start // 3 * 4
                if best is None or at < best[0]:
                    best = at, rest.end() if "enc" in head else rest.end(2)
        if best:
            out.append(("jwt", *best))
            taken = best[1]
    return out


class _Lines:
    """The encoded characters of a text from a place on, over the ends of lines, as far as asked."""

    def __init__(self, text: str, at: int, run: re.Pattern):
        self.text, self.next, self.run, self.inside = text, at, run, False
        self.chars, self.counts, self.places = "", [0], []

    def upto(self, n: int) -> str:
        parts, have = [self.chars], len(self.chars)
        while have < n and self.next is not None:
            m = self.run.match(self.text, self.next, self.next + n - have + 2)
            if m:
                parts.append(m[0])
                self.places.append(m.start())
                have += len(m[0])
                self.counts.append(have)
                self.next, self.inside = m.end(), True
            else:
                wrap = WRAP.match(self.text, self.next) if self.inside else None
                self.next, self.inside = wrap.end() if wrap else None, False
        self.chars = "".join(parts)
        return self.chars[:n]

    def end(self, n: int) -> int:
        """Where in the text the n-th character ends."""
        k = bisect_left(self.counts, n) - 1
        return self.places[k] + n - self.counts[k]

    def start(self, n: int) -> int:
        """Where in the text the character begins that n others stand before."""
        return self.end(n + 1) - 1


def _padded(text: str, end: int) -> int:
    while end < len(text) and text[end] == "=":
        end += 1
    return end


def _chars(size: int) -> int:
    """Characters of base64 without padding for so many bytes."""
    return -(-size * 8 // 6)


class _Tried:
    """Runs that were decoded before: their ends with the place of their start modulo 4."""

    def __init__(self):
        self.end, self.runs = 0, set()

    def run(self, text: str, at: int) -> int:
        if at >= self.end:
            self.end = RUN64.match(text, at).end()
        return self.end


def _base64_key(text: str, at: int, tried: _Tried) -> tuple[str, int] | None:
    """(kind, end) of what is in base64 of text at a place of the text: a key in base64 again, armour or a token."""
    lines = _Lines(text, at, RUN64)
    begin = unbase64(lines.upto(24)) if len(lines.upto(24)) % 4 != 1 else unbase64(lines.upto(24)[:-1])
    if not begin:
        return None
    if not begin.startswith((OPENSSH, PEM_START)) and not NESTED.match(begin):
        return None
    run = tried.run(text, at)
    if (run, (run - at) % 4) in tried.runs:
        return None
    tried.runs.add((run, (run - at) % 4))
    everything = lines.upto(len(text))
    tried.runs |= {(place + n - before, (n - before) % 4) for place, before, n in zip(lines.places, lines.counts, lines.counts[1:]) if before % 4 == 0}
    for chars in dict.fromkeys((everything, text[at:run])):  # all lines, else the first
        data = unbase64(chars if len(chars) % 4 != 1 else chars[:-1])
        if not data:
            continue
        if data.startswith(OPENSSH):
            if (size := _openssh_size(data, 0)) is not None:
                return "der", _padded(text, lines.end(_chars(size)))
            continue
        plain = re.match(rb"[\t\n\r -~]*", data)[0].decode()
        if inner := structures(plain):
            return inner[0][0], _padded(text, lines.end(min(_chars(max(e for *_, e in inner)), len(chars))))
    return None


def _keys(data: bytes, step: int = 1) -> list[tuple[int, int]]:
    """(start, size) of the private keys in data that begin at a multiple of step, none in another."""
    out, taken, der = [], 0, Der(data)
    starts = [m.start() for m in DER_START.finditer(data)] + [m.start() for m in re.finditer(re.escape(OPENSSH), data)]
    for at in sorted(starts):
        if at >= taken and at % step == 0 and (size := der.key_size(at)) is not None:
            out.append((at, size))
            taken = at + size
    return out


def _in_base64(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of private keys and armour in base64, wherever in a run they begin."""
    out, run_end = [], 0
    for m in PLAIN64.finditer(text):
        if m.start() < run_end:
            continue
        lines = _Lines(text, m.start(), RUN64)
        chars = lines.upto(len(text))
        run_end = lines.end(len(chars))
        for r in {x.start() % 4 for x in PLAIN64.finditer(chars)}:
            n = (len(chars) - r) // 4 * 4 + ((len(chars) - r) % 4 if (len(chars) - r) % 4 > 1 else 0)
            data = unbase64(chars[r : r + n])
            found = [("der", at, size) for at, size in _keys(data, 3)]
            if PEM_START in data:
                found += [("pem", a, b - a) for _, a, b in _armoured(data.decode("latin-1")) if a % 3 == 0]
            for kind, at, size in found:
                first = r + at // 3 * 4
                out.append((lines.start(first), kind, _padded(text, lines.end(first + _chars(size)))))
    return out


def _in_hex(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of private keys in hex: bare, with colons, on lines, or as listed bytes."""
    out, run_end = [], 0
    for m in HEX_KEY.finditer(text):
        if m.start() < run_end:
            continue
        lines = _Lines(text, m.start(), RUN16)
        chars = lines.upto(len(text))
        if not chars:
            continue
        run_end = lines.end(len(chars))
        places = [i for i, c in enumerate(chars) if c != ":"] if ":" in chars else range(len(chars))
        digits = chars.replace(":", "")
        for r in (0, 1):
            for at, size in _keys(bytes.fromhex(digits[r : r + (len(digits) - r) // 2 * 2])):
                first, last = r + 2 * at, r + 2 * (at + size) - 1
                out.append((lines.start(places[first]), "der", lines.end(places[last] + 1)))
    for m in LISTED_HEX.finditer(text) if "x30" in text else ():
        bytes_ = list(re.finditer(r"x([0-9A-Fa-f]{2})", m[0]))
        for at, size in _keys(bytes.fromhex("".join(x[1] for x in bytes_))):
            out.append((m.start() + bytes_[at].start() - 1, "der", m.start() + bytes_[at + size - 1].end()))
    return out


def _armoured(text: str) -> list[tuple[str, int, int]]:
    """Every BEGIN with the first END after it, if that has the same label."""
    marks = list(ARMOUR.finditer(text))
    pairs = [(a, b) for a, b in zip(marks, marks[1:]) if (a[1], b[1]) == ("BEGIN", "END") and a[2] == b[2]]
    return [("pem", a.start(), b.end()) for a, b in pairs if armoured_key(text[a.end() : b.start()], a[2])]


def structures(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the confirmed kinds by start; of overlapping ones the armoured or
    else the first."""
    found = _armoured(text) if "PRIVATE KEY" in text else []
    if "." in text:
        found += _tokens(text)
    found.sort(key=lambda f: f[1])
    taken, out = 0, []
    tried = _Tried()
    candidates = _in_base64(text) + _in_hex(text) + [(m.start(), "", 0) for m in BASE64_KEY.finditer(text)]
    known = iter([*found, ("", len(text) + 1, 0)])
    ahead = next(known)
    for at, kind, end in sorted(candidates, key=lambda c: (c[0], not c[1])):
        while ahead[1] <= at:
            taken = max(taken, ahead[2])
            ahead = next(known)
        if at < taken:
            continue
        got = (kind, end) if kind else _base64_key(text, at, tried)
        if got:
            out.append((got[0], at, got[1]))
            taken = got[1]
    return sorted(found + out, key=lambda f: (f[1], f[2]))


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS, then end; code points."""
    found = []
    lower = text.lower()
    if any(name in lower for name in ASSIGN_NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found += structures(text)
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>) for every row of docs(doc_id, text, ...).

    Spans are in code points, the end exclusive, in the order of scan(). A null or empty text
    has none; texts of any length are scanned whole, in linear time. Repeated rows are each returned;
    other columns are ignored; no rows give no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", kind)])

    def run(batches):
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in scan(t)] for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], schema=schema)

    return id_text(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def masked(text: str) -> str:
    """The text with every reported span replaced by its kind; overlapping spans are joined."""
    out, at = [], 0
    for kind, start, end in scan(text):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs with the secrets of text replaced by <kind> and n_chars, if there, counted anew.

    Null texts stay null; rows without a secret stay as they are, and so do all other columns,
    whatever their names. Repeated rows are each returned; no rows give no rows.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            changed = pa.array([t if t is None else masked(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([changed if i == at else c for i, c in enumerate(b.columns)], names=names)

    small_batches(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in names else out


def joined(spans):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of scan_documents' rows."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
