"""Sheets as compressed parts that tasks make, and the archive that joins them.

Deflate streams can be joined where each is flushed, and so can the check sums of what they hold. So the
tasks that hold a sheet's rows write and compress them, PART rows at a time; whoever writes the
archive copies compressed bytes and works out sums and sizes from those of the parts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 1_000
LEVEL = 6
#: A part ends in a stored block of one byte, a line end. That byte isn't in its data: whoever writes the part adds it,
#: so lines of Spark's text sink can be parts.
END, _STORED = b"\n", b"\x00\x01\x00\xfe\xff"
_PARTS = pa.schema([("sheet", pa.int32()), ("segment", pa.int32()), ("part", pa.int64()), ("crc", pa.int64()), ("raw", pa.int64()), ("packed", pa.int64()), ("data", pa.binary())])
#: fixed value: the reflected polynomial of CRC-32
_POLYNOMIAL = 0xEDB88320
#: What XML 1.0 can't hold; it shows as U+FFFD.
FORBIDDEN = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"


def letters(n: int) -> str:
    """A for 1, AA for 27."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return F.when(text.rlike(FORBIDDEN), F.regexp_replace(text, FORBIDDEN, "�")).otherwise(text)


def plain_number(number: Column) -> Column:
    """A number as written without trailing zeros."""
    return F.regexp_replace(number.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")


def text_cell(column: int, at: Column, text: Column) -> Column:
    """A cell with a text; null for an empty one."""
    return F.when(text != "", F.concat(F.lit(f'<c r="{letters(column)}'), at, F.lit('" t="inlineStr"><is><t xml:space="preserve">'), escaped(text), F.lit("</t></is></c>")))


def number_cell(column: int, at: Column, number: Column) -> Column:
    """A cell with a number that is written plainly."""
    return F.when(number.isNotNull(), F.concat(F.lit(f'<c r="{letters(column)}'), at, F.lit('"><v>'), number, F.lit("</v></c>")))


def row(at: Column, cells: list[Column]) -> Column:
    return F.concat(F.lit('<row r="'), at, F.lit('">'), F.concat_ws("", *cells), F.lit("</row>"))  # concat_ws passes over nulls


def parts(rows: DataFrame) -> DataFrame:
    """(sheet, segment, part, crc, raw, packed, data) of rows(sheet, segment, at, row): at is a row's place. Each
    part is one flushed stretch of a deflate stream; crc, raw and packed count its END, which data lacks."""

    def close(key, made):
        raw, crc, out = made
        data = b"".join([*out[:-1], out[-1].flush(zlib.Z_FULL_FLUSH), _STORED])
        raw, crc = raw + len(END), zlib.crc32(END, crc)
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, crc, raw, len(data) + len(END), data), _PARTS)], schema=_PARTS)

    def compress(batches):
        at, made = None, None
        for b in batches:
            for *key, text in zip(*(b.column(c).to_pylist() for c in ("sheet", "segment", "part", "row"))):
                if key != at:
                    if made:
                        yield close(at, made)
                    at, made = key, [0, 0, [zlib.compressobj(LEVEL, zlib.DEFLATED, -15)]]
                data = text.encode()
                made[0] += len(data)
                made[1] = zlib.crc32(data, made[1])
                made[2].insert(-1, made[2][-1].compress(data))
        if made:
            yield close(at, made)

    keyed = rows.withColumn("part", F.expr(f"at div {PART}")).repartition("sheet", "segment", "part").sortWithinPartitions("sheet", "segment", "part", "at")
    return keyed.select("sheet", "segment", "part", "row").mapInArrow(compress, "sheet int, segment int, part long, crc long, raw long, packed long, data binary")


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32, highest power in the lowest bit."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """The CRC-32 of two stretches, of which the second has so many bytes: the first's is multiplied by x ^ (8 size)."""
    power, square = 1 << 31, 1 << 23  # 1 and x ^ 8
    while size:
        if size & 1:
            power = _times(power, square)
        square, size = _times(square, square), size >> 1
    return _times(power, first) ^ second


class Archive:
    """A ZIP archive written member by member, whose content is compressed already."""

    def __init__(self, out):
        self.out, self.at, self.directory = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, sums: Iterable[tuple[int, int, int]], data: Iterator[bytes]) -> None:
        """A member made of stretches with (crc, raw size, packed size), and their bytes in the same order."""
        crc = raw = 0
        packed = 2
        for c, r, p in sums:
            crc, raw, packed = joined_crc(crc, c, r), raw + r, packed + p
        begin, label = self.at, name.encode()
        large = max(raw, packed) >= 0xFFFFFFFF
        sizes = (0xFFFFFFFF, 0xFFFFFFFF) if large else (packed, raw)
        extra = struct.pack("<HHQQ", 1, 16, raw, packed) if large else b""
        common = struct.pack("<HHHHHLLLHH", 45, 0, 8, 0, 0x21, crc, *sizes, len(label), len(extra))
        self._put(b"PK\3\4" + common + label + extra)
        for piece in data:
            self._put(piece)
        self._put(b"\3\0")  # an empty last block
        if self.at - begin != 30 + len(label) + len(extra) + packed:
            raise RuntimeError(f"{name}: its bytes aren't those that its sums are of")
        more = struct.pack("<HHQQQ", 1, 24, raw, packed, begin)
        self.directory.append(b"PK\1\2" + struct.pack("<H", 45) + struct.pack("<HHHHHLLLHH", 45, 0, 8, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(label), len(more)) + struct.pack("<HHHLL", 0, 0, 0, 0, 0xFFFFFFFF) + label + more)

    def add_text(self, name: str, text: str) -> None:
        stretch = literal(text)
        self.add(name, [stretch[:3]], iter([stretch[3]]))

    def close(self, comment: bytes = b"") -> None:
        begin = self.at
        for entry in self.directory:
            self._put(entry)
        n, size, end = len(self.directory), self.at - begin, self.at
        self._put(b"PK\6\6" + struct.pack("<QHHLLQQQQ", 44, 45, 45, 0, 0, n, n, size, begin) + b"PK\6\7" + struct.pack("<LQL", 0, end, 1))
        self._put(b"PK\5\6" + struct.pack("<HHHHLLH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(begin, 0xFFFFFFFF), len(comment)) + comment)


class Part(bytes):
    """Stands for a part that tasks hold, of so many bytes."""

    def __new__(cls, key: tuple[int, int, int], size: int):
        one = super().__new__(cls)
        one.key, one.size = key, size
        return one

    def __len__(self) -> int:
        return self.size


class Gaps:
    """What an archive is written to where its parts stay with the tasks: the bytes before each, and after the last."""

    def __init__(self):
        self.before: dict[tuple[int, int, int], bytes] = {}
        self.rest = b""

    def write(self, data: bytes) -> None:
        if isinstance(data, Part):
            self.before[data.key], self.rest = self.rest, b""
        else:
            self.rest += data


def store(made: DataFrame, gaps: Gaps, path: str) -> None:
    """The archive as the one file in a folder of any store: parts(sheet, segment, part, data) and what stands
    between them. A file is one sequence, so one task writes it, of sorted parts one at a time; the driver
    knows their sizes only. The archive's comment is END."""
    spark, order = made.sparkSession, ["sheet", "segment", "part"]
    kind = "sheet int, segment int, part long, before binary"
    gap = spark.createDataFrame([(*key, bytearray(x)) for key, x in gaps.before.items() if x], kind)  # a row for each segment
    last = spark.createDataFrame([(2**31 - 1, 0, 0, bytearray(gaps.rest[: -len(END)]))], kind)
    rows = made.select(*order, "data").join(F.broadcast(gap), order, "left").select(*order, F.concat(F.coalesce("before", F.lit(bytearray())), "data").alias("data"))
    whole = rows.unionByName(last.withColumnRenamed("before", "data")).repartition(1).sortWithinPartitions(*order)
    whole.select(F.col("data").cast("string").alias("value")).write.text(path)


def literal(text: str) -> tuple[int, int, int, bytes]:
    """(crc, raw size, packed size, bytes) of a stretch that isn't made by tasks."""
    raw, stream = text.encode(), zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    data = stream.compress(raw) + stream.flush(zlib.Z_FULL_FLUSH)
    return zlib.crc32(raw), len(raw), len(data), data
