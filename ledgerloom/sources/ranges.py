"""Members of ZIP containers of any size, read by byte ranges.

Spark's text source cuts a file into splits and gives its bytes between line feeds as they are, also those
of a binary file. So a container is read by as many tasks as it has splits, in any store that Spark
reads. Its bytes are written once as runs of at most RUN bytes with their place; from there on every
step takes just the runs it needs: the end record, the directory, then for each member that is asked
for the slices between its header and the next one's. A member is inflated as a stream by one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.cuts import cut

#: Bytes of a run, and of what is passed on of a member at a time.
RUN = 1 << 20
#: An end record with the longest comment, and the records of large containers before it.
TAIL = 22 + 65_535 + 20 + 56

_RUNS = pa.schema([("file", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("inside", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
_DIRECTORY = pa.schema([("file", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("shift", pa.int64()), ("error", pa.string())])
_MEMBERS = pa.schema([("file", pa.string()), ("no", pa.int64()), ("name", pa.string()), ("method", pa.int32()), ("flags", pa.int32()), ("crc", pa.int64()), ("packed", pa.int64()), ("offset", pa.int64())])
_CONTENT = pa.schema([("file", pa.string()), ("no", pa.int64()), ("name", pa.string()), ("data", pa.binary()), ("error", pa.string())])


def of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, size, at, n, data): the bytes of files in runs, at being a run's place. A written table."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"))

    def gather(batches):
        at, held, n, inside = None, [], 0, 0
        for b in batches:
            for line, *split in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if split != at:
                    if held:
                        yield of(_RUNS, [at[0]], [at[2]], [at[1]], [inside], [n], [b"".join(held)])
                    at, held, n, inside = split, [], 0, 0
                line = line.as_py() + b"\n"
                for k in range(0, len(line), RUN):
                    part = line[k : k + RUN]
                    if n + len(part) > RUN:
                        yield of(_RUNS, [at[0]], [at[2]], [at[1]], [inside], [n], [b"".join(held)])
                        held, inside, n = [], inside + n, 0
                    held.append(part)
                    n += len(part)
        if held:
            yield of(_RUNS, [at[0]], [at[2]], [at[1]], [inside], [n], [b"".join(held)])

    found = cut(lines.mapInArrow(gather, "file string, size long, start long, inside long, n long, data binary"))
    splits = found.groupBy("file", "start").agg(F.sum("n").alias("whole"))
    before = F.coalesce(F.sum("whole").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.join(splits.select("file", "start", before.alias("base")), ["file", "start"])
    return placed.select("file", "size", (F.col("base") + F.col("inside")).alias("at"), "n", "data")


def slices(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(file, no, begin, end, ...) with at and slice: the bytes of each range as pieces of runs, in order
    within partitions that hold whole ranges."""
    bin_of = lambda c: F.floor(c / RUN)
    asked = wanted.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("begin")) - 1, bin_of(F.greatest(F.col("end") - 1, F.col("begin"))))))
    keyed = found.withColumn("_bin", bin_of(F.col("at")))
    met = keyed.join(asked, ["file", "_bin"]).where("begin < at + n and end > at")
    first, last = F.greatest("begin", "at"), F.least("end", F.col("at") + F.col("n"), "size")
    part = F.substring("data", (first - F.col("at") + 1).cast("int"), (last - first).cast("int"))
    rest = [c for c in wanted.columns if c not in ("file", "no")]
    return met.select("file", "no", *rest, first.alias("at"), part.alias("slice")).repartition("file", "no").sortWithinPartitions("file", "no", "at")


def _end_record(data: bytes, base: int) -> tuple[int, int, int]:
    """(where the directory begins, ends, what to add to its offsets) by the end record in a file's last bytes."""
    at = data.rfind(b"PK\5\6")
    if at < 0 or len(data) < at + 22:
        raise ValueError("no end record")
    size, offset = struct.unpack_from("<LL", data, at + 12)
    end = at
    if data[at - 20 : at - 16] == b"PK\6\7" and data[at - 76 : at - 72] == b"PK\6\6":
        end = at - 76
        size, offset = struct.unpack_from("<QQ", data, end + 40)
    begin = base + end - size
    if begin < 0:
        raise ValueError("its directory begins before the file")
    return begin, base + end, begin - offset


def directories(found: DataFrame) -> DataFrame:
    """(file, begin, end, shift, error): where each container's directory lies."""

    def read(batches):
        for b in batches:
            for file, pieces in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pieces.sort(key=lambda p: p["at"])
                try:
                    got = (*_end_record(b"".join(p["slice"] for p in pieces), pieces[0]["at"]), None)
                except Exception as e:  # noqa: BLE001  a broken container must not stop the run
                    got = (None, None, None, str(e) or type(e).__name__)
                yield of(_DIRECTORY, *([x] for x in (file, *got)))

    first = F.greatest("at", F.col("size") - TAIL)
    tail = found.where(F.col("at") + F.col("n") > F.col("size") - TAIL).select("file", first.alias("at"), F.substring("data", (first - F.col("at") + 1).cast("int"), (F.least(F.col("at") + F.col("n"), "size") - first).cast("int")).alias("slice"))
    gathered = tail.groupBy("file").agg(F.collect_list(F.struct("at", "slice")).alias("pieces"))  # TAIL bytes of each file
    return gathered.mapInArrow(read, "file string, begin long, end long, shift long, error string")


def _entries(buffer: bytes, no: int, shift: int) -> tuple[list[tuple], int, bool]:
    """Whole directory entries at the start of a buffer, how many bytes they take, and whether another kind of record follows."""
    out, at = [], 0
    while len(buffer) >= at + 46:
        if buffer[at : at + 4] != b"PK\1\2":
            return out, at, True
        flags, method, crc, packed, size, n, m, k, offset = struct.unpack_from("<HH4xLLLHHH8xL", buffer, at + 8)
        if len(buffer) < at + 46 + n + m + k:
            break
        name = buffer[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace").split("\0")[0]
        extra, end = at + 46 + n, at + 46 + n + m
        while extra + 4 <= end:
            kind, length = struct.unpack_from("<HH", buffer, extra)
            if kind == 1:  # numbers of 64 bits, in this order, for those that are full
                values = iter(struct.unpack_from(f"<{length // 8}Q", buffer, extra + 4))
                size, packed, offset = (next(values, x) if x == 0xFFFFFFFF else x for x in (size, packed, offset))
            extra += 4 + length
        out.append((no + len(out), name, method, flags, crc, packed, offset + shift))
        at += 46 + n + m + k
    return out, at, False


def members(found: DataFrame, directory: DataFrame) -> DataFrame:
    """(file, no, name, method, flags, crc, packed, begin, end): every member's place, up to the next one's. A
    directory is read as a stream."""

    def parse(batches):
        at, rest, no, over = None, b"", 0, False
        for b in batches:
            for file, shift, data in zip(*(b.column(c).to_pylist() for c in ("file", "shift", "slice"))):
                if file != at:
                    at, rest, no, over = file, b"", 0, False
                if over:
                    continue
                rest += data
                got, taken, over = _entries(rest, no, shift)
                rest, no = rest[taken:], no + len(got)
                for k in range(0, len(got), 5_000):
                    part = got[k : k + 5_000]
                    yield of(_MEMBERS, [file] * len(part), *map(list, zip(*part)))

    asked = directory.where("error is null and end > begin").select("file", F.lit(-1).cast("long").alias("no"), "begin", "end", "shift")
    listed = slices(found, asked).mapInArrow(parse, "file string, no long, name string, method int, flags int, crc long, packed long, offset long")
    following = F.lead("offset").over(Window.partitionBy("file").orderBy("offset", "no"))
    whole = listed.join(directory.select("file", F.col("begin").alias("_dir")), "file")
    return whole.withColumn("end", F.coalesce(following, "_dir")).withColumnRenamed("offset", "begin").drop("_dir")


def inflated(pieces: Iterator[bytes], method: int, flags: int, crc: int, packed: int) -> Iterator[bytes]:
    """The content of a member from the bytes after its place, checked at its end."""
    if flags & 1:
        raise ValueError("it is encrypted")
    if method not in (0, 8):
        raise ValueError(f"unknown compression method {method}")
    head = b""
    for piece in pieces:
        head += piece
        if len(head) >= 30 and len(head) >= 30 + sum(struct.unpack_from("<HH", head, 26)):
            break
    if head[:4] != b"PK\3\4":
        raise ValueError("its header is missing")
    piece, left, sum_ = head[30 + sum(struct.unpack_from("<HH", head, 26)) :], packed, 0
    stream = zlib.decompressobj(-15) if method else None
    while True:
        piece = piece[:left]
        left -= len(piece)
        while piece:
            out = stream.decompress(piece, RUN) if stream else piece
            piece = stream.unconsumed_tail if stream else b""
            if out:
                sum_ = zlib.crc32(out, sum_)
                yield out
        if not left or (piece := next(pieces, None)) is None:
            break
    if stream and (out := stream.flush()):
        sum_ = zlib.crc32(out, sum_)
        yield out
    if left or sum_ != crc or stream and not stream.eof:
        raise ValueError("bad checksum")


def members_of(batches) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """(a member's row, its slices) from Arrow batches in order of members; what isn't taken of one is passed over."""

    def rows():
        for b in batches:
            for k in range(b.num_rows):
                yield {name: b.column(name)[k] for name in b.schema.names}

    source = rows()
    row = next(source, None)
    while row is not None:
        now, key = {k: v.as_py() for k, v in row.items() if k != "slice"}, (row["file"], row["no"])

        def own():
            nonlocal row
            while row is not None and (row["file"], row["no"]) == key:
                data = row["slice"].as_py()
                row = next(source, None)
                yield data

        mine = own()
        yield now, mine
        for _ in mine:
            pass


def contents(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, no, name, data, error) of members; one is held whole at a time."""

    def read(batches):
        for m, pieces in members_of(batches):
            data, error = None, None
            try:
                data = b"".join(inflated(pieces, m["method"], m["flags"], m["crc"], m["packed"]))
            except Exception as e:  # noqa: BLE001  a broken member must not stop the run
                error = str(e) or type(e).__name__
            yield of(_CONTENT, [m["file"]], [m["no"]], [m["name"]], [data], [error])

    return slices(found, wanted).mapInArrow(read, "file string, no long, name string, data binary, error string")


