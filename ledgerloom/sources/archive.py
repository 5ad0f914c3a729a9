"""Documents inside ZIP archives.

An archive of up to WHOLE bytes is a row and is read in a task; a larger one is read by byte ranges
(see ranges), in many tasks. The entries are the same.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cuts import numbered
from . import ranges

_ENTRY = pa.schema([("archive", pa.string()), ("no", pa.int64()), ("path", pa.string()), ("data", pa.binary()), ("error", pa.string())])
_ENTRIES = "archive string, no long, path string, data binary, error string"
#: Bytes up to which an archive is read whole.
WHOLE = 64 << 20


def junk(path: Column) -> Column:
    """Directories and what desktop systems leave behind."""
    base = F.element_at(F.split(path, "/"), -1)
    return path.startswith("__MACOSX/") | base.startswith("._") | path.endswith("/") | (base == ".DS_Store")


def is_document(path: Column) -> Column:
    return path.rlike(r"(?i)\.pdf$")


def unpacked(archives: DataFrame, data: bool = True) -> DataFrame:
    """(archive, no, path, data, error) of every entry of archives(path, content); data=False lists names
    without inflating anything. Also for streams of archives. One entry is held at a time.

    An entry that can't be inflated has its error; an archive that can't be opened is one row with
    its error and without a path.
    """

    def row(name, no, path, content, error):
        return ranges.of(_ENTRY, [name], [no], [path], [content], [error])

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content.as_py()))
                except Exception as e:  # noqa: BLE001  a broken archive must not stop the run
                    yield row(name, None, None, None, str(e) or type(e).__name__)
                    continue
                with z:
                    for no, entry in enumerate(z.infolist()):
                        inflated, error = None, None
                        if data and entry.filename.lower().endswith(".pdf"):
                            try:
                                inflated = z.read(entry)
                            except Exception as e:  # noqa: BLE001  nor must a broken entry
                                error = str(e) or type(e).__name__
                        yield row(name, no, entry.filename, inflated, error)

    return archives.select("path", "content").mapInArrow(run, _ENTRIES)


def by_ranges(spark: SparkSession, paths: list[str], data: bool = True) -> DataFrame:
    """unpacked() for archives of any size at these paths: no archive is held whole."""
    found = ranges.runs(spark, paths)
    directory = ranges.directories(found)
    listed = ranges.members(found, directory)
    nothing = F.lit(None)
    broken = directory.where("error is not null").select(F.col("file").alias("archive"), nothing.cast("long").alias("no"), nothing.cast("string").alias("path"), nothing.cast("binary").alias("data"), "error")
    names = listed.select(F.col("file").alias("archive"), "no", F.col("name").alias("path"), nothing.cast("binary").alias("data"), nothing.cast("string").alias("error"))
    if not data:
        return names.unionByName(broken)
    wanted = is_document(F.col("name"))
    read = ranges.contents(found, listed.where(wanted)).select(F.col("file").alias("archive"), "no", F.col("name").alias("path"), "data", "error")
    return names.where(~is_document(F.col("path"))).unionByName(read).unionByName(broken)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The archives at a path. The names of all reach the driver, so who reads them twice lists them once."""
    return spark.read.format("binaryFile").load(path)


def entries(spark: SparkSession, path: str | DataFrame, data: bool = True) -> DataFrame:
    """The entries of the archives at a path, or of listed ones, junk left out, with name and is_document; an archive
    that can't be opened counts as a document by its own name."""
    files = listed(spark, path) if isinstance(path, str) else path
    large = [r["path"] for r in files.where(F.col("length") > WHOLE).select("path").collect()]  # names of large files
    found = unpacked(files.where(F.col("length") <= WHOLE), data)
    if large:
        found = found.unionByName(by_ranges(spark, large, data))
    found = found.where(F.col("path").isNull() | ~junk(F.col("path")))
    at = F.coalesce("path", "archive")
    return found.withColumns({"name": F.element_at(F.split(at, "/"), -1), "is_document": F.col("path").isNull() | is_document(F.col("path"))})


def doc_id(archive: Column, path: Column, no: Column) -> Column:
    """What tells documents of all archives apart, also those of one name in one archive."""
    return F.concat_ws("!", archive, path, no.cast("string"))


_ID = ("archive", "path", "no")


def documents(found: DataFrame) -> DataFrame:
    """(doc_id, data, error) of the documents among entries."""
    return found.where("is_document").select(doc_id(*map(F.col, _ID)).alias("doc_id"), "data", "error")


def files(found: DataFrame) -> DataFrame:
    """(doc_id, doc_ord, file, error): the documents of all archives in one sequence by name, from 0 on;
    equal names by archive and path. Names are numbered, contents stay where they are."""
    names = found.where("is_document").select(doc_id(*map(F.col, _ID)).alias("doc_id"), F.col("name").alias("file"), "error", *_ID)
    placed = numbered(names, [F.collate("file", "es"), *map(F.col, _ID)], "doc_ord")
    return placed.select("doc_id", (F.col("doc_ord") - 1).cast("long").alias("doc_ord"), "file", "error")


def ignored(found: DataFrame) -> DataFrame:
    """(file, file_ord) of the entries of all archives that aren't documents."""
    others = found.where("not is_document").select("archive", F.col("path").alias("file"), "no")
    return numbered(others, [F.col("archive"), F.col("file"), F.col("no")], "file_ord").select("file", F.col("file_ord").cast("long").alias("file_ord"))
