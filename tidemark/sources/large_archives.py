"""Archives that are larger than a task: the central directory first, then members dealt out by their bytes.

A task reads the end of an archive, where its directory is, and gives a row a member: name, place, sizes. Members are then dealt to tasks so that each
has about the same number of packed bytes, whatever archive they are of; a task seeks to its member and unpacks it as a
stream. So memory is bounded by a member, not by an archive, and one archive keeps many tasks busy. The store has to be one that Arrow reaches
(a seek is needed, which rows of binaryFile don't give); smaller archives on any store go through files.archive_rows.

An archive that can't be opened gives one row with its error, as does a member that can't be unpacked (a wrong checksum, a cut
file, a method that Python doesn't know); all others go on. An archive within an archive is a member like any other and is opened in its task.
Names that occur twice are two members, known by their places.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .csv_sink import _store
from .decode import archive_members, decoded, html_rows_and_links

DIRECTORY = "path string, member string, place long, packed long, size long, error string"
ROWS = "path string, member string, ordinal int, cells array<string>, error string"
_COLUMNS = [c.split()[0] for c in DIRECTORY.split(", ")]


class _Opened(io.RawIOBase):
    """A file of any store; a place before its start is the OSError that zipfile looks for."""

    def __init__(self, path: str):
        store, place = _store(path)
        self.file = store.open_input_file(place)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        return self.file.readinto(buffer)

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        to = offset + (0, self.file.tell(), self.file.size())[whence]
        if to < 0:
            raise OSError("a place before the file's start")
        return self.file.seek(to)

    def close(self) -> None:
        self.file.close()
        super().close()


def _opened(path: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BufferedReader(_Opened(path), 1 << 20))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                with _opened(path) as z:
                    rows = [(path, i.filename, i.header_offset, i.compress_size, i.file_size, None) for i in z.infolist() if not i.is_dir()]
            except Exception as e:  # any failure to open is the archive's status
                rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
            for k in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 20_000], strict=True), types, strict=True)], _COLUMNS)


def directory(spark: SparkSession, path: str | list[str], pattern: str = "*.zip") -> DataFrame:
    """path, member, place, packed, size, error of all members; only the archives' ends are read."""
    ship(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    return found.mapInArrow(_listed, DIRECTORY)


def dealt(members: DataFrame, task_bytes: int = 64 << 20) -> DataFrame:
    """members in partitions of about task_bytes packed bytes; a larger member is alone. A group of small ones stays within its archive."""
    before = F.sum("packed").over(Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    lot = F.floor(F.coalesce(before, F.lit(0)) / task_bytes)
    lots = members.filter("error IS NULL").withColumn("_lot", lot)
    n = lots.agg(F.coalesce(F.sum("packed"), F.lit(0))).first()[0]
    return lots.repartition(max(1, -(-n // task_bytes)), "path", "_lot").sortWithinPartitions("path", "place").drop("_lot")


def _pages(name: str, raw) -> Iterator[tuple[str, bytes]]:
    if name.lower().endswith(".zip"):
        yield from ((f"{name}!{n}", b) for n, b in archive_members(raw.read()))
    else:
        yield name, raw.read()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = pa.string()
    types, names = [s, s, pa.int32(), pa.list_(s), s], [c.split()[0] for c in ROWS.split(", ")]
    opened, at, held = None, None, []

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
        held.clear()
        return out

    try:
        for batch in batches:
            for path, member, place in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if path != at:
                    if opened:
                        opened.close()
                    opened, at = _opened(path), path
                    infos = {i.header_offset: i for i in opened.infolist()}
                try:
                    with opened.open(infos[place]) as raw:
                        for name, body in _pages(member, raw):
                            if name.lower().endswith((".html", ".htm")):
                                for n, cells in enumerate(html_rows_and_links(decoded(body))[0]):
                                    held.append((path, name, n, cells, None))
                                    if len(held) >= 20_000:
                                        yield flushed()
                except Exception as e:  # any failure to unpack is the member's status
                    held.append((path, member, None, None, f"{type(e).__name__}: {e}"))
        if held:
            yield flushed()
    finally:
        if opened:
            opened.close()


def table_rows(spark: SparkSession, path: str | list[str], pattern: str = "*.zip", task_bytes: int = 64 << 20) -> DataFrame:
    """path, member, ordinal, cells, error, as files.archive_rows gives them, with errors member by member."""
    members = directory(spark, path, pattern)
    rows = dealt(members, task_bytes).select("path", "member", "place").mapInArrow(_read, ROWS)
    broken = members.filter("error IS NOT NULL").select("path", F.lit(None).cast("string").alias("member"), F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("array<string>").alias("cells"), "error")
    return rows.unionByName(broken)
