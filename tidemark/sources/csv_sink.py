"""CSV files for readers outside Spark, as a data source that can be written: files of about FILE_BYTES of text, and a manifest of them.

UTF-8 with a byte-order mark, a header, empty for null, ISO dates, floating point numbers with 17 digits, quotes where needed (quoted: around
all but nulls, which tells them from empty texts), plain or gzip; equal rows give equal bytes. A task hashes what it writes while it writes it and sends name, rows, bytes and hash along as its commit
message; when all tasks are done the driver removes files that no message names (of tasks that ran twice) and writes the manifest last. A
folder without a manifest is not whole. A job that fails leaves no files. The folder is any that Arrow reaches and all executors share.
"""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST, MARK = "_manifest.json", "﻿"
#: Text of a file before it is packed, after which a partition's rows go on in a next file, so that readers which take files whole stay small.
FILE_BYTES = 32 << 20


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)


def cell(value) -> str:
    """A value's text; null is empty."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return format(value, ".17g")
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return format(value, "f")
    return str(value)


def cells(column: pa.Array, null: str | None = "") -> list[str | None]:
    """The texts of a column, made once for each of its distinct values; null: what stands for null."""
    if pa.types.is_null(column.type) or pa.types.is_interval(column.type):
        return [cell(x) if x is not None else null for x in column.to_pylist()]
    if pa.types.is_floating(column.type):  # by their bits: zeros of both signs are values of their own
        bits = pa.int64() if column.type.bit_width == 64 else pa.int32()
        coded = column.view(bits).dictionary_encode()
        values = coded.dictionary.view(column.type)
    else:
        coded = column.dictionary_encode()
        values = coded.dictionary
    texts = [cell(x) for x in values.to_pylist()]
    return [texts[i] if i is not None else null for i in coded.indices.to_pylist()]


class _Hashed(io.RawIOBase):
    """A stream that knows how many bytes went through it, and their hash."""

    def __init__(self, out):
        self.out, self.bytes, self.hash = out, 0, hashlib.sha256()

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        self.hash.update(data)
        self.bytes += len(data)
        return len(data)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    bytes: int
    sha256: str


@dataclass
class Parts(WriterCommitMessage):
    """What one task wrote."""

    files: list[Written]


class CsvWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.names, self.sep = options["path"], schema.names, options.get("sep", ",")
        self.suffix = ".csv.gz" if options.get("compression", "none").lower() == "gzip" else ".csv"
        self.quoted = options.get("quoted", "false").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        store, root = _store(self.folder)
        store.create_dir(root, recursive=True)
        iterator = iter(iterator)
        made, batch = [], next(iterator, None)
        while batch is not None or not made:
            name, rows = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{self.suffix}", 0
            with store.open_output_stream(f"{root}/{name}", compression=None) as raw:
                hashed = _Hashed(raw)
                packed = gzip.GzipFile("", "wb", 6, fileobj=hashed, mtime=0) if self.suffix.endswith("gz") else None
                text = io.TextIOWrapper(io.BufferedWriter(packed or hashed, 1 << 20), encoding="utf-8", newline="")
                text.write(MARK)
                lines = csv.writer(text, delimiter=self.sep, lineterminator="\n", quoting=csv.QUOTE_NOTNULL if self.quoted else csv.QUOTE_MINIMAL)
                lines.writerow(self.names)
                while batch is not None and (packed.tell() if packed else hashed.bytes) < FILE_BYTES:
                    lines.writerows(zip(*(cells(c, None if self.quoted else "") for c in batch.columns), strict=True))
                    rows += batch.num_rows
                    batch = next(iterator, None)
                text.flush()
                if packed:
                    text.detach().flush()
                    packed.close()
            made.append(Written(name, rows, hashed.bytes, hashed.hash.hexdigest()))
        return Parts(made)

    def commit(self, messages: list[Parts | Written | None]) -> None:
        store, root = _store(self.folder)
        made = sorted((f for m in messages if m is not None for f in getattr(m, "files", [m])), key=lambda f: f.file)
        names = {f.file for f in made}
        store.create_dir(root, recursive=True)
        for found in store.get_file_info(pafs.FileSelector(root)):
            if found.base_name not in names:
                store.delete_file(found.path)
        with store.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps([asdict(f) for f in made], indent=1).encode())

    def abort(self, messages: list[Parts | Written | None]) -> None:
        store, root = _store(self.folder)
        if store.get_file_info(root).type != pafs.FileType.NotFound:
            store.delete_dir(root)


class PanelCsv(DataSource):
    """format("panel_csv"): options path, sep, compression (none or gzip) and quoted (true or false). Only new folders are written."""

    @classmethod
    def name(cls) -> str:
        return "panel_csv"

    def writer(self, schema: StructType, overwrite: bool) -> CsvWriter:
        store, root = _store(self.options["path"])
        if overwrite or store.get_file_info(root).type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.options['path']} already exists")
        return CsvWriter(dict(self.options), schema)
