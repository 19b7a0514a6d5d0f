"""Token ids as flat binary files with 64-bit document offsets, written and read by many tasks.

A data set is a folder. For partition p it holds
    p.tokens   the ids of its documents one after another, unsigned little-endian, 2 or 4 bytes each
    p.offsets  n + 1 signed 64-bit integers: where document i starts, in ids from the partition's start
    p.docs     n signed 64-bit document ids
Partitions follow each other in document order; a partition's base, the ids in all partitions before it, is
a prefix sum over the partitions' counts. Files are written under a name of their own and renamed when whole,
so a task that runs again replaces its files by equal ones. Readers map the files into memory where the folder
is on a local disk that all executors share, and read the same ranges through the file system elsewhere.

Encoding caches chunks of text, words with the blank before them and the marks after them: the library encodes
each distinct one once per worker, as long as the cache has room (CACHE entries), since it never merges across
them. How texts are cut is read from the tokenizer's file; see Encoder.

Rows of one id may be any share of the table: they are dealt to partitions by the head of their text, its hash and,
where rows are equal, by their place in the input. A partition takes about `part_bytes` of input, so files don't grow
with the table; readers hold CHUNK documents at a time.

Defined results: a null text counts as empty and is the end id alone; documents are in ascending order of id,
then the first HEAD characters of the text, then its xxhash64; a null id sorts first and is stored as the least 64-bit
integer, read back as null; repeated rows are all written; an empty table gives a folder without files; further
columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, steady, written

CACHE, NULL_ID = 1_200_000, -(1 << 63)
HEAD, CHUNK, PART_BYTES = 16, 1_024, 128 << 20
_encoders: dict = {}


class Encoder(dict):
    """Chunk of a text to the bytes of its ids.

    A text is cut before each single blank and each single line feed between characters that are no white space. The
    byte-level pre-tokenizer never has a pre-token across such a place, so a chunk's ids depend on the chunk alone.
    Texts that white space of another form, or an added token's string, makes ambiguous go to the library whole, as do
    all texts if the tokenizer file asks for another way of cutting.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.library, self.kind = Tokenizer.from_file(path), np.dtype(kind)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        way = said.get("pre_tokenizer") or {}
        feed = self.library.encode("\n", add_special_tokens=False).ids
        plain = way.get("type") == "ByteLevel" and way.get("use_regex", True) and not way.get("add_prefix_space") and not said.get("normalizer")
        self.cut = plain and len(feed) == 1 and not any(c.isspace() for a in self.added for c in a)
        self.feed, self.fresh, self.misses = feed[0] if feed else -1, {}, 0

    def __missing__(self, chunk: str) -> str:
        self.misses += 1
        self.fresh[chunk] = None
        return chunk  # stands for its ids until they are known

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_lines(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without line feeds, many in one call: a line feed between two of them is a token of its own."""
        out = []
        for i in range(0, len(texts), 100):
            part = texts[i : i + 100]
            flat = np.array(self.library.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(flat == self.feed)
            if len(ends) != len(part) - 1:
                out += self.ids(part)
                continue
            whole, size = flat.tobytes(), self.kind.itemsize
            bounds = zip([0, *(ends + 1).tolist()], [*ends.tolist(), len(flat)], strict=True)
            out += [whole[a * size : b * size] for a, b in bounds]
        return out

    def _ambiguous(self, t: str) -> bool:
        return "  " in t or " \n" in t or "\n\n\n" in t or "\n\n " in t or t[-1:] == " " or t[-2:].isspace() or any(a in t for a in self.added)

    def _learn(self) -> dict[str, bytes | None]:
        """Ids of the chunks met for the first time; None for those with white space at an edge."""
        plain, led = [], []
        for c in self.fresh:
            body = c[1:] if c[:1] in "\n\0" else c
            if body and not body[0].isspace() and not body[-1].isspace():
                (led if len(body) < len(c) else plain).append(c)
            elif c in ("\n", "\0"):
                self.fresh[c] = np.array([self.feed] if c == "\n" else [], self.kind).tobytes()
        self.fresh.update(zip(plain, self._by_lines([" " + c for c in plain]), strict=True))
        feed = np.array([self.feed], self.kind).tobytes()
        for c, x in zip(led, self._by_lines([c[1:] for c in led]), strict=True):
            self.fresh[c] = feed + x if c[0] == "\n" else x
        return self.fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = []
        for t in texts:
            if not self.cut or "\0" in t or self._ambiguous(t):
                parts.append(None)
                continue
            before = self.misses
            # The first chunk has no blank before it, which the added mark says.
            got = list(map(self.__getitem__, ("\0" + t.replace("\n", " \n")).split(" ")))
            parts.append((got, self.misses > before))
        fresh, out, whole = self._learn(), [], []
        for i, p in enumerate(parts):
            if p and p[1]:
                p = [x if type(x) is bytes else fresh[x] for x in p[0]], True
            if p is None or (p[1] and None in p[0]):
                whole.append(i)
                out.append(None)
            else:
                out.append(b"".join(p[0]))
        # The chunks seen first are the frequent ones: they stay, and beyond the cache's room others last for this call.
        self.fresh = {}
        if len(self) + len(fresh) <= CACHE:
            self.update((c, x) for c, x in fresh.items() if x is not None and len(c) <= 64)
        for i, x in zip(whole, self.ids([texts[i] for i in whole]), strict=True):
            out[i] = x
        return out


def _encoder(path: str, kind: str) -> Encoder:
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _put(fs: pafs.FileSystem, path: str, chunks: list[bytes]) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for c in chunks:
            out.write(c)
    fs.move(own, path)


def _writer(folder: str, tokenizer: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        part, encoder, end = TaskContext.get().partitionId(), _encoder(tokenizer, kind), np.array([end_id], kind).tobytes()
        name = f"{root}/{part:06d}"
        own = f"{name}.tokens.{uuid.uuid4().hex}"
        docs, sizes = [], []
        stream = None
        for batch in batches:
            for i in range(0, len(batch), 256):
                rows = batch.slice(i, 256)
                if stream is None:
                    stream = fs.open_output_stream(own)
                for x in encoder.encode(rows.column(1).to_pylist()):
                    stream.write(x + end)
                    sizes.append(len(x) // encoder.kind.itemsize + 1)
                docs.append(np.asarray(rows.column(0)))
        if stream is None:
            return
        stream.close()
        fs.move(own, f"{name}.tokens")
        _put(fs, f"{name}.offsets", [np.cumsum([0, *sizes]).astype("<i8").tobytes()])
        _put(fs, f"{name}.docs", [np.concatenate(docs).astype("<i8").tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, len(sizes), sum(sizes))], ["part", "n_docs", "n_tokens"])

    return run


def parts_for(df: DataFrame, part_bytes: int) -> int:
    """Partitions for a table that is read from files: by their size, which the plan knows, and no fewer than a shuffle has."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))


def write(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text", parts: int | None = None, kind: str = "<u2", part_bytes: int = PART_BYTES) -> tuple[str, DataFrame]:
    """The folder, and its parts: part, n_docs, n_tokens, base. kind: "<u2" where all ids are below 65,536, else "<u4"."""
    spark = df.sparkSession
    folder = new_folder(spark, "tokens")
    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = steady(rows, "rows")  # the place that tells equal rows apart has to be the same when a task runs again
    parts = parts or parts_for(rows, part_bytes)
    keyed = rows.select("id", "text", F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    ordered = keyed.repartitionByRange(parts, "id", "head", "hash", "place").sortWithinPartitions("id", "head", "hash").select("id", "text")
    # Writing happens once, while this table of a row for each partition is made.
    made = written(ordered.mapInArrow(_writer(folder, tokenizer, end_id, kind), "part long, n_docs long, n_tokens long"), "token-parts")
    base, with_base = 0, []
    for r in sorted(made.collect(), key=lambda r: r["part"]):
        with_base.append((r["part"], r["n_docs"], r["n_tokens"], base))
        base += r["n_tokens"]
    return folder, spark.createDataFrame(with_base, "part long, n_docs long, n_tokens long, base long")


def _numbers(fs: pafs.FileSystem, path: str, kind: str, opened: ExitStack) -> Callable[[int, int], np.ndarray]:
    """The numbers of a file from one place to another: mapped where the file is local, else read as that range."""
    if isinstance(fs, pafs.LocalFileSystem):
        every = np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)
        return lambda a, b: every[a:b]
    file, size = opened.enter_context(fs.open_input_file(path)), np.dtype(kind).itemsize
    return lambda a, b: np.frombuffer(file.read_at(int(b - a) * size, int(a) * size), dtype=kind)


def _reader(folder: str, kind: str, row, names: list[str]):
    def run(batches):
        fs, root = _file_system(folder)
        for batch in batches:
            for part, base, n_docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with ExitStack() as opened:
                    tokens, offsets, docs = (_numbers(fs, f"{root}/{part:06d}.{x}", k, opened) for x, k in (("tokens", kind), ("offsets", "<i8"), ("docs", "<i8")))
                    for i in range(0, n_docs, CHUNK):
                        j = min(n_docs, i + CHUNK)
                        ids, at = docs(i, j), offsets(i, j + 1)
                        held, cuts = tokens(at[0], at[-1]), at - at[0]
                        values = [row(held[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                        columns = [pa.array(ids, mask=ids == NULL_ID), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(values)]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", *names])

    return run


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def read(spark: SparkSession, folder: str, parts: DataFrame, kind: str = "<u2", row=lambda ids: ids.tolist(), column: str = "ids array<long>") -> DataFrame:
    """(doc_id, start, n_tokens, column): one row a document, from the files. row makes the column's value from its ids."""
    tasks = parts.select("part", "base", "n_docs").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return tasks.mapInArrow(_reader(folder, kind, row, [column.split()[0]]), f"doc_id long, start long, n_tokens long, {column}")
