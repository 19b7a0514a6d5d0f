"""Byte-level BPE by a global shuffle of distinct words.

Documents are taken in blocks, each what one task reads up to `block_bytes` of text. A block's texts are cut
into pre-tokens; the block numbers its distinct pre-tokens in the order of their first occurrence, and a
document is then the sequence of its numbers (its exploded positions, kept as one compressed array). All blocks'
words meet in one shuffle by word, where each distinct word is encoded once and its ids go back to every
block that has it; a second shuffle by block joins the ids to the sequences and puts them together by
position. A word is one row a block, so no word is hot, and blocks have a bounded size. Decoding looks the
ids up in the token-byte table, which has as many rows as the vocabulary.

Two passes over the texts number the words. They see the same rows in the same order, for the input is written first
unless it only reads files; and each pass sends along a digest of its block's numbering, so that blocks which
differ in it fail the job where they meet.

Defined results: a null text counts as empty and has no ids; special tokens' strings are ordinary text; rows
with a null id or that repeat others are encoded like any other row; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SLICE, give_back, tidy
from .common import steady
from .pretokens import Splitter

BLOCK_BYTES = 48 << 20
#: Parts of a block, of some SLICE characters, whose words are put together at once.
PARTS = 8
_encodings: dict = {}


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^24, byte by byte, so that equal high bytes lie together."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes.T).tobytes())


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(3, n).astype(np.uint32)
    return planes[0] | planes[1] << 8 | planes[2] << 16


def _blocks(pattern: str, block_bytes: int, words_wanted: bool, id_type: pa.DataType):
    """(id, text) to a row a distinct word (block, number, word), or a row for each few documents (block, ids, lengths, sequence).

    Texts are cut a part of the block at a time; a part's words leave Python for an Arrow dictionary at once, and every PARTS
    parts their dictionaries go on with the block's, whose numbers stay as they are. So a block holds the bytes of its
    distinct words, and no object for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block, size = Splitter(pattern), TaskContext.get().partitionId() << 20, 0
        words, parts = pa.array([], pa.string()), []
        ids, found, lengths, chars = [], [], [], 0  # of the part
        held_ids, held_lengths = [], []  # of the parts

        def end_part():
            parts.append(pa.array(found, pa.string()).dictionary_encode())
            if not words_wanted:
                held_ids.append([*ids])
                held_lengths.append([*lengths])
            for x in (ids, found, lengths):
                x.clear()

        def documents(own, sizes, numbers):
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([own], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int32())), pa.array([_packed(np.concatenate(numbers))], pa.binary())],
                ["block", "ids", "lengths", "sequence"],
            )

        def numbered():
            """The block's words so far; yields the parts' documents by their numbers."""
            nonlocal words
            known = pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), words)
            merged = pa.chunked_array([known, *parts]).unify_dictionaries()
            words = merged.chunk(0).dictionary
            parts.clear()
            own, sizes, numbers, n = [], [], [], 0
            for more, lengths, part in zip(held_ids, held_lengths, merged.chunks[1:], strict=not words_wanted):
                own += more
                sizes += lengths
                numbers.append(np.asarray(part.indices))
                n += len(part)
                if n >= 500_000 or len(own) >= 512:
                    yield documents(own, sizes, numbers)
                    own, sizes, numbers, n = [], [], [], 0
            if own:
                yield documents(own, sizes, numbers)
            held_ids.clear()
            held_lengths.clear()

        def ended():
            """The rest of the block's rows. The last is its digest, as a row of no documents or as a word without a number."""
            nonlocal words
            yield from numbered()
            done, words = words.cast(pa.binary()), pa.array([], pa.string())
            for i in range(0, len(done) if words_wanted else 0, 20_000):
                some = done.slice(i, 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(np.arange(i, i + len(some), dtype=np.int32)), some], ["block", "number", "word"])
            if not size:
                return
            digest = pa.array([b"%d" % (_digest(done) >> 1)], pa.binary())
            if words_wanted:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), digest], ["block", "number", "word"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([[]], pa.list_(id_type)), pa.array([[]], pa.list_(pa.int32())), digest], ["block", "ids", "lengths", "sequence"])

        for batch in batches:
            for x, t in zip(batch.column(0), batch.column(1), strict=True):
                t = t.as_py() or ""
                cut = split(t)
                ids.append(x.as_py())
                lengths.append(len(cut))
                found += cut
                chars += len(t)
                size += len(t) if t.isascii() else len(t.encode())
                if chars >= SLICE or len(ids) >= 512 or size >= block_bytes:
                    end_part()
                    chars = 0
                    full = size >= block_bytes or len(words) + sum(len(p.dictionary) for p in parts) > (1 << 24) - (1 << 20)
                    if full:
                        yield from ended()
                        size, block = 0, block + 1
                    elif len(parts) >= PARTS:
                        yield from numbered()
        if ids:
            end_part()
        if parts or len(words):
            yield from ended()

    return run


def _digest(words: pa.Array) -> int:
    """Of the words in their order."""
    seen = xxhash.xxh64()
    for i in range(0, len(words), 20_000):
        for w in words.slice(i, 20_000).to_pylist():
            seen.update(w)
            seen.update(b"\0")
    return seen.intdigest()


def _encoding(path: str, pattern: str):
    """tiktoken's encoding of a rank file; one for each worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks
    return _encodings[path]


def _id_kind(ranks: dict) -> str:
    return "<u2" if max(ranks.values()) < 1 << 16 else "<u4"


def _encoded_words(path: str, pattern: str):
    """Rows (block, number, word) sorted by word: each distinct word is encoded once."""

    def run(batches):
        encoding, ranks = _encoding(path, pattern)
        encode, kind, last, ids = encoding.encode_ordinary, _id_kind(ranks), None, b""
        for batch in batches:
            out = []
            for w, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w != last and n >= 0:
                    last, ids = w, np.array(encode(w.decode()), kind).tobytes()
                out.append(ids if n >= 0 else w)  # a digest goes on as it is
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "number", "ids"])

    return run


def _assembled(path: str, pattern: str, finish: Callable, names: list[str], id_type: pa.DataType, types: list[pa.DataType]):
    def run(documents: pa.Table, words: pa.Table) -> pa.Table:
        give_back()  # what the group before has freed
        ranks = _encoding(path, pattern)[1]
        token_bytes = {i: b for b, i in ranks.items()}
        table = [token_bytes.get(i, b"") for i in range(max(token_bytes) + 1)]
        digests = words.filter(pc.equal(words["number"], -1))["ids"].to_pylist()
        if digests != documents.filter(pc.equal(pc.list_value_length(documents["ids"]), 0))["sequence"].to_pylist():
            raise ValueError("the words of a block are not those that its documents were numbered by")
        words = words.filter(pc.greater_equal(words["number"], 0))
        documents = documents.filter(pc.greater(pc.list_value_length(documents["ids"]), 0))
        number = np.asarray(words["number"].combine_chunks())
        column = words["ids"].combine_chunks().cast(pa.large_binary()) if len(words) else None
        kind = np.dtype(_id_kind(ranks))
        flat, at, size = np.zeros(0, kind), np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        if column is not None:
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // kind.itemsize
            flat = np.frombuffer(data, kind)
            at[number], size[number] = offsets[:-1], np.diff(offsets)
        # A few documents at a time, so that no second copy of a block's ids is held.
        tables = [pa.Table.from_arrays([pa.array([], id_type), *[pa.array([], t) for t in types]], ["id", *names])]
        for keys, lengths, sequence in zip(documents["ids"], documents["lengths"], documents["sequence"], strict=True):
            done, ends = [], np.cumsum(lengths.as_py())
            numbers = _unpacked(sequence.as_py(), int(ends[-1]))
            for n in np.split(numbers, ends[:-1]):
                if not len(n):
                    done.append(finish(np.zeros(0, "<u4"), b""))
                    continue
                sizes = size[n]
                stop = np.cumsum(sizes)
                ids = flat[np.repeat(at[n] - (stop - sizes), sizes) + np.arange(stop[-1])].astype("<u4")
                done.append(finish(ids, b"".join(map(table.__getitem__, ids.tolist()))))
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            tables.append(pa.Table.from_arrays([pa.array(keys.as_py(), id_type), *columns], ["id", *names]))
        return pa.concat_tables(tables)

    return run


def ids_and_text(ids: np.ndarray, decoded: bytes) -> tuple:
    return ids.tolist(), decoded.decode("utf-8", "replace")


#: Columns of digests, for `schema`.
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(ids: np.ndarray, decoded: bytes) -> tuple:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def digests_and_ids(ids: np.ndarray, decoded: bytes) -> tuple:
    return *digests(ids, decoded), ids.astype("<u4").tobytes()


def encode_decode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text: str = "text", finish: Callable = ids_and_text, schema: str = "ids array<long>, decoded string", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, columns of schema): finish makes a document's columns from its ids and its decoded bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    rows = steady(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "texts")
    kind = rows.schema["id"].dataType.simpleString()
    out = _parse_datatype_string(schema)
    types = [f.type for f in to_arrow_schema(out)]
    id_type = to_arrow_schema(rows.select("id").schema)[0].type
    words = rows.mapInArrow(tidy(_blocks(pattern, block_bytes, True, id_type)), "block long, number int, word binary")
    back = words.repartition("word").sortWithinPartitions("word").mapInArrow(tidy(_encoded_words(ranks, pattern)), "block long, number int, ids binary")
    sequences = rows.mapInArrow(tidy(_blocks(pattern, block_bytes, False, id_type)), f"block long, ids array<{kind}>, lengths array<int>, sequence binary")
    run = _assembled(ranks, pattern, finish, out.fieldNames(), id_type, types)
    return sequences.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, f"id {kind}, {schema}")
