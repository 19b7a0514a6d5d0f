"""Substring dedup by relative Lempel-Ziv parsing: words under long factors shared with an earlier document go.

The reference is the corpus itself, indexed in blocks of documents with neighbouring ids. Looking a document up in every
block is an equi-join: the document is cut into phrases whose ends the words themselves choose (each window of 13 words
names its smallest 7-word hash, the anchor, and a phrase is a run of windows with one anchor), a phrase depends on nothing
but its own words, and the index holds each phrase with the first document that has it. What is cut short where a
document leaves its reference is looked up window by window: equal windows have the same anchor, so they lie in
equal phrases or in two phrases of one anchor, and the windows of anchors with several phrases are indexed as well.

The parse is greedy (`factors`): from the first place that the index knows, a factor takes window after window as long as
the same reference block goes on, then the next one begins; at the boundaries the single windows decide. A factor has
13 words or more, and its words are a duplicate span. Factors together hold exactly the windows whose words also start
in a document with a smaller id. The index names the first document of a phrase, not the longest match anywhere: a
parse against every block by itself would give other boundaries and the same words.

Three scans: the first counts anchors; the second keeps only phrases whose anchor several documents have; the third gives
the windows of anchors that stand in different phrases. Phrases are compared by 128 bits of hash, windows by 96.

Defined results: a null text counts as empty; rows with a null id are returned unchanged and refer to nothing;
rows that repeat an id never refer to each other; a text shorter than 13 words has nothing removed; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .bitmaps import bitmap, bits_for, contains
from .common import text_of, written

WINDOW, ANCHOR = 13, 7
SPAN = WINDOW - ANCHOR + 1  # anchors that a window can choose from
BLOCK = 1 << 10  # ids in a reference block


def phrases(data: np.ndarray, offsets: np.ndarray):
    """Phrases of a slice of documents: (anchor hash, first window, number of windows, document), and all window hashes and document starts."""
    starts, ends, first = arrays.words(data, offsets)
    hashes = arrays.word_hashes(data, starts, ends)
    valid = arrays.window_starts(first, WINDOW, len(hashes))
    if not valid.any():
        return None
    grams = arrays.window_hashes(hashes, ANCHOR)
    n = len(valid)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, SPAN):
        less = grams[j : j + n] < best
        np.copyto(best, grams[j : j + n], where=less)
        at[less] = np.flatnonzero(less) + j
    where = np.flatnonzero(valid)
    at = at[where]
    document = np.searchsorted(first, where, side="right") - 1
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (document[1:] != document[:-1])])
    return grams[at[cut]].view(np.int64), where[cut], np.diff(np.r_[cut, len(where)]), document[cut], hashes, first


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to (anchor, doc)."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for i, _, data, offsets in arrays.slices(batch.column(1)):
            if found := phrases(data, offsets):
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(ids[i + found[3]])], ["a", "doc"])


def _chosen(shared, emit, names: list[str]):
    """(doc, mark, text) to rows of the phrases whose anchor is in the bitmap (of all phrases without one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i, _, data, offsets in arrays.slices(batch.column(2)):
                if not (found := phrases(data, offsets)):
                    continue
                keep = contains(shared.value, found[0]) if shared else np.ones(len(found[0]), bool)
                anchor, at, n, document = (x[keep] for x in found[:4])
                if not len(at):
                    continue
                columns = emit(anchor, at, n, i + document, at - found[5][document], found[4], ids, marks)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)

    return run


def _rows_of(named: DataFrame, anchors: DataFrame, emit, schema: str) -> DataFrame:
    """The rows that emit makes of phrases with these anchors (column a): by a bitmap of them, by a join where there are too many."""
    bits = bits_for(anchors.count())
    shared = named.sparkSession.sparkContext.broadcast(bitmap(anchors, "a", bits)) if bits else None
    rows = named.mapInArrow(_chosen(shared, emit, [c.split()[0] for c in schema.split(", ")]), schema)
    return rows if bits else rows.join(anchors.distinct(), "a", "left_semi")


def _once(row, key, values):
    """The values of equal (row, key) pairs together: a text that repeats itself gives one row for each key."""
    order = np.lexsort((key, row))
    first = np.flatnonzero(np.r_[True, (np.diff(row[order]) != 0) | (key[order][1:] != key[order][:-1])])
    return order[first], pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)].astype(np.int32)), pa.array(values[order].astype(np.int32)))


def _phrase_rows(anchor, at, n, row, start, hashes, ids, marks):
    # The first and the last window of a phrase hold all its words.
    w = arrays.window_hashes(hashes, WINDOW)
    whole = arrays.mixed(w[at] * np.uint64(3) + w[at + n - 1] * np.uint64(5) + n.astype(np.uint64))
    one, spans = _once(row, whole, 16 * start + n)
    return anchor[one], whole[one].view(np.int64), ids[row[one]], marks[row[one]], spans


def _window_rows(anchor, at, n, row, start, hashes, ids, marks):
    w, more = arrays.window_hashes(hashes, WINDOW), arrays.window_hashes(hashes, WINDOW, 1)
    ends = np.cumsum(n)
    step = np.arange(ends[-1]) - np.repeat(ends - n, n)
    place, row, key = np.repeat(at, n) + step, np.repeat(row, n), np.repeat(anchor, n)
    one, spans = _once(row, w[place], 16 * (np.repeat(start, n) + step) + 1)
    return key[one], w[place][one].view(np.int64), more[place][one].astype(np.int32), ids[row[one]], marks[row[one]], spans


def spans(docs: DataFrame) -> DataFrame:
    """docs: doc (long, not null), mark (int), text. (doc, mark, spans): what the index finds, as structs (low, spans) of
    the first document that has it, and 16 * start + n for n (at most SPAN) repeated windows from word start on."""
    named = docs.select("doc", "mark", "text")
    anchors = docs.select("doc", "text").mapInArrow(_anchors, "a long, doc long")
    often = written(anchors.groupBy("a").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("a"), "anchors")
    found = written(_rows_of(named, often, _phrase_rows, "a long, s long, doc long, mark int, spans array<int>"), "phrases")
    index = written(found.groupBy("a", "s").agg(F.min("doc").alias("low")), "index")
    whole = found.join(index, ["a", "s"]).filter("doc > low").select("doc", "mark", "low", "spans")
    # Different phrases with one anchor may share windows: where a factor ends.
    cut = index.groupBy("a").agg(F.min("s").alias("x"), F.max("s").alias("y"), F.min("low").alias("low"), F.max("low").alias("high")).filter("x < y AND low < high")
    cut = written(cut.select("a"), "cut")
    border = written(_rows_of(named, cut, _window_rows, "a long, w long, v int, doc long, mark int, spans array<int>").drop("a"), "windows")
    first = border.groupBy("w", "v").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("w", "v", "low")
    single = border.join(first, ["w", "v"]).filter("doc > low").select("doc", "mark", "low", "spans")
    return whole.union(single).groupBy("doc", "mark").agg(F.collect_list(F.struct("low", "spans")).alias("spans"))


def parsed(low: np.ndarray, begin: np.ndarray, n: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse over n found windows from each word `begin` on, first seen in document `low`: (start, words, block) of the factors."""
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    window, of = np.repeat(begin, n) + step, np.repeat(low, n) // block
    order = np.lexsort((of, window))
    order = order[np.r_[True, np.diff(window[order]) != 0]] if len(order) else order
    window, of = window[order], of[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(window) != 1) | (np.diff(of) != 0)]) if len(window) else np.zeros(0, np.int64)
    return window[cut], np.diff(np.r_[cut, len(window)]) + WINDOW - 1, of[cut]


def _parsed_row(found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """parsed of one row's structs (low, spans)."""
    lists = found.field("spans")
    packed = np.asarray(lists.flatten()).astype(np.int64)
    return parsed(np.repeat(np.asarray(found.field("low")), np.asarray(pc.list_value_length(lists))), packed >> 4, packed & 15)


def _factored(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("block", pa.int64())]))
    for batch in batches:
        rows = [[dict(zip(("start", "words", "block"), f, strict=True)) for f in zip(*map(np.ndarray.tolist, _parsed_row(s.values)), strict=True)] for s in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], ["doc", "mark", "factors"])


def factors(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, mark, factors): the parse of each document that refers to earlier ones, as (start, words, block) in words.
    mark is a hash of the text, which tells rows with one id apart."""
    found = spans(_marked(df, id_col, text).filter("doc IS NOT NULL"))
    return found.mapInArrow(_factored, "doc long, mark int, factors array<struct<start:long,words:long,block:long>>")


def _kept(words: list[bytes], begin: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The words under no factor."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + n, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _split(touched):
    """Rows without spans are finished here; the others keep their text for the join."""

    def run(batches):
        bits = touched.value if touched else None
        for batch in batches:
            n, kept, text = [], [], []
            maybe = contains(bits, np.asarray(batch.column(3))) if touched else np.ones(len(batch), bool)
            for m, t in zip(maybe.tolist(), batch.column(2), strict=True):
                t = t.as_py() or ""
                words = t.encode().split()
                n.append(len(words))
                text.append(t if m else None)
                kept.append(None if m else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([None if k is None else hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(text, pa.string())],
                ["id", "mark", "n_words", "sha", "text"],
            )

    return run


def _removed(batches):
    for batch in batches:
        gone, text = [], []
        for t, s in zip(batch.column(1), batch.column(2), strict=True):
            words = (t.as_py() or "").encode().split()
            left = words
            if s.is_valid and words:
                left = _kept(words, *_parsed_row(s.values)[:2])
            gone.append(len(words) - len(left))
            text.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(text, pa.string())], ["id", "n_removed", "kept"])


def _marked(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_of(text)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("mark"), text_of(text).alias("text"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_removed, kept): the words left of every row's text, joined by one space."""
    docs = _marked(df, id_col, text)
    found = spans(docs.filter("doc IS NOT NULL"))
    joined = docs.join(found, ["doc", "mark"], "left").select(F.col("doc").alias("id"), "text", "spans")
    return joined.mapInArrow(_removed, "id long, n_removed long, kept string")


def repeat_digests(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256). As remove_repeats, but only the texts that lose words are shuffled."""
    docs = _marked(df, id_col, text)
    found = written(spans(docs.filter("doc IS NOT NULL")), "spans")
    key = F.xxhash64("doc", "mark")
    bits = bits_for(found.count())
    touched = df.sparkSession.sparkContext.broadcast(bitmap(found.select(key.alias("k")), "k", bits)) if bits else None
    split = docs.withColumn("k", key).select("doc", "mark", "text", "k").mapInArrow(_split(touched), "id long, mark int, n_words long, sha string, text string")
    joined = split.join(found.select(F.col("doc").alias("id"), "mark", "spans"), ["id", "mark"], "left")
    return joined.mapInArrow(_finished, "id long, n_words long, n_removed long, kept_sha256 string")


def _finished(batches):
    for batch in batches:
        sha = batch.column(batch.schema.get_field_index("sha")).to_pylist()
        part = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("id", "text", "spans")], ["id", "text", "spans"])
        for done in _removed([part]):
            gone = done.column(1).to_pylist()
            out = [s or hashlib.sha256(k.as_py().encode()).hexdigest() for s, k in zip(sha, done.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("n_words")), pa.array(gone, pa.int64()), pa.array(out, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])
