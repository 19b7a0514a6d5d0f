"""Ranked lexical search: the best documents of each item by term weights, exactly, without scoring every document.

A document is a vector of impacts, one for each term that an item has: how much the term counts in it, by its frequency and the document's
length. An item is a vector of term weights; the score is their product, an integer. Both sides are scaled by the root of a term's
weight, so that words which all documents have add nothing to a vector's length.

Documents are range-sorted by the length of their vectors. The longest ones come first and give each item a threshold, the score of
its k-th best so far. Then the others are taken in buckets of neighbouring lengths: a bucket is left out for an item if the
product of the lengths is below the threshold (Cauchy-Schwarz); inside a bucket the few largest coordinates of the item bound what a
document's coordinate has to be (the angle to the item's vector is known to be small), which leaves some postings of one or a few terms; those are
scored again in 64-bit integers, unless what the other coordinates can add is too little. Bounds have a margin for rounding, so nothing is lost; documents that score as much as the
threshold stay, as a smaller id decides between them.

Items are the stated query set and are taken in blocks of about `block` items and `block_bytes` of text. What is broadcast has that bound.
Each task holds k rows an item; a document's terms that no item has are counted and let go.

Defined results: null and empty texts and items have no terms, so they match nothing, and such documents don't count for N; an id is an
integer, and a null id comes before all others among equal scores; repeated rows are ranked one by one; equal items (id and text) are one, items that
share an id but not the text are ranked each for itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays
from .common import written

#: Bytes of terms: ASCII letters and digits, and all bytes of code points beyond ASCII. Only A-Z are lower-cased.
_TERM = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_TABLE_BITS, _MARGIN = 20, 1e-9
NULL_ID = -(1 << 63)
#: Vectors in a bucket, focus coordinates of an item, documents in a range of lengths, and the share of ranges that gives the thresholds.
BUCKET, FOCUS, RANGE, HEAD = 4_096, 3, 20_000, 16


@dataclass(frozen=True)
class Items:
    """A block of items: ids, and each one's distinct terms as places in the sorted hashes of all of them."""

    ids: pa.Array
    hashes: np.ndarray
    again: np.ndarray  # a second hash of the same terms
    first: np.ndarray
    terms: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(1 << _TABLE_BITS, bool)
        out[self.hashes & np.uint64((1 << _TABLE_BITS) - 1)] = True
        return out


def _terms(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, starts and ends of terms, and each document's first term."""
    data = _LOWER[data]
    return data, *arrays.words(data, offsets, ~_TERM)


def items_of(ids: pa.Array, texts: pa.Array) -> Items:
    one, two, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in arrays.slices(texts):
        data, starts, ends, first = _terms(data, offsets)
        one.append(arrays.word_hashes(data, starts, ends))
        two.append(arrays.word_hashes(data, starts, ends, 1))
        counts.append(np.diff(first))
    one, two, counts = np.concatenate(one), np.concatenate(two), np.concatenate(counts)
    hashes, at, term = np.unique(one, return_index=True, return_inverse=True)
    if not np.array_equal(two[at][term], two):
        raise ValueError("two terms of the items share a 64-bit hash")
    pairs = np.unique(np.repeat(np.arange(len(counts)), counts) * np.int64(len(hashes) + 1) + term)
    item, term = np.divmod(pairs, len(hashes) + 1)
    return Items(ids, hashes, two[at], np.searchsorted(item, np.arange(len(ids) + 1)), term)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _vectors(shared):
    """A row a document: its number of terms, and those of the items' terms that it has, with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, table = shared.value
        for batch in batches:
            for i, j, data, offsets in arrays.slices(batch.column(1)):
                data, starts, ends, first = _terms(data, offsets)
                hashes = arrays.word_hashes(data, starts, ends)
                at = np.flatnonzero(table[hashes & np.uint64((1 << _TABLE_BITS) - 1)])
                term = np.searchsorted(items.hashes, hashes[at])
                term[term == len(items.hashes)] = 0
                same = items.hashes[term] == hashes[at] if len(at) else np.zeros(0, bool)
                at, term = at[same], term[same]
                same = arrays.word_hashes(data, starts[at], ends[at], 1) == items.again[term] if len(at) else np.zeros(0, bool)
                doc = np.searchsorted(first, at[same], side="right") - 1
                pairs, tf = np.unique(doc * np.int64(len(items.hashes) + 1) + term[same], return_counts=True)
                doc, term = np.divmod(pairs, len(items.hashes) + 1)
                ends = np.searchsorted(doc, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first), pa.int64()), _lists(ends, term), _lists(ends, tf)], ["doc_id", "n", "terms", "tf"])

    return arrays.tidy(run)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """How much a term counts in a document of n terms, when all have `length` terms together; 64-bit integers."""
    m = 100 - 90 + (90 * n * documents) // length
    return (1_000_000_000 * tf) // (1_000 * tf + 8 * m)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and values of a list column."""
    offsets = np.asarray(column.offsets)
    return offsets - offsets[0], np.asarray(column.flatten(), np.int64)


def _weighed(shared, documents: int, length: int):
    """Impacts of the terms with a weight, and the length of the vector; documents without any are left out, as they score 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            (offsets, terms), (_, tf) = _flat(batch.column(2)), _flat(batch.column(3))
            doc, n = np.repeat(np.arange(len(batch)), np.diff(offsets)), np.asarray(batch.column(1))
            v = impacts(tf, n[doc], documents, length)
            kept = weight[terms] * v > 0
            doc, terms, v = doc[kept], terms[kept], v[kept]
            sums = np.bincount(doc, weight[terms] * v.astype(float) ** 2, minlength=len(batch))
            rows = np.flatnonzero(sums)
            ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(batch))[rows])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.sqrt(sums[rows])), _lists(ends, terms), _lists(ends, v)], ["doc_id", "length", "terms", "impacts"])

    return run


@dataclass
class Postings:
    """A bucket: vectors with their lengths, and its entries in the order of terms."""

    ids: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray

    @classmethod
    def of(cls, ids, lengths, offsets, terms, impacts):
        order = np.argsort(terms, kind="stable")
        docs = np.repeat(np.arange(len(ids)), np.diff(offsets))
        return cls(ids, lengths, terms[order], docs[order], impacts[order])


def feasible(q: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """What coordinates a unit vector may have whose product with the unit vector q is t or more."""
    if t <= 0:
        return np.full(len(q), -1.0), np.full(len(q), 1.0)
    t = min(t, 1.0)
    beside = np.sqrt(np.maximum(1 - t * t, 0) * np.maximum(1 - q * q, 0))
    return q * t - beside - _MARGIN, np.where(q >= t, 1.0, q * t + beside) + _MARGIN


class Best:
    """The k best (score, id) of each item so far, and the thresholds that follow from them."""

    def __init__(self, items: int, k: int, least: np.ndarray):
        self.k, self.least, self.scores, self.ids = k, least.copy(), [np.zeros(0, np.int64)] * items, [np.zeros(0, np.int64)] * items

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.scores[item], scores], np.r_[self.ids[item], ids]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], scores[order[-1]])


def search(bucket: Postings, items: Items, weight: np.ndarray, norms: np.ndarray, best: Best) -> tuple[int, int]:
    """Adds what the bucket has for each item. Returns how many items looked into it, and how many documents were scored."""
    longest, looked, scored = bucket.lengths.max(), 0, 0
    begin, end = (np.searchsorted(bucket.terms, np.arange(len(weight)), side=s) for s in ("left", "right"))
    for item in np.flatnonzero((norms > 0) & (norms * longest * (1 + _MARGIN) >= best.least)):
        terms = items.terms[items.first[item] : items.first[item + 1]]
        terms = terms[end[terms] > begin[terms]]
        if not len(terms):
            continue
        looked += 1
        least = best.least[item]
        fits = norms[item] * bucket.lengths * (1 + _MARGIN) >= least
        if least > 0:
            own = items.terms[items.first[item] : items.first[item + 1]]
            focus = own[np.argsort(-weight[own], kind="stable")[:FOCUS]]
            low, high = feasible(np.sqrt(weight[focus]) / norms[item], least / (norms[item] * longest))
            known, used = np.zeros(len(fits)), np.zeros(len(fits))
            for f, a, b in zip(focus, low, high, strict=True):
                docs, v = bucket.docs[begin[f] : end[f]], bucket.impacts[begin[f] : end[f]].astype(float)
                share = np.sqrt(weight[f]) * v / bucket.lengths[docs]
                known[docs] += weight[f] * v
                used[docs] += weight[f] * v * v
                inside = (share >= a) & (share <= b)
                if a > 0:  # what lacks the term is out of reach
                    only = np.zeros(len(fits), bool)
                    only[docs[inside]] = True
                    fits &= only
                else:
                    fits[docs[~inside]] = False
            # What the other coordinates can add to those seen is bounded by the lengths that are left.
            rest = np.sqrt(max(norms[item] ** 2 - weight[focus].sum(), 0) * np.maximum(bucket.lengths**2 - used, 0))
            fits &= (known + rest + _MARGIN * norms[item] * bucket.lengths) >= least
            if not fits.any():
                continue
        at = np.concatenate([np.arange(begin[t], end[t]) for t in terms])
        at = at[fits[bucket.docs[at]]]
        scores = np.zeros(len(fits), np.int64)
        np.add.at(scores, bucket.docs[at], weight[bucket.terms[at]] * bucket.impacts[at])
        hit = np.flatnonzero((scores > 0) & (scores >= least))
        scored += len(np.unique(bucket.docs[at]))
        if len(hit):
            best.add(item, scores[hit], bucket.ids[hit])
    return looked, scored


def _searched(shared, k: int, least: np.ndarray):
    """The k best of each item in a task's buckets, which come by descending length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, norms = shared.value
        best = Best(len(items.ids), k, least)
        for batch in batches:
            for i in range(0, len(batch), BUCKET):
                rows = batch.slice(i, BUCKET)
                ids = np.asarray(rows.column(0).fill_null(NULL_ID).cast(pa.int64()))
                (offsets, terms), (_, v) = _flat(rows.column(2)), _flat(rows.column(3))
                search(Postings.of(ids, np.asarray(rows.column(1)), offsets, terms, v), items, weight, norms, best)
        held = [i for i in range(len(items.ids)) if len(best.ids[i])]
        if held:
            ids = np.concatenate([best.ids[i] for i in held])
            item = np.repeat(held, [len(best.ids[i]) for i in held])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, mask=ids == NULL_ID), pa.array(np.concatenate([best.scores[i] for i in held]))], ["item", "doc_id", "score"])

    return arrays.tidy(run)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k first of each item, with their rank."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, items: Items, k: int) -> DataFrame | None:
    """(item, rank, doc_id, score): item is a place in the block."""
    spark, sc, size = docs.sparkSession, docs.sparkSession.sparkContext, len(items.hashes)
    if not size:
        return None
    vectors = written(docs.mapInArrow(_vectors(sc.broadcast((items, items.table()))), "doc_id long, n long, terms array<int>, tf array<int>"), "vectors")
    documents, length = vectors.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents:
        return None
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[np.asarray(held["term"])] = np.asarray(held["df"])
    weight = weights(df, documents)
    norms = np.sqrt(np.add.reduceat(np.r_[weight[items.terms], 0], np.minimum(items.first[:-1], len(items.terms))) * (np.diff(items.first) > 0))
    weighed = vectors.mapInArrow(_weighed(sc.broadcast(weight), documents, length), "doc_id long, length double, terms array<int>, impacts array<int>")
    ranges = -(-documents // RANGE)
    # The salt keeps vectors of one length, such as copies, from one task.
    dealt = weighed.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(ranges, F.desc("length"), "salt").sortWithinPartitions(F.desc("length"))
    ordered = written(dealt.select("doc_id", "length", "terms", "impacts", F.spark_partition_id().alias("range")), "impacts")
    shared = sc.broadcast((items, weight, norms))
    schema, head = "item int, doc_id long, score long", max(1, ranges // HEAD)
    found = lambda rows, least: rows.select("doc_id", "length", "terms", "impacts").mapInArrow(_searched(shared, k, least), schema)
    least = np.zeros(len(items.ids), np.int64)
    longest = written(_first(found(ordered.filter(F.col("range") < head), least), k).drop("rank"), "longest")
    for r in longest.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).collect():
        least[r["item"]] = r["least"]
    return _first(longest.union(found(ordered.filter(F.col("range") >= head), least)), k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = 20_000, block_bytes: int = 8 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of each item with the highest scores above 0, equal scores by ascending id."""
    spark = docs.sparkSession
    named = items.select(F.col(item_id).alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    out = spark.createDataFrame([], f"item_id {dict(named.dtypes)['item_id']}, rank int, doc_id long, score long")
    size = named.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block), -(-size["bytes"] // block_bytes))
    for b in range(blocks):
        part = named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")]).combine_chunks()
        got = items_of(part["item_id"].combine_chunks() if part.num_rows else pa.array([], part["item_id"].type), part["text"])
        if (found := _block(texts, got, k)) is not None:
            names = F.broadcast(spark.createDataFrame(pa.table({"item": pa.array(range(len(got.ids)), pa.int32()), "item_id": got.ids})))
            out = out.union(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
