"""Filters by a set of 64-bit hashes that spare later work and lose nothing.

A set goes to the tasks as a bitmap (a Bloom filter of two places a key) with BITS_A_KEY bits or more for each key, as
long as that needs at most MOST_BITS (64 MB); a larger set is joined. A bitmap lets about one in a hundred rows pass
that are not in the set, so whoever uses it must be right without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mixed

BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 29


def bits_for(keys: int) -> int | None:
    """The bits of a bitmap for so many keys, a power of two; None if that is too large to broadcast."""
    bits = max(LEAST_BITS, 1 << (BITS_A_KEY * max(1, keys) - 1).bit_length())
    return bits if bits <= MOST_BITS else None


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(hashes.view(np.uint64))
    return h & np.uint64(bits - 1), h >> np.uint64(32) & np.uint64(bits - 1)


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap with the places of these hashes set; the driver gets its words, at most bits / 64."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.concatenate(_places(np.asarray(batch.column(0)), bits))
            word = np.uint64(1) << (place & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int32)), pa.array(word.view(np.int64))], ["cell", "bits"])

    got = keys.select(column).mapInArrow(cells, "cell int, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(got["cell"])] = np.asarray(got["bits"])
    return out.view(np.uint8)


def contains(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    one, two = _places(hashes, 8 * len(bits))
    inside = lambda place: (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    out = inside(one)
    out[out] = inside(two[out])
    return out


def filtered(df: DataFrame, column: str, keys: DataFrame, then: Callable | None = None, schema: str = "") -> DataFrame:
    """The rows of df whose hash may be among those of keys (one column of that name, repeats allowed); or what `then`, batches
    to batches of that schema, makes of them.

    Both run in one Python node: two in a stage would take two Python workers for each task, which stay beside the executor for all later stages."""
    bits = bits_for(keys.count())
    if bits is None:
        rows = df.join(keys.distinct(), column, "left_semi").select(*df.columns)
        return rows.mapInArrow(then, schema) if then else rows
    shared = df.sparkSession.sparkContext.broadcast(bitmap(keys, column, bits))
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (batch.filter(pa.array(contains(shared.value, np.asarray(batch.column(at))))) for batch in batches)
        return then(rows) if then else rows

    return df.mapInArrow(run, schema if then else df.schema)
