"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Partition i holds n_i rows and shard j must get m_j. How many rows of i go to j is drawn exactly as a uniform
permutation of all rows would deal them: row by row of the matrix, from the multivariate hypergeometric law over
what the shards still lack. Each partition then permutes its rows, deals the first rows to shard 0 and so on, the
rows are exchanged, and each shard permutes what it got. Shards differ by one row at most.

The second permutation is cut into pieces of about `target_rows` rows: a row draws a random number, whose upper part
names the piece and which orders the rows inside, so no task orders a whole shard; the pieces' counts give the first
slot of each. Rows enter through a written table that numbers them, so what a row draws depends on its number alone: it
stays the same when an executor is lost, and equal rows draw apart. Rows are written once and exchanged once.

The driver draws the matrix (partitions times shards) and keeps nothing else; tasks join it by partition.

Defined results: nulls, repeated rows and further columns travel like any other row, and equal rows are
dealt as often as they occur; an empty table gives no rows. Columns starting with "_s_" are reserved; input
columns named shard or slot are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import mixed
from .common import written

NUMPY_MOST = 10**9  # numpy's hypergeometric needs populations below this
#: Cells of the matrix, and rows of the pieces' counts, that are broadcast (32 MB); larger ones Spark joins as it likes.
MOST_CELLS = 4_000_000
PLACE_BITS = 33  # of monotonically_increasing_id, below the partition's number


def exact_sizes(rows: int, parts: int) -> list[int]:
    return [rows // parts + (k < rows % parts) for k in range(parts)]


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` rows are good ones."""
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, drawn))
    # Inversion around the mean: ratios of neighbouring probabilities, summed outwards in logarithms.
    total = good + bad
    mean, sd = drawn * good / total, (drawn * good / total * bad / total * max(total - drawn, 1) / max(total - 1, 1)) ** 0.5
    low, high = max(0, drawn - bad, int(mean - 12 * sd - 12)), min(drawn, good, int(mean + 12 * sd + 12))
    k = np.arange(low, high, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1))])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def communication_matrix(sources: list[int], targets: list[int], seed: int) -> np.ndarray:
    """Exact counts (source, target) with these row and column sums, distributed as under a uniform permutation."""
    rng = np.random.default_rng(seed)
    free, out = np.array(targets, np.int64), np.zeros((len(sources), len(targets)), dtype=np.int64)
    for i, n in enumerate(sources):
        if free.sum() < NUMPY_MOST:
            out[i] = rng.multivariate_hypergeometric(free, n, method="marginals")
        else:
            others = int(free.sum())
            for j, room in enumerate(free.tolist()):
                others -= room
                out[i, j] = took = n if others == 0 else _hypergeometric(rng, room, others, n)
                n -= took
        free -= out[i]
    return out


@lru_cache(maxsize=2)
def _dealt(part: int, counts: tuple[int, ...], seed: int) -> np.ndarray:
    """The shard of each row of a partition: the partition permuted, its first rows to shard 0 and so on."""
    return np.random.default_rng([seed, part]).permutation(np.repeat(np.arange(len(counts), dtype=np.int32), counts))


def _draws(seed: int, pieces: int):
    """What rows draw, by their number and the counts of their partition: shard, piece of the shard, and place in the piece."""

    def draw(ids: pa.Array, counts: pa.Array) -> pa.Array:
        number = np.asarray(ids)
        part, shard = number >> PLACE_BITS, np.zeros(len(number), np.int32)
        for p in np.unique(part).tolist():
            mine = np.flatnonzero(part == p)
            shard[mine] = _dealt(p, tuple(counts[int(mine[0])].as_py()), seed)[number[mine] & (1 << PLACE_BITS) - 1]
        key = mixed(mixed(number.astype(np.uint64)) + np.uint64(seed)) >> np.uint64(1)
        piece = (key >> np.uint64(31)).astype(np.int64) * pieces >> 32
        return pa.StructArray.from_arrays([pa.array(shard), pa.array(piece.astype(np.int32)), pa.array(key.astype(np.int64))], ["shard", "piece", "key"])

    return F.arrow_udf(draw, "struct<shard:int,piece:int,key:bigint>")


def uniform_shards(df: DataFrame, shards: int = 16, seed: int = 42, target_rows: int = 20_000) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (0, 1, ... within the shard, in random order)."""
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    cols = df.columns
    rows = written(df.withColumn("_s_id", F.monotonically_increasing_id()), "shards")
    part = F.shiftright("_s_id", PLACE_BITS)
    counted = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    sizes = exact_sizes(sum(n for _, n in counted), shards)
    matrix = communication_matrix([n for _, n in counted], sizes, seed)
    parts = spark.createDataFrame([(p, m) for (p, _), m in zip(counted, matrix.tolist(), strict=True)], "_s_part long, _s_counts array<long>")
    small = lambda df, cells: F.broadcast(df) if cells <= MOST_CELLS else df
    pieces = max(1, -(-max(sizes) // target_rows))
    draw = _draws(seed, pieces)("_s_id", "_s_counts")

    def drawn(df: DataFrame) -> DataFrame:
        return df.withColumn("_s_part", part).join(small(parts, matrix.size), "_s_part").withColumn("_s_draw", draw).drop("_s_part", "_s_counts")

    held = drawn(rows.select("_s_id")).groupBy("_s_draw.shard", "_s_draw.piece").agg(F.count("*").alias("_s_n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    first = held.select(F.col("shard").alias("_s_shard"), F.col("piece").alias("_s_piece"), F.coalesce(F.sum("_s_n").over(before), F.lit(0)).alias("_s_first"))
    # The exchange: rows move to their shard's pieces and are put in their order there.
    dealt = drawn(rows).select(*cols, F.col("_s_draw.shard").alias("_s_shard"), F.col("_s_draw.piece").alias("_s_piece"), F.col("_s_draw.key").alias("_s_key"), "_s_id")
    place = Window.partitionBy("_s_shard", "_s_piece").orderBy("_s_key", "_s_id")
    out = dealt.withColumn("_s_slot", F.row_number().over(place) - 1).join(small(first, shards * pieces), ["_s_shard", "_s_piece"])
    return out.select(*cols, F.col("_s_shard").alias("shard"), (F.col("_s_first") + F.col("_s_slot")).cast("long").alias("slot"))
