"""Best-fit packing: rows of given sizes into as few sequences of a given capacity as possible, in bulk-synchronous steps.

Rows of over half the capacity open a sequence each, since no two of them fit together; what they leave is a gap. Then, step by step,
pending rows and gaps are range-sorted together by size, largest first:

1. Sweep. Each range matches its own rows, largest first, each to its successor, the smallest gap that holds it; what a row leaves of
   a gap is a gap again. Equal sizes are handled as runs.
2. Conflicts. Rows that found no gap in their range have to share the gaps left in the ranges above. Each range says how many it has of both;
   a pass over these counts (a row a range, on the driver) gives the nearest gaps above to the largest rows first, as intervals of
   ranks: row r of a range goes to gap r div k of another, if k rows of that range's largest size fit into its smallest gap.
3. Update. Rows meet their gaps by rank, gaps shrink, and the next step begins with what is pending.

New sequences are opened at the start of a step, as many as best fit over the two histograms of sizes would open (at most `capacity`
counts each), so that none is opened too early. Sort keys end in a salt that changes from step to step: a size which a third of the rows have is
many ranges, with its gaps beside it. A step ends in written tables. A data set that fits in one range is packed by best-fit decreasing exactly.

Defined results: null texts count as empty and are the end id alone; repeated rows and rows with a null id are packed each for itself; a
size that is null, below 1 or above the capacity is an error; an empty table gives no rows; further columns pass through `best_fit`, also if they are
called like one of its own, other than sequence_id and offset, which it replaces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import tidy
from .common import written
from .token_files import _encoder, crc32

GAP, ROW, PLACED = 0, 1, 2
#: Rows and gaps in a range.
RANGE = 200_000


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all are full but the first."""
    return [n % capacity] * (n > capacity and n % capacity > 0) + [capacity] * (n // capacity) if n > capacity else [n]


def _pieces(tokenizer: str, end_id: int, capacity: int, kind: str, row: Callable, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer, kind), np.array([end_id], kind)
        for batch in batches:
            for i in range(0, len(batch), 256):
                rows = batch.slice(i, 256)
                at, piece, start, length, value = [], [], [], [], []
                for j, x in enumerate(encoder.encode(rows.column(1).to_pylist())):
                    ids, low = np.r_[np.frombuffer(x, kind), end], 0
                    for p, n in enumerate(cut(len(ids), capacity)):
                        at.append(j)
                        piece.append(p)
                        start.append(low)
                        length.append(n)
                        value.append(row(ids[low : low + n]))
                        low += n
                columns = [rows.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", name])

    return tidy(run)


def pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text: str = "text", kind: str = "<u2", row: Callable = crc32, column: str = "ids_crc32 long") -> DataFrame:
    """(doc_id, piece, start, length, column): the pieces of each document's ids and end id. row makes the column's value from a piece's ids."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, {column}"
    return rows.mapInArrow(_pieces(tokenizer, end_id, capacity, kind, row, column.split()[0]), schema)


def new_sequences(rows: np.ndarray, gaps: np.ndarray) -> int:
    """Sequences that best fit, largest rows first, opens beyond these gaps. rows[s], gaps[s]: how many there are of size s, up to the capacity."""
    capacity, gaps, opened = len(gaps) - 1, gaps.copy(), 0
    for s in np.flatnonzero(rows)[::-1].tolist():
        left = int(rows[s])
        held = [*(np.flatnonzero(gaps[s:]) + s).tolist(), None]
        for g in held:
            if not left:
                break
            new, g = g is None, g or capacity
            k = g // s
            full, some = divmod(left, k)
            if not new and full >= gaps[g]:
                full, some = int(gaps[g]), 0
            opened += (full + (some > 0)) * new
            gaps[g] -= (full + (some > 0)) * (not new)
            gaps[g - k * s] += full
            gaps[g - some * s] += some > 0
            left -= full * k + some
    return opened


def matched(rows: dict[int, np.ndarray], gaps: dict[int, np.ndarray], capacity: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Best fit, largest rows first: (row ids, sequences, offsets). What is left stays in rows and gaps, by size."""
    sizes = sorted(gaps)

    def put(size: int, seqs: np.ndarray) -> None:
        if not len(seqs) or not size:
            return
        if size not in gaps:
            insort(sizes, size)
        gaps[size] = np.r_[gaps[size], seqs] if size in gaps else seqs

    for s in sorted(rows, reverse=True):
        while len(rows[s]) and (at := bisect_left(sizes, s)) < len(sizes):
            g = sizes[at]
            k, left = g // s, len(rows[s])
            seqs = gaps.pop(sizes.pop(at))
            used = min(len(seqs), -(-left // k))
            n = min(left, used * k)
            yield rows[s][:n], np.repeat(seqs[:used], k)[:n], capacity - g + s * (np.arange(n) % k)
            rows[s] = rows[s][n:]
            put(g, seqs[used:])
            whole = n // k
            put(g - k * s, seqs[:whole])
            put(g - (n - whole * k) * s, seqs[whole:used])
        if not len(rows[s]):
            del rows[s]


def _by_size(ids: np.ndarray, sizes: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(sizes, kind="stable")
    held, first = np.unique(sizes[order], return_index=True)
    return dict(zip(held.tolist(), np.split(ids[order], first[1:]), strict=True)) if len(ids) else {}


_SWEPT = "part int, kind int, id long, size int, rank long, sequence_id long, offset long"


def _sweep(capacity: int):
    """Of a range: rows placed; rows left, ranked from the largest; gaps left, ranked from the smallest if all ranges below can use them, else -1."""

    def batch(part, kind, ids, sizes=None, ranks=None, seqs=None, offsets=None):
        none = lambda t: pa.nulls(len(ids), t)
        columns = [pa.array(np.full(len(ids), part), pa.int32()), pa.array(np.full(len(ids), kind), pa.int32()), pa.array(ids, pa.int64())]
        columns += [none(pa.int32()) if sizes is None else pa.array(sizes, pa.int32()), none(pa.int64()) if ranks is None else pa.array(ranks, pa.int64())]
        columns += [none(pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (seqs, offsets)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SWEPT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        part = TaskContext.get().partitionId()
        kind, ids, sizes = (np.asarray(table[c]) for c in ("kind", "id", "size"))
        floor = sizes.min()
        rows, gaps = (_by_size(ids[kind == k], sizes[kind == k]) for k in (ROW, GAP))
        for placed, seqs, offsets in matched(rows, gaps, capacity):
            yield batch(part, PLACED, placed, seqs=seqs, offsets=offsets)
        for k, held, order in ((ROW, rows, sorted(rows, reverse=True)), (GAP, gaps, sorted(gaps))):
            if order:
                size = np.repeat(order, [len(held[s]) for s in order])
                usable = np.arange(len(size)) - int((size < floor).sum())
                yield batch(part, k, np.concatenate([held[s] for s in order]), size, np.maximum(usable, -1))

    return tidy(run)


def shared_out(ranges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which rows left in a range go to which gaps left in the ranges above it.

    ranges, largest sizes first: (range, rows left, their largest size, usable gaps left, their smallest size). Returns intervals of ranks:
    (range, first row, end, range of the gaps, first gap, rows a gap)."""
    held, out = [], []
    for part, rows, largest, gaps, smallest in ranges:
        row = 0
        while row < rows and held:
            above, first, end, least = held.pop()
            k = least // largest
            used = min(end - first, -(-(rows - row) // k))
            n = min(rows - row, used * k)
            out.append((part, row, row + n, above, first, k))
            row += n
            if first + used < end:
                held.append((above, first + used, end, least))
        if gaps:
            held.append((part, 0, gaps, smallest))
    return out


def _step(state: DataFrame, counts: int, step: int, capacity: int) -> tuple[DataFrame, list[DataFrame]]:
    """The next state, and the tables of what was placed."""
    spark = state.sparkSession
    salt = F.xxhash64("id", "kind", F.lit(step))
    dealt = state.withColumn("salt", salt).repartitionByRange(max(1, -(-counts // RANGE)), F.desc("size"), "salt").select("kind", "id", "size")
    swept = written(dealt.mapInArrow(_sweep(capacity), _SWEPT), "swept")
    n = lambda kind, f: F.coalesce(f(F.when(F.col("kind") == kind, F.col("size"))), F.lit(0))
    ranges = swept.filter("rank >= 0").groupBy("part").agg(n(ROW, F.count).alias("rows"), n(ROW, F.max).alias("largest"), n(GAP, F.count).alias("gaps"), n(GAP, F.min).alias("smallest"))
    ways = shared_out(sorted((r["part"], r["rows"], r["largest"], r["gaps"], r["smallest"]) for r in ranges.collect()))
    rows, gaps = swept.filter(F.col("kind") == ROW), swept.filter(F.col("kind") == GAP)
    if not ways:
        return rows.unionByName(gaps).select("kind", "id", "size"), [swept.filter(F.col("kind") == PLACED).select("id", "sequence_id", "offset")]
    to = F.broadcast(spark.createDataFrame([(*w, w[4] + -(-(w[2] - w[1]) // w[5])) for w in ways], "part int, low long, high long, above int, first long, k long, end long"))
    goes = (rows["part"] == to["part"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    # Rows meet their gaps by rank: the gap's range, its rank there, and the row's turn in it.
    sent = rows.join(to, goes).select("id", "size", F.col("above").alias("part"), F.expr("first + (rank - low) div k").alias("rank"), F.expr("(rank - low) % k").alias("turn"))
    taken = gaps.select("part", "rank", F.col("id").alias("sequence_id"), F.col("size").alias("room"))
    inside = Window.partitionBy("sequence_id")
    met = sent.join(taken, ["part", "rank"])
    before = F.coalesce(F.sum("size").over(inside.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = written(met.select("id", "sequence_id", "turn", (F.lit(capacity) - F.col("room") + before).cast("long").alias("offset"), (F.col("room") - F.sum("size").over(inside)).cast("int").alias("left")), "met")
    gone = (gaps["part"] == to["above"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    state = rows.join(to, goes, "left_anti").unionByName(gaps.join(to, gone, "left_anti")).select("kind", "id", "size")
    state = state.union(met.filter("turn = 0 AND left > 0").select(F.lit(GAP).alias("kind"), F.col("sequence_id").alias("id"), F.col("left").alias("size")))
    return state, [swept.filter(F.col("kind") == PLACED).select("id", "sequence_id", "offset"), met.select("id", "sequence_id", "offset")]


def best_fit(df: DataFrame, size: str = "length", capacity: int = 1024, most_steps: int = 1_000) -> DataFrame:
    """df with sequence_id (any numbers) and offset, the row's place in its sequence, gapless from 0."""
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in ("sequence_id", "offset")]
    table = written(df.select(F.struct(*keep).alias("row"), F.monotonically_increasing_id().alias("id"), F.col(size).cast("long").alias("size")), "unpacked")
    if not table.filter(f"size IS NULL OR size < 1 OR size > {capacity}").isEmpty():
        raise ValueError(f"sizes have to be from 1 to {capacity}")
    sized = table.select("id", F.col("size").cast("int").alias("size"))
    large = F.col("size") * 2 > capacity
    placed = [sized.filter(large).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    state = sized.filter(~large).select(F.lit(ROW).alias("kind"), "id", "size")
    state = state.union(sized.filter(large & (F.col("size") < capacity)).select(F.lit(GAP).alias("kind"), "id", (F.lit(capacity) - F.col("size")).alias("size")))
    opened = 0
    for step in range(most_steps):
        counts = np.zeros((2, capacity + 1), np.int64)
        for r in state.groupBy("kind", "size").agg(F.count("*").alias("n")).collect():
            counts[r["kind"], r["size"]] = r["n"]
        if not counts[ROW].any():
            break
        least = int(np.flatnonzero(counts[ROW])[0])
        counts[GAP, :least] = 0
        new = new_sequences(counts[ROW], counts[GAP])
        # Sequences opened by steps have negative numbers.
        more = spark.range(-opened - new, -opened).select(F.lit(GAP).alias("kind"), "id", F.lit(capacity).alias("size"))
        opened += new
        state, done = _step(state.filter((F.col("kind") == ROW) | (F.col("size") >= least)).union(more), int(counts.sum()) + new, step, capacity)
        placed += done
    else:
        raise RuntimeError(f"rows are pending after {most_steps} steps")
    every = placed[0]
    for p in placed[1:]:
        every = every.union(p)
    return table.join(every, "id").select("row.*", "sequence_id", "offset")
