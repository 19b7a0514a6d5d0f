"""Quality classifier: gradient-boosted trees over document statistics.

Statistics come from whole texts. The model is fitted on at most `most` distinct labelled rows, the first in the order of
a hash of their id (the bound is that parameter: 20,000 rows of 18 numbers reach the driver); scoring runs
over all rows in tasks that hold the flattened trees, a few kilobytes.

Defined results: a null text counts as empty, and an empty one is scored like any other; rows whose id or label
is null, and ids with several different labels, are not learnt from; equal texts get equal scores; a
table without usable labels gives the score 1/2 to all; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .boosting import Trees, fit

STATISTICS = (
    "log_bytes", "word_length", "long_words", "lower", "upper", "digit", "symbol", "mark", "exclamation", "foreign",
    "entropy", "distinct_words", "top_word", "repeated_windows", "words_a_line", "distinct_lines", "short_words", "log_words",
)
_SETS = [np.isin(np.arange(256), list(x)) for x in (range(97, 123), range(65, 91), range(48, 58), b"#*$%&|<>", b".,;:?", b"!", range(128, 256))]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each document of a slice."""
    starts, ends, first = arrays.words(data, offsets)
    hashes = arrays.word_hashes(data, starts, ends)
    length = ends - starts
    windows = arrays.window_hashes(hashes, 5)
    breaks = np.r_[0, np.cumsum(data == 10)]
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for r in range(len(out)):
        a, b = offsets[r], offsets[r + 1]
        if a == b:
            continue
        text = data[a:b]
        count = np.bincount(text, minlength=256)
        share = count / (b - a)
        seen = share[share > 0]
        i, j = first[r], first[r + 1]
        n = j - i
        out[r, 0] = np.log1p(b - a)
        out[r, 3:10] = [share[s].sum() for s in _SETS]
        out[r, 10] = -(seen * np.log2(seen)).sum()
        if n:
            own = length[i:j]
            times = np.unique(hashes[i:j], return_counts=True)[1]
            w = windows[i : j - 4]
            lines = breaks[b] - breaks[a] + 1
            out[r, 1] = own.mean()
            out[r, 2] = (own > 12).mean()
            out[r, 11] = len(times) / n**0.8
            out[r, 12] = times.max() / n
            out[r, 13] = 1 - len(np.unique(w)) / len(w) if len(w) else 0
            out[r, 14] = np.log1p(n / lines)
            out[r, 15] = len(set(text.tobytes().split(b"\n"))) / lines
            out[r, 16] = (own < 3).mean()
            out[r, 17] = np.log1p(n)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(data, offsets) for _, _, data, offsets in arrays.slices(batch.column(1))]
        if rows:
            x = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["_id", "y", "x"])


def learnt(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, most: int = 20_000) -> Trees:
    """Trees fitted on at most `most` of the labelled rows."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).alias("y"), F.max(label).alias("z")).filter("y = z")
    chosen = marked.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(most).select(F.col(id_col).alias("_id"), F.col("y").cast("double").alias("y"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")  # at most `most` rows
    # An id may stand in many rows: equal ones count once, and the bound holds for rows, too.
    measured = rows.select("y", "text", F.col("_id").cast("string").alias("_id")).mapInArrow(_measured, "_id string, y double, x array<double>").distinct()
    got = measured.orderBy(F.xxhash64("_id"), "_id", "x").limit(most).select("y", "x").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(STATISTICS))
    y = np.asarray(got["y"], float)
    order = np.lexsort([*x.T, y])  # the same sums in any order of arrival
    return fit(x[order], y[order])


def scored(docs: DataFrame, trees: Trees, text: str, keep: list[str], output: str = "score") -> DataFrame:
    """The columns in keep, with the probability of label 1 in `output`. Only texts and scores travel to Python and back."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def score(texts: pa.Array) -> pa.Array:
        rows = [shared.value.score(statistics(data, offsets)) for _, _, data, offsets in arrays.slices(texts)]
        return pa.array(np.concatenate(rows) if rows else np.zeros(0))

    return docs.select(*keep, F.arrow_udf(score, "double")(F.coalesce(text, F.lit(""))).alias(output))


def held_out(id_col: str):
    """Whether the row is kept for evaluation: crc32 of the id as text is divisible by 5."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0
