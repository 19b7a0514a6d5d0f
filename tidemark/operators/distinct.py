"""Exact distinct counts that merge: bitmaps over numbered values, kept per vintage and added up without going back to rows.

Values are numbered once in a dictionary, whose numbers never change: later vintages add to it. A state has a row for each key, measure and
range of 32,768 numbers, whose bits say which values occurred; building one is a single pass with partial aggregation, whatever
the number of columns counted, and a state is as large as its bits, not as its rows. States of vintages, regions or parts of a
table are merged by OR, so a total over any of them is exact, which a sum of distinct counts is not.

Nulls are no values and are not counted; a key that is null is a key like any other; an empty table gives an empty state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Numbers of one task of one extension lie together: the task's number stands before this many bits.
_TASK = 33


def dictionary(df: DataFrame, columns: list[str], known: DataFrame | None = None) -> DataFrame:
    """measure, value, number: a number for each distinct value of the columns. known: a dictionary whose numbers stay as they are."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")).select("e.*")
    new = each.filter("value IS NOT NULL").distinct()
    base = 0
    if known is not None:
        last = known.agg(F.max("number")).first()[0]
        base = 0 if last is None else (last >> _TASK) + 1
        new = new.join(known, ["measure", "value"], "left_anti")
    new = written(new.withColumn("number", F.monotonically_increasing_id() + F.lit(base << _TASK)), "dictionary")
    return new if known is None else known.select("measure", "value", "number").union(new)


def state(df: DataFrame, keys: list[str], columns: list[str], numbers: DataFrame) -> DataFrame:
    """keys, measure, bucket, bits: which values of the columns occur under the keys."""
    each = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")).select(*keys, "e.*")
    # Equal rows meet once before they look up their number.
    found = each.filter("value IS NOT NULL").distinct().join(numbers, ["measure", "value"])
    return found.groupBy(*keys, "measure", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def merged(states: list[DataFrame], keys: list[str]) -> DataFrame:
    """The state over all of them under these keys, which may be fewer than theirs."""
    every = reduce(DataFrame.unionByName, [s.select(*keys, "measure", "bucket", "bits") for s in states])
    return every.groupBy(*keys, "measure", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counts(of: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, and a column of distinct values for each measure, 0 where none occurred."""
    n = F.bitmap_count("bits")
    return of.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("measure") == c, n)), F.lit(0)).alias(f"n_{c}") for c in columns])
