"""Set operations on frames and key populations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_population(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def domain_offenders(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Distinct non-null values outside the domain."""
    return df.filter(~F.col(column).isin(*allowed)).select(column).distinct()


def same_population(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys only in a, keys only in b, and whether the populations are equal."""
    left, right = a.select(key, F.lit(True).alias("_a")).distinct(), b.select(key, F.lit(True).alias("_b")).distinct()
    both = left.join(right, key, "full_outer").agg(F.count_if(F.col("_b").isNull()).alias("n_only_a"), F.count_if(F.col("_a").isNull()).alias("n_only_b"))
    return both.withColumn("same", (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0))


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def evidence_union(*parts: tuple[str, DataFrame, str, str, str, str]) -> DataFrame:
    """Long evidence of unlike panels. Parts: (dataset, frame, indicator column, value column, units, basis)."""
    long = [
        df.select(F.lit(name).alias("dataset"), "region_id", "period", F.col(indicator).alias("indicator"), F.col(value).cast("double").alias("value"), F.lit(units).alias("units"), F.lit(basis).alias("amount_basis"))
        for name, df, indicator, value, units, basis in parts
    ]
    return union_sources(*long)
