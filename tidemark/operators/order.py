"""Order and limits. Limits are top-k plans (each task keeps k rows), never full sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: Column | str, n: int, *ties: str) -> DataFrame:
    """The n greatest, missing values last; ties by the columns given."""
    c = F.col(by) if isinstance(by, str) else by
    return df.orderBy(c.desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]).limit(n)


def extreme_movers(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Largest increase and largest decrease of each group; equal values go to the smallest code."""
    up = F.min_by(tie, F.struct(-F.col(value), F.col(tie)))
    down = F.min_by(tie, F.struct(F.col(value), F.col(tie)))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(up.alias("largest_increase"), F.max(value).alias("increase"), down.alias("largest_decrease"), F.min(value).alias("decrease"))


def ordered_by_domain(df: DataFrame, column: str, values: list[str], output: str = "domain_order") -> DataFrame:
    """df with the place of the column in a fixed list; values outside it come last."""
    place = F.coalesce(*[F.when(F.col(column) == v, F.lit(i)) for i, v in enumerate(values)], F.lit(len(values)))
    return df.withColumn(output, place)


def stable_order(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def ranked(df: DataFrame, keys: list[str], by: str, *ties: str, output: str = "place") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), *ties)
    return df.withColumn(output, F.row_number().over(order))
