"""Filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text


def project(df: DataFrame, contract: StructType) -> DataFrame:
    """The contract's columns in its order and types; absent ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in contract])


def of_region(df: DataFrame, region: str) -> DataFrame:
    return df.filter(F.col("region_id").cast("string") == region)


def same_month_until(df: DataFrame, cutoff, period: str = "period", same_day: bool = False) -> DataFrame:
    """History of the cutoff's month (and day) up to the cutoff."""
    c = F.lit(cutoff).cast("date")
    out = df.filter((F.month(period) == F.month(c)) & (F.col(period) <= c))
    return out.filter(F.dayofmonth(period) == F.dayofmonth(c)) if same_day else out


def without_totals(df: DataFrame, *codes: str, names: tuple[str, ...] = ()) -> DataFrame:
    """df without rows whose code or name is that of a whole, which would count their parts again."""
    return df.filter(~text.is_total(codes, names))


def selected(df: DataFrame, dimension: DataFrame, wanted: list[str], aliases: str = "aliases", key: str = "region_id") -> DataFrame:
    """Rows whose entity has one of the wanted names among its aliases, in any case."""
    names = dimension.select(key, F.explode(aliases).alias("alias")).filter(F.lower(F.trim("alias")).isin(*[w.strip().lower() for w in wanted]))
    return df.join(names.select(key).distinct(), key, "left_semi")


def prefixed(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in columns})
