"""Aggregations that keep "missing" and "zero" apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import share, sum_or_null


def sum_with_least(df: DataFrame, keys: list[str], value: str, least: int = 1, output: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(sum_or_null(value, least).alias(output or value))


def contributions(current: DataFrame, previous: DataFrame, group: str, value: str, within: list[str] | None = None) -> DataFrame:
    """Each group's change as percentage points of the previous total. A group missing on one side counts as zero here."""
    keys = [*(within or []), group]
    a = current.groupBy(*keys).agg(F.sum(value).alias("current"))
    b = previous.groupBy(*keys).agg(F.sum(value).alias("previous"))
    both = a.join(b, keys, "full_outer").fillna(0, ["current", "previous"])
    total = F.sum("previous").over(Window.partitionBy(*(within or [F.lit(1)])))
    both = both.withColumns({"change": F.col("current") - F.col("previous"), "_total": total})
    return both.withColumn("contribution_pp", F.when(F.col("_total") > 0, F.col("change") / F.col("_total") * 100)).drop("_total")


def plan_execution(df: DataFrame, actual: str = "actual_ytd_rub", revised: str = "revised_plan_rub", approved: str = "approved_plan_rub") -> DataFrame:
    """Row-level plan use: the revised plan, else the approved one."""
    plan = F.coalesce(revised, approved)
    return df.withColumns({"plan_used_rub": plan, "execution_pct": share(F.col(actual), plan), "remaining_to_plan_rub": plan - F.col(actual)})


def coverage(df: DataFrame, keys: list[str], value: str, period: str = "period") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_reported"), F.count_if(F.col(value).isNull()).alias("n_missing"), F.min(period).alias("earliest"), F.max(period).alias("latest")
    )


def calendar_holes(df: DataFrame, keys: list[str], codes: int, period: str = "period") -> DataFrame:
    """Rows that a full monthly calendar from first to last period would have, and how many are absent."""
    months = F.months_between(F.trunc(F.max(period), "month"), F.trunc(F.min(period), "month")).cast("long") + 1
    return df.groupBy(*keys).agg((months * codes).alias("n_expected"), F.count(F.lit(1)).alias("n_present")).withColumn("n_absent", F.col("n_expected") - F.col("n_present"))


def distinct_counts(df: DataFrame, row: str, column: str, values: list[str], counted: str) -> DataFrame:
    """Exact distinct counts, one column a value."""
    each = [F.countDistinct(F.when(F.col(column) == v, F.col(counted))).alias(v) for v in values]
    return df.groupBy(row).agg(*each)


def status_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def codes_to_columns(df: DataFrame, keys: list[str], code: str, value: str, codes: dict[str, str]) -> DataFrame:
    """One row a key, a column for each code. The codes are given, so no pass is spent on finding them."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(code) == c, F.col(value))).alias(n) for c, n in codes.items()])


def coverage_matrix(df: DataFrame, row: str, column: str, values: list[str], status: str, absent: str = "absent") -> DataFrame:
    cells = [F.coalesce(F.min(F.when(F.col(column) == v, F.col(status))), F.lit(absent)).alias(str(v)) for v in values]
    return df.groupBy(row).agg(*cells)


def duplicate_grain(df: DataFrame, grain: list[str]) -> DataFrame:
    """One row: how many rows share their grain with another."""
    return df.groupBy(*grain).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_duplicate_rows"))


def missing_counts(df: DataFrame) -> DataFrame:
    """(field, n_missing) of every column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], list(df.columns), "field", "n_missing")


def field_dictionary(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """(table_name, field, type, is_key, n_missing)."""
    types = F.coalesce(*[F.when(F.col("field") == f.name, f.dataType.simpleString()) for f in df.schema])
    return missing_counts(df).select(F.lit(table).alias("table_name"), "field", types.alias("type"), F.col("field").isin(*keys).alias("is_key"), "n_missing")


def all_and_any(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_and(condition).alias("all_hold"), F.bool_or(condition).alias("any_holds"))


def registry(df: DataFrame, code: str, label: str, period: str) -> DataFrame:
    """Codes with first and last period, periods seen, and whether their label ever changed."""
    return df.groupBy(code).agg(
        F.min(period).alias("first_period"), F.max(period).alias("last_period"), F.countDistinct(period).alias("n_periods"), F.countDistinct(label).alias("n_labels"), F.min(label).alias("label")
    ).withColumn("label_drift", F.col("n_labels") > 1)


def column_fingerprints(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """(field, n_entities, low, high): equal for columns with equal values in every entity, in any order of rows.

    A row's entity and value are hashed, and sums of two 28-bit parts of the hash are taken, so that a column is never
    in one place; sums stay exact up to 2^35 rows a column."""
    long = df.unpivot([entity], [F.col(c).cast("string").alias(c) for c in columns], "field", "value")
    pair = F.md5(F.concat_ws("=", F.col(entity).cast("string"), F.coalesce("value", F.lit(""))).cast("binary"))
    part = lambda at: F.sum(F.conv(F.substring(pair, at, 7), 16, 10).cast("long"))
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("n_entities"), part(1).alias("low"), part(8).alias("high"))


def review_queue(df: DataFrame, entity: str | list[str], period: str, passed: Column) -> DataFrame:
    """Entities with observed and passed periods, first and last, and whether something is left to review."""
    keys = [entity] if isinstance(entity, str) else entity
    out = df.groupBy(*keys).agg(F.countDistinct(period).alias("n_observed"), F.count_if(passed).alias("n_passed"), F.min(period).alias("first_period"), F.max(period).alias("last_period"))
    return out.withColumn("needs_review", F.col("n_passed") < F.col("n_observed"))


def missing_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.filter(F.col(value).isNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_missing"))
