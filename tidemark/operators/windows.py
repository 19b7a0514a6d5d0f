"""Windows over panels. Partitions are (entity, code) histories, so they stay small whatever the panel's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.numbers import safe_growth


def _frequency(df: DataFrame) -> Column:
    return F.coalesce(F.col("frequency"), F.lit("quarterly")) if "frequency" in df.columns else F.lit("quarterly")


def ytd_flows(df: DataFrame, value: str, groups: list[str], period: str = "period", output: str = "period_flow") -> DataFrame:
    """Flows of cumulative values: a year's first slot as it is, others less the adjacent earlier slot, else null.

    Negative flows stay. Months count where a column frequency says monthly, else quarters.
    """
    frequency = _frequency(df)
    history = Window.partitionBy(*groups, F.year(period)).orderBy(period)
    first = F.when(frequency == "monthly", F.month(period) == 1).otherwise(F.quarter(period) == 1)
    here = cal.slot(period, frequency)
    flow = F.when(here - F.lag(here).over(history) == 1, F.col(value) - F.lag(value).over(history))
    return df.withColumn(output, F.when(first, F.col(value)).otherwise(flow))


def same_period_yoy(df: DataFrame, value: str, groups: list[str], period: str = "period", output: str = "yoy_pct") -> DataFrame:
    """Growth over the same month or quarter of the year before; null over a gap of years."""
    frequency = _frequency(df)
    place = F.when(frequency == "monthly", F.month(period)).otherwise(F.quarter(period))
    history = Window.partitionBy(*groups, place).orderBy(F.year(period))
    growth = safe_growth(F.col(value), F.lag(value).over(history))
    return df.withColumn(output, F.when(F.year(period) - F.lag(F.year(period)).over(history) == 1, growth))


def adjacent_change(df: DataFrame, value: str, groups: list[str], period: str = "period", output: str = "mom_change_pct") -> DataFrame:
    """Percent change over the month just before; null if that month has no row."""
    history = Window.partitionBy(*groups).orderBy(period)
    here = F.year(period) * 12 + F.month(period)
    before = F.lag(value).over(history)
    return df.withColumn(output, F.when((here - F.lag(here).over(history) == 1) & (before != 0), 100 * (F.col(value) - before) / before))


def segments(df: DataFrame, present: Column, groups: list[str], order: str = "period", output: str = "segment") -> DataFrame:
    """Numbers that change wherever presence changes: rows of one number form an unbroken run."""
    history = Window.partitionBy(*groups).orderBy(order)
    change = (present != F.lag(present, 1, False).over(history)).cast("int")
    return df.withColumn("_change", change).withColumn(output, F.sum("_change").over(history.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def latest_vintage(df: DataFrame, grain: list[str], vintage: str, *ties: str, fail_on_ties: bool = False) -> DataFrame:
    """The newest row of each grain, with its nulls: an older number never fills a newer gap."""
    if fail_on_ties:
        from .joins import unique_guard

        df = unique_guard(df, [*grain, vintage], "vintages")
    order = Window.partitionBy(*grain).orderBy(F.col(vintage).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in ties])
    return df.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def keep_last(frames: list[DataFrame], keys: list[str], *order: str) -> DataFrame:
    """Union by name; of rows with equal keys the one of the last frame stays, then the greatest by `order`."""
    out = None
    for rank, f in enumerate(frames):
        f = f.withColumn("_input", F.lit(rank))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    best = Window.partitionBy(*keys).orderBy(F.col("_input").desc(), *[F.col(c).desc_nulls_last() for c in order])
    return out.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank", "_input")


def group_complete(df: DataFrame, value: str, keys: list[str], expected: int, output: str) -> DataFrame:
    """Whether the group of the row has all its expected values."""
    return df.withColumn(output, F.count(value).over(Window.partitionBy(*keys)) == expected)


def group_total(value: str, keys: list[str], least: int = 1) -> Column:
    """The group's sum beside each row; null with fewer than `least` values."""
    group = Window.partitionBy(*keys)
    return F.when(F.count(value).over(group) >= least, F.sum(value).over(group))


def share_of_group(df: DataFrame, value: str, keys: list[str], output: str = "share_pct") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(output, F.when(total > 0, F.col(value) / total * 100))


def running_positions(df: DataFrame, value: str, keys: list[str], order: str, start: Column) -> DataFrame:
    """from_value and to_value of each step, from the start on."""
    done = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    to = start + F.sum(value).over(done)
    return df.withColumns({"to_value": to, "from_value": to - F.col(value)})


def latest_period(df: DataFrame, keys: list[str], period: str = "period", output: str = "latest_period") -> DataFrame:
    return df.withColumn(output, F.max(period).over(Window.partitionBy(*keys)))


def last_n(df: DataFrame, keys: list[str], n: int, period: str = "period") -> DataFrame:
    """The last n rows of each key."""
    order = Window.partitionBy(*keys).orderBy(F.col(period).desc())
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def trailing_months(df: DataFrame, keys: list[str], months: int, period: str = "period") -> DataFrame:
    """Rows of the `months` months up to each key's latest period."""
    last = F.max(period).over(Window.partitionBy(*keys))
    return df.withColumn("_last", last).filter(F.col(period) > F.add_months("_last", -months)).drop("_last")


def forward_fill(df: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """Headers over merged cells: the last non-null value to the left."""
    seen = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(seen))
