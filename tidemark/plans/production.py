"""Production indices and their alignment with receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import SECTIONS
from ..functions import calendar as cal
from ..functions.lineage import issue_list
from ..functions.numbers import safe_growth
from ..operators.joins import borrowed_context, grid_join
from ..operators.windows import latest_vintage, segments


def headline_history(production: DataFrame) -> DataFrame:
    """The total's index on its complete monthly calendar, up to its last value; segments change at gaps."""
    total = production.filter("section = 'TOTAL'").select("region_id", "period", "index_value", "growth_yoy_pct")
    span = total.groupBy("region_id").agg(F.min("period").alias("a"), F.max(F.when(F.col("growth_yoy_pct").isNotNull(), F.col("period"))).alias("b")).filter("b IS NOT NULL")
    months = span.select("region_id", F.explode(cal.calendar("a", "b")).alias("period"))
    return segments(months.join(total, ["region_id", "period"], "left"), F.col("growth_yoy_pct").isNotNull(), ["region_id"])


def matched_receipts(receipts: DataFrame, cumulative: DataFrame, sections=SECTIONS, context: tuple[str, ...] = ()) -> DataFrame:
    """Receipts to date beside production to date for all sections at every receipt cutoff, absent ones included.

    receipts: region_id, section, period, ytd (and columns of context, which a missing cell borrows from its release).
    """
    facts = receipts.filter(F.col("section").isin(*sections)).select("region_id", "section", "period", F.col("ytd").alias("pit_current"), *context)
    prior = facts.select("region_id", "section", cal.shift_period("period", 12, "month_end").alias("period"), F.col("pit_current").alias("pit_prior"))
    index = cumulative.filter(F.col("section").isin(*sections)).select("region_id", "section", "period", "index_value", F.col("growth_yoy_pct").alias("production_yoy_pct"))
    grid = grid_join(receipts, facts, ["region_id", "period"], "section", list(sections))
    if context:
        grid = borrowed_context(grid, facts, ["region_id", "period"], list(context))
    out = grid.join(prior, ["region_id", "section", "period"], "left").join(index, ["region_id", "section", "period"], "left")
    change = F.col("pit_current") - F.col("pit_prior")
    issues = issue_list(
        (F.col("pit_current").isNull(), "current_pit_unavailable"), (F.col("pit_prior").isNull(), "prior_pit_unavailable"),
        (F.col("pit_prior") <= 0, "nonpositive_prior_pit_growth_withheld"), (F.col("index_value").isNull(), "production_unavailable"),
    )
    return out.withColumns({"pit_change": change, "pit_yoy_pct": F.when(F.col("pit_prior") > 0, 100 * change / F.col("pit_prior")), "window_start": cal.year_start("period"), "prior_period": cal.shift_period("period", -12, "month_end"), "availability": issues})


def cutoff_snapshot(receipts: DataFrame, production: DataFrame, sections=SECTIONS) -> DataFrame:
    """Each region's latest receipts beside the production of the same month, by section; either may be missing."""
    last = Window.partitionBy("region_id")
    now = receipts.filter("flow IS NOT NULL").withColumn("_last", F.max("period").over(last)).filter("period = _last").drop("_last")
    before = receipts.select("region_id", "section", F.add_months("period", 12).alias("period"), F.col("flow").alias("before"))
    taxes = now.join(before, ["region_id", "section", "period"], "left").filter(F.col("section").isin(*sections))
    taxes = taxes.select("region_id", "period", "section", F.col("flow").alias("pit_current"), (F.col("flow") - F.col("before")).alias("pit_change"), safe_growth("flow", "before").alias("pit_yoy_pct"))
    cutoff = now.select("region_id", "period").distinct()
    made = production.filter(F.col("section").isin(*sections) & F.col("index_value").isNotNull()).join(cutoff, ["region_id", "period"], "left_semi")
    return taxes.join(made.select("region_id", "period", "section", "index_value"), ["region_id", "period", "section"], "full_outer")


def annual_index(production: DataFrame) -> DataFrame:
    """Year-end rows of a cumulative index: the annual panel."""
    return production.filter((F.month("period") == 12) & cal.is_month_end("period")).select("region_id", "section", "period", "index_value", "growth_yoy_pct")


def selected_panel(releases: DataFrame, grain: list[str], vintage: str, *ties: str) -> DataFrame:
    return latest_vintage(releases, grain, vintage, *ties)
