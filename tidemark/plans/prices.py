"""Price panels: changes against exact months, flags of large moves, and one-month views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import large_move
from ..operators.joins import calendar_join, grid_join
from ..operators.quality import price_availability

GRAIN = ["region_id", "fuel_grade"]


def price_history(raw: DataFrame, lineage: tuple[str, ...] = ()) -> DataFrame:
    """Month and year changes with their status, the prior row's period and lineage, and a review flag. A gap is never bridged."""
    data = price_availability(raw)
    for months, prefix, change in ((1, "previous_month_", "mom"), (12, "previous_year_", "yoy")):
        data = calendar_join(data, GRAIN, ["price", "availability", *lineage], prefix, months, keep_period=True)
        before = F.col(prefix + "price")
        status = (
            F.when(F.col("price").isNull(), "current_price_unavailable")
            .when(F.col(prefix + "period").isNull(), "prior_period_unavailable")
            .when(before.isNull(), "prior_price_unavailable")
            .otherwise("matched")
        )
        data = data.withColumns({f"expected_{prefix}period": F.add_months("period", -months), f"{change}_change_pct": 100 * (F.col("price") - before) / before, f"{change}_status": status})
    flag = large_move("mom_change_pct")
    review = F.when(flag, "review_large_monthly_change").when(F.col("mom_change_pct").isNull(), "not_assessable_missing_comparison").otherwise("no_large_monthly_change_flag")
    return data.withColumns({"mom_review_flag": flag, "review_status": review})


def latest_prices(history: DataFrame, grades: list[str], month=None) -> DataFrame:
    """Every region's one reporting month (its own latest, or the one given), each grade a row; absent ones say so and carry no price."""
    if month is None:
        dated = history.withColumn("_month", F.max("period").over(Window.partitionBy("region_id")))
    else:
        dated = history.withColumn("_month", F.lit(month).cast("date"))
    now = dated.filter("period = _month").select("region_id", "fuel_grade", "price", "availability", "mom_change_pct", "mom_status", "yoy_change_pct", "yoy_status", "mom_review_flag")
    keys = dated.select("region_id", F.col("_month").alias("period")).distinct()
    out = grid_join(keys, now.withColumn("observation_present", F.lit(True)).join(keys, "region_id"), ["region_id", "period"], "fuel_grade", grades)
    absent = F.col("observation_present").isNull()
    return out.withColumns({
        "observation_present": ~absent, "availability": F.when(absent, "no_observation_for_reporting_month").otherwise(F.col("availability")),
        "mom_status": F.when(absent, "current_price_unavailable").otherwise(F.col("mom_status")), "yoy_status": F.when(absent, "current_price_unavailable").otherwise(F.col("yoy_status")),
        "mom_review_flag": F.coalesce("mom_review_flag", F.lit(False)),
    })


def scoped_history(history: DataFrame, regions: list[str], grades: list[str]) -> DataFrame:
    return history.filter(F.col("region_id").isin(*regions) & F.col("fuel_grade").isin(*grades))


def audit_summary(history: DataFrame) -> DataFrame:
    """Per grade: months, reported, missing, comparisons and flagged moves."""
    return history.groupBy("fuel_grade").agg(
        F.countDistinct("period").alias("n_months"), F.count("price").alias("n_reported"), F.count_if(F.col("price").isNull()).alias("n_missing"),
        F.count("mom_change_pct").alias("n_compared"), F.count_if("mom_review_flag").alias("n_flagged"),
    )
