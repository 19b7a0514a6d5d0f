"""Snapshots and registers over several panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import SCOPE
from ..functions.lineage import FIELDS
from ..functions.numbers import safe_growth, share, sum_or_null
from ..operators.joins import star_join
from ..operators.windows import latest_period
from .fiscal import transfers


def receipts_summary(receipts: DataFrame) -> DataFrame:
    """Each region's latest total, its growth (withheld if the set of sections changed over the year), and sections that are missing now."""
    by = receipts.filter("flow IS NOT NULL").groupBy("region_id", "period").agg(sum_or_null("flow").alias("total"), F.sort_array(F.collect_set("section")).alias("sections"))
    ever = receipts.filter("flow IS NOT NULL").groupBy("region_id").agg(F.sort_array(F.collect_set("section")).alias("ever"), F.max("period").alias("period"))
    prior = by.select("region_id", F.add_months("period", 12).alias("period"), F.col("total").alias("prior_total"), F.col("sections").alias("prior_sections"))
    out = by.join(ever, ["region_id", "period"]).join(prior, ["region_id", "period"], "left")
    changed = F.coalesce((F.size("prior_sections") > 0) & (F.col("sections") != F.col("prior_sections")), F.lit(False))
    growth = F.when((F.col("prior_total") != 0) & ~changed, (F.col("total") / F.col("prior_total") - 1) * 100)
    return out.select("region_id", "period", "total", growth.alias("yoy_pct"), changed.alias("coverage_changed"), F.array_join(F.array_except("ever", "sections"), ",").alias("missing_sections"))


def section_snapshot(receipts: DataFrame) -> DataFrame:
    """Level, share, change and growth of every section at its region's latest period."""
    sums = receipts.filter("flow IS NOT NULL").groupBy("region_id", "period", "section").agg(sum_or_null("flow").alias("level"))
    now = latest_period(sums, ["region_id"]).filter("period = latest_period").drop("latest_period")
    prior = sums.select("region_id", F.add_months("period", 12).alias("period"), "section", F.col("level").alias("prior"))
    total = F.sum("level").over(Window.partitionBy("region_id"))
    out = now.withColumn("share_pct", F.when(total != 0, F.col("level") / total * 100)).join(prior, ["region_id", "period", "section"], "left")
    return out.withColumns({"change": F.col("level") - F.col("prior"), "yoy_pct": safe_growth("level", "prior")})


def headline_and_sections(production: DataFrame) -> DataFrame:
    """Each region's latest published month: the headline beside every section."""
    now = latest_period(production.filter("index_value IS NOT NULL"), ["region_id"]).filter("period = latest_period").drop("latest_period")
    headline = F.max(F.when(F.col("section") == "TOTAL", F.col("index_value"))).over(Window.partitionBy("region_id"))
    return now.withColumn("headline", headline).filter("section <> 'TOTAL'").select("region_id", "period", "section", "index_value", "headline")


def plan_snapshot(revenue: DataFrame, concepts: dict[str, str]) -> DataFrame:
    """Plan execution by concept (code to name) at each region's latest period; withheld where a plan does not reconcile."""
    now = latest_period(revenue, ["region_id"]).filter("period = latest_period")
    metric = F.coalesce(*[F.when(F.col("revenue_code") == c, n) for c, n in concepts.items()])
    now = now.withColumn("metric", metric).filter("metric IS NOT NULL").withColumn("plan", F.coalesce("revised_plan_rub", "approved_plan_rub"))
    out = now.groupBy("region_id", "period", "metric").agg(
        sum_or_null("actual_ytd_rub").alias("actual_rub"), sum_or_null("plan").alias("plan_rub"), F.bool_or(F.col("revised_plan_rub").isNotNull()).alias("_revised"), F.bool_and(F.coalesce("plan_components_reconciled", F.lit(False))).alias("_sound")
    )
    all_sound = F.bool_and("_sound").over(Window.partitionBy("region_id"))
    out = out.withColumn("execution_pct", F.when(all_sound, share("actual_rub", "plan_rub"))).withColumn("plan_basis", F.when(F.col("_revised"), "Revised plan").otherwise("Reported approved plan"))
    return out.select("region_id", "period", "metric", "actual_rub", "plan_rub", "execution_pct", "plan_basis")


def regional_status(fiscal: DataFrame, revenue: DataFrame, cumulative: DataFrame) -> DataFrame:
    """A row for each region and cutoff of the fiscal table: transfers, balance and production to date, with the balance's
    lineage where the table has it. What is missing stays null; an ambiguous part or another budget level is an error."""
    keys = ["region_id", "period"]
    balance = fiscal.filter("kind = 'summary' AND metric_code = 'budget_balance'")
    wrong = F.raise_error(F.lit("the overview takes the consolidated regional budget alone")).isNull()
    balance = balance.filter(F.when(F.col("budget_level").eqNullSafe(SCOPE), F.lit(True)).otherwise(wrong))
    lineage = [F.col(c).alias(f"balance_{c}") for c in FIELDS if c in fiscal.columns]
    balance = balance.select(*keys, F.col("actual_ytd_rub").alias("budget_balance_rub"), *lineage)
    moved = transfers(revenue).select(*keys, "transfers_rub", "transfer_share_pct", "transfer_share_change_pp")
    made = cumulative.filter("section = 'TOTAL'").select(*keys, F.col("index_value").alias("production_index"), "growth_yoy_pct")
    return star_join(fiscal.select(*keys).distinct(), [moved, balance, made], keys)


def compared_regions(receipts: DataFrame, production: DataFrame, budget: DataFrame, a: str, b: str, pit: str) -> DataFrame:
    """Two regions' receipts growth, production headline and execution of the PIT plan (revenue code `pit`), side by side."""
    pair = lambda df: df.filter(F.col("region_id").isin(a, b))
    growth = receipts_summary(pair(receipts)).select("region_id", F.lit("receipts_yoy_pct").alias("indicator"), F.col("yoy_pct").alias("value"))
    head = headline_and_sections(pair(production)).select("region_id", "headline").distinct().select("region_id", F.lit("production_headline").alias("indicator"), F.col("headline").alias("value"))
    done = plan_snapshot(pair(budget), {pit: "PIT"}).select("region_id", F.lit("pit_plan_execution_pct").alias("indicator"), F.col("execution_pct").alias("value"))
    side = lambda r, n: F.max(F.when(F.col("region_id") == r, F.col("value"))).alias(n)
    return growth.unionByName(head).unionByName(done).groupBy("indicator").agg(side(a, "value_a"), side(b, "value_b"))


def source_rollup(facts: DataFrame, register: DataFrame, keys: list[str], foreign: str, label: str) -> DataFrame:
    """Per key: latest period, and the distinct labels of the sources in use then.

    Keys may be few and facts many: a source is in use at a key's latest period if its own latest is that one, so a row a
    source is left before anything meets by key."""
    used = facts.groupBy(*keys, foreign).agg(F.max("period").alias("period"))
    latest = used.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("period").alias("_period"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("period") == F.col("_period"))
    now = used.join(latest, same, "left_semi")
    named = now.join(register.select(F.col("source_id").alias(foreign), label), foreign, "left")
    return named.groupBy(*keys).agg(F.max("period").alias("period"), F.count_distinct(foreign).alias("n_sources"), F.array_join(F.sort_array(F.collect_set(label)), ", ").alias("labels"))


def region_list(*tables: DataFrame) -> DataFrame:
    """Entities of several tables; each attribute is the first non-empty one in the order of the tables."""
    ranked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [t.withColumn("_rank", F.lit(i)) for i, t in enumerate(tables)])
    named = ranked.filter(F.trim("region_id") != "")
    attributes = [c for c in ranked.columns if c not in ("region_id", "_rank")]
    first = lambda c: F.min_by(F.trim(c), F.when(F.trim(c) != "", F.col("_rank"))).alias(c)
    return named.groupBy("region_id").agg(*[first(c) for c in attributes])


def coverage_registry(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """A row a table (frame, value column): rows, first and last period, missing values, and those of the last period."""
    out = []
    for name, (df, value) in tables.items():
        by = df.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("m"))
        out.append(by.agg(F.lit(name).alias("table_name"), F.sum("n").alias("n_rows"), F.min("period").alias("earliest"), F.max("period").alias("latest"), F.sum("m").alias("n_missing"), F.max_by("m", "period").alias("n_missing_latest")))
    return reduce(DataFrame.unionByName, out)
