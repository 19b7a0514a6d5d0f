"""Budget analytics: amounts on both bases, spending functions, revenue components, and balance bridges.

Every function works on all regions and periods at once; choosing one is a filter that reaches the scan. Nothing is
interpolated: a missing endpoint leaves nulls, and a register says why.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.lineage import FIELDS
from ..functions.numbers import TOLERANCE, growth_of_change, safe_growth, share
from ..operators.joins import calendar_join, first_quarter_join, unique_guard
from .panels import CIT, FUNCTIONS, OTHER, OWN, PIT, TOTAL, TRANSFERS

KEYS = ["region_id", "period", "budget_level", "amount_basis", "window"]
#: Disjoint revenue components: code, signed parents, and whether it is published or a residual.
COMPONENTS = (
    ("retained_pit", ((1, PIT),)),
    ("cit", ((1, CIT),)),
    ("other_own", ((1, OWN), (-1, PIT), (-1, CIT))),
    ("transfers", ((1, TRANSFERS),)),
    ("other_non_repayable", ((1, OTHER), (-1, TRANSFERS))),
)
SOCIAL = ("1000", "0700", "0900")


def _codes(df: DataFrame) -> list[str]:
    return [c for c in ("kind", "metric_code", "revenue_code") if c in df.columns]


def validated(df: DataFrame) -> DataFrame:
    """df, failing when read if its grain is not unique or an amount is infinite."""
    df = unique_guard(df, ["region_id", "period", "budget_level", *_codes(df)], "observations")
    infinite = F.abs("actual_ytd_rub") == float("inf")
    return df.filter(F.when(infinite, F.raise_error(F.lit("an amount is infinite")).isNull()).otherwise(F.lit(True)))


def flows(df: DataFrame) -> DataFrame:
    """First-quarter flows are the amounts to date, second-quarter flows H1 less the same year's Q1; others are unsupported.

    evidence: JSON of both endpoints, with their lineage where df has it.
    """
    keys = ["region_id", "budget_level", *_codes(df)]
    lineage = [c for c in FIELDS if c in df.columns]
    out = first_quarter_join(df, keys, ["actual_ytd_rub", *lineage])
    window = cal.window_label("period", "Q2")
    flow = F.when(window == "Q1", F.col("actual_ytd_rub")).when(window == "Q2", F.col("actual_ytd_rub") - F.col("start_actual_ytd_rub"))
    status = (
        F.when((window == "Q1") & F.col("actual_ytd_rub").isNotNull(), "Q1 equals YTD")
        .when((window == "Q2") & F.col("actual_ytd_rub").isNotNull() & F.col("start_actual_ytd_rub").isNotNull(), "H1 minus Q1 YTD")
        .when(window.isin("Q1", "Q2"), "missing endpoint")
        .otherwise("unsupported snapshot")
    )
    start = F.when(window == "Q2", F.add_months(cal.year_start("period"), 3)).otherwise(cal.year_start("period"))
    # Both endpoints with their lineage; a missing one stays out.
    begin = F.when(F.col("start_period").isNotNull(), F.struct(*[F.col(f"start_{c}").alias(c) for c in ("period", *lineage)]))
    found = F.to_json(F.struct(F.struct("period", *lineage).alias("end"), begin.alias("start")))
    out = out.withColumns({"window": window, "quarter_flow_rub": flow, "flow_status": status, "window_start": start, "window_end": F.col("period"), "evidence": found})
    return out.drop(*[f"start_{c}" for c in lineage])


def observations(df: DataFrame, basis: str) -> DataFrame:
    """df with amount_basis, window and amount_rub: year to date, or the quarter's flow."""
    if basis == "YTD":
        out = df.withColumns({"window": cal.window_label("period"), "amount_rub": F.col("actual_ytd_rub")})
    elif basis == "period_flow":
        out = flows(df).withColumn("amount_rub", F.col("quarter_flow_rub"))
    else:
        raise ValueError(f"unsupported amount basis: {basis}")
    return out.withColumn("amount_basis", F.lit(basis))


def _function_grid(work: DataFrame, keys: list[str], functions: list[str], value: str, total: str) -> DataFrame:
    """A row for each key and function, with the total beside it, from one aggregation: (keys, metric_code, value, total)."""
    of = lambda kind, code: F.max(F.when((F.col("kind") == kind) & (F.col("metric_code") == code), F.col(value)))
    wide = work.groupBy(*keys).agg(of("summary", "expenditure_total").alias(total), *[of("expenditure_function", c).alias(f"_{c}") for c in functions])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric_code"), F.col(f"_{c}").alias(value)) for c in functions])).alias("_f")
    return wide.select(*keys, total, each).select(*keys, "_f.metric_code", f"_f.{value}", total)


def spending_functions(fiscal: DataFrame, basis: str = "YTD") -> DataFrame:
    """All 14 functions of every region and window: level, share, change over the year, contribution, completeness and gaps."""
    out = _function_grid(observations(fiscal, basis), KEYS, FUNCTIONS, "amount_rub", "total_spending_rub")
    out = out.withColumn("share_pct", share("amount_rub", "total_spending_rub"))
    same = [k for k in KEYS if k != "period"]
    out = calendar_join(out, [*same, "metric_code"], ["amount_rub", "share_pct", "total_spending_rub"], "prior_")
    change = F.col("amount_rub") - F.col("prior_amount_rub")
    out = out.withColumns({
        "change_yoy_rub": change, "growth_yoy_pct": growth_of_change(change, "prior_amount_rub"), "share_change_pp": F.col("share_pct") - F.col("prior_share_pct"),
        "contribution_pp": growth_of_change(change, "prior_total_spending_rub"),
    })
    group = Window.partitionBy(*KEYS)
    complete = F.count("amount_rub").over(group) == len(FUNCTIONS)
    gap = F.when(complete, F.sum("amount_rub").over(group)) - F.col("total_spending_rub")
    both = complete & (F.count("prior_amount_rub").over(group) == len(FUNCTIONS)) & F.col("total_spending_rub").isNotNull() & F.col("prior_total_spending_rub").isNotNull()
    return out.withColumns({"functions_complete": complete, "comparison_complete": both, "reconciles": F.abs(gap) <= TOLERANCE})


def _wide(work: DataFrame, column: str, codes: dict[str, str]) -> DataFrame:
    return work.groupBy(*KEYS).agg(*[F.max(F.when(F.col(column) == c, F.col("amount_rub"))).alias(n) for n, c in codes.items()])


def balance_endpoints(fiscal: DataFrame, basis: str = "YTD") -> DataFrame:
    """A row a region and window: revenue, spending and balance of it and of the year before, and why no bridge is possible (null if one is)."""
    work = observations(fiscal, basis).filter("kind = 'summary'")
    wide = _wide(work, "metric_code", {"revenue": "revenue_total", "spending": "expenditure_total", "balance": "budget_balance"})
    same = [k for k in KEYS if k != "period"]
    wide = calendar_join(wide, same, ["revenue", "spending", "balance"], "prior_")
    lacks = lambda p: F.col(p + "revenue").isNull() | F.col(p + "spending").isNull() | F.col(p + "balance").isNull() | (F.col("window") == "unsupported")
    open_ = lambda p: F.abs(F.col(p + "revenue") - F.col(p + "spending") - F.col(p + "balance")) > TOLERANCE
    reason = (
        F.when(lacks("prior_"), "prior-year same-window actuals are unavailable").when(open_("prior_"), "prior-year balance is not revenue minus spending")
        .when(lacks(""), "current same-window actuals are unavailable").when(open_(""), "current balance is not revenue minus spending")
    )
    return wide.withColumn("reason", reason)


def bridge_register(fiscal: DataFrame, basis: str = "YTD") -> DataFrame:
    return balance_endpoints(fiscal, basis).select("region_id", "period", "amount_basis", "window", F.coalesce("reason", F.lit("available")).alias("availability"))


def _steps(rows: list[tuple[int, str, str, Column, Column, Column]]) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.lit(role).alias("role"), value.alias("value_rub"), low.alias("from_rub"), high.alias("to_rub")) for i, label, role, value, low, high in rows
    ]))


def balance_bridge(fiscal: DataFrame, basis: str = "YTD") -> DataFrame:
    """Four steps from the prior year's balance to the current one, for every region and window that has both ends."""
    ends = balance_endpoints(fiscal, basis).filter("reason IS NULL")
    start, end, zero = F.col("prior_balance"), F.col("balance"), F.lit(0.0)
    more, spent = F.col("revenue") - F.col("prior_revenue"), F.col("spending") - F.col("prior_spending")
    steps = _steps([
        (0, "Prior balance", "anchor", start, zero, start), (1, "Revenue change", "change", more, start, start + more),
        (2, "Expenditure change", "change", -spent, start + more, end), (3, "Current balance", "anchor", end, zero, end),
    ])
    return ends.select(*KEYS, steps.alias("s")).select(*KEYS, "s.*")


def revenue_components(revenue: DataFrame, basis: str = "YTD") -> DataFrame:
    """Five disjoint components that add up to total revenue: level, share, change over the year and contribution."""
    wide = _wide(observations(revenue, basis), "revenue_code", {c: c for c in (TOTAL, OWN, PIT, CIT, OTHER, TRANSFERS)})
    amount = lambda parts: F.when(F.col("window") != "unsupported", reduce(lambda a, b: a + b, [s * F.col(f"`{c}`") for s, c in parts]))
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(n).alias("component_code"), F.lit("published_parent" if len(parts) == 1 else "derived_residual").alias("component_basis"), amount(parts).alias("amount_rub"))
        for i, (n, parts) in enumerate(COMPONENTS)
    ]))
    out = wide.select(*KEYS, F.col(TOTAL).alias("total_revenue_rub"), rows.alias("c")).select(*KEYS, "total_revenue_rub", "c.*")
    out = out.withColumn("availability", F.when(F.col("amount_rub").isNotNull(), "available").otherwise("unavailable"))
    same = [k for k in KEYS if k != "period"]
    out = calendar_join(out, [*same, "component_code"], ["amount_rub", "total_revenue_rub"], "prior_")
    change = F.col("amount_rub") - F.col("prior_amount_rub")
    out = out.withColumns({
        "change_yoy_rub": change, "growth_yoy_pct": growth_of_change(change, "prior_amount_rub"), "share_pct": share("amount_rub", "total_revenue_rub"),
        "contribution_pp": growth_of_change(change, "prior_total_revenue_rub"), "negative_amount_flag": F.coalesce(F.col("amount_rub") < 0, F.lit(False)),
    })
    group = Window.partitionBy(*KEYS)
    gap = F.when(F.count("amount_rub").over(group) == len(COMPONENTS), F.sum("amount_rub").over(group)) - F.col("total_revenue_rub")
    return out.withColumns({"comparison_complete": F.count("change_yoy_rub").over(group) == len(COMPONENTS), "reconciles": F.abs(gap) <= TOLERANCE})


def detailed_bridge(fiscal: DataFrame, revenue: DataFrame, basis: str = "YTD") -> DataFrame:
    """Eight steps: prior balance, five revenue changes, less the spending change, current balance. Where a component or a source total is missing or differs there is none."""
    ends = balance_endpoints(fiscal, basis).filter("reason IS NULL")
    parts = revenue_components(revenue, basis).filter("comparison_complete")
    totals = [F.max("total_revenue_rub").alias("_now"), F.max("prior_total_revenue_rub").alias("_then")]
    wide = parts.groupBy(*KEYS).agg(*totals, *[F.max(F.when(F.col("component_code") == n, F.col("change_yoy_rub"))).alias(n) for n, _ in COMPONENTS])
    agree = (F.abs(F.col("revenue") - F.col("_now")) <= TOLERANCE) & (F.abs(F.col("prior_revenue") - F.col("_then")) <= TOLERANCE)
    both = ends.join(wide, KEYS).filter(agree)
    at, rows = F.col("prior_balance"), [(0, "prior_balance", "anchor", F.col("prior_balance"), F.lit(0.0), F.col("prior_balance"))]
    for i, (name, _) in enumerate(COMPONENTS, 1):
        rows.append((i, name, "change", F.col(name), at, at + F.col(name)))
        at = at + F.col(name)
    spent = F.col("spending") - F.col("prior_spending")
    rows += [(6, "expenditure", "change", -spent, at, at - spent), (7, "current_balance", "anchor", F.col("balance"), F.lit(0.0), F.col("balance"))]
    return both.select(*KEYS, _steps(rows).alias("s")).select(*KEYS, "s.*")


def transfers(revenue: DataFrame, basis: str = "YTD") -> DataFrame:
    """Transfers, own revenue and total of every region and window, with shares and changes over the year."""
    wide = _wide(observations(revenue, basis), "revenue_code", {"total_revenue_rub": TOTAL, "transfers_rub": TRANSFERS, "own_source_rub": OWN})
    wide = wide.withColumn("transfer_share_pct", share("transfers_rub", "total_revenue_rub"))
    amounts = ["total_revenue_rub", "transfers_rub", "own_source_rub"]
    out = calendar_join(wide, [k for k in KEYS if k != "period"], [*amounts, "transfer_share_pct"], "prior_")
    out = out.withColumn("transfer_share_change_pp", F.col("transfer_share_pct") - F.col("prior_transfer_share_pct"))
    for a in amounts:
        change = F.col(a) - F.col("prior_" + a)
        stem = a.removesuffix("_rub")
        out = out.withColumns({f"{stem}_change_yoy_rub": change, f"{stem}_growth_yoy_pct": growth_of_change(change, "prior_" + a)})
    return out


def transfer_share(revenue: DataFrame) -> DataFrame:
    """Transfers as a share of the published total, for regions and periods that have both."""
    pick = lambda c: F.max(F.when(F.col("revenue_code") == c, F.col("actual_ytd_rub")))
    wide = revenue.groupBy("region_id", "period").agg(pick(TOTAL).alias("total"), pick(TRANSFERS).alias("part"))
    return wide.filter("total > 0 AND part IS NOT NULL").select("region_id", "period", share("part", "total").alias("transfer_share_pct"))


def revenue_indicators(revenue: DataFrame) -> DataFrame:
    """Change over the year, quarterly flow from the adjacent quarter alone, and execution (withheld where the plan does not reconcile)."""
    keys = ["region_id", "revenue_code", "budget_level"]
    out = calendar_join(revenue, keys, ["actual_ytd_rub"], "prior_year_")
    before = revenue.select(*keys, cal.next_quarter_end("period").alias("period"), F.col("actual_ytd_rub").alias("prior_quarter_ytd_rub"))
    out = out.join(before, [*keys, "period"], "left")
    end = cal.is_quarter_end("period")
    first = end & (F.month("period") == 3)
    adjacent = end & ~first & F.col("prior_quarter_ytd_rub").isNotNull()
    return out.withColumns({
        "change_yoy_rub": F.col("actual_ytd_rub") - F.col("prior_year_actual_ytd_rub"),
        "growth_yoy_pct": safe_growth("actual_ytd_rub", "prior_year_actual_ytd_rub"),
        "quarter_flow_rub": F.when(first, F.col("actual_ytd_rub")).when(adjacent, F.col("actual_ytd_rub") - F.col("prior_quarter_ytd_rub")),
        "flow_status": F.when(first, "Q1 equals YTD").when(adjacent, "adjacent YTD difference").otherwise("missing adjacent snapshot"),
        "snapshot_execution_pct": F.when(F.coalesce("plan_components_reconciled", F.lit(False)), share("actual_ytd_rub", "approved_plan_rub")),
    })


def budget_history(revenue: DataFrame, concepts: dict[str, str]) -> DataFrame:
    """Rows of published parent concepts only (concept to code), with their indicators."""
    code = F.coalesce(*[F.when(F.col("concept") == k, v) for k, v in concepts.items()])
    return revenue_indicators(revenue.withColumn("revenue_code", code).filter("revenue_code IS NOT NULL"))


def social_spending(fiscal: DataFrame, functions=SOCIAL) -> DataFrame:
    """Three parent functions of every region and period: share of spending, growth and share change over the same window, availability."""
    out = _function_grid(fiscal, ["region_id", "period"], list(functions), "actual_ytd_rub", "total_rub")
    out = out.withColumn("share_pct", F.when(F.col("total_rub") > 0, F.col("actual_ytd_rub") / F.col("total_rub") * 100))
    out = calendar_join(out, ["region_id", "metric_code"], ["actual_ytd_rub", "share_pct"], "prior_")
    return out.withColumns({
        "growth_yoy_pct": safe_growth("actual_ytd_rub", "prior_actual_ytd_rub"), "share_change_pp": F.col("share_pct") - F.col("prior_share_pct"),
        "availability": F.when(F.col("actual_ytd_rub").isNotNull(), "reported").otherwise("unavailable"),
    })


def fiscal_growth(fiscal: DataFrame) -> DataFrame:
    out = calendar_join(fiscal, ["region_id", "kind", "metric_code"], ["actual_ytd_rub"], "prior_year_")
    return out.withColumn("growth_yoy_pct", safe_growth("actual_ytd_rub", "prior_year_actual_ytd_rub"))


def own_and_spending(revenue: DataFrame, fiscal: DataFrame) -> DataFrame:
    """Own revenue and spending in long form; regions and periods whose two sources disagree in total revenue are left out."""
    a = revenue.filter(F.col("revenue_code") == TOTAL).select("region_id", "period", F.col("actual_ytd_rub").alias("_a"))
    b = fiscal.filter("metric_code = 'revenue_total'").select("region_id", "period", F.col("actual_ytd_rub").alias("_b"))
    apart = a.join(b, ["region_id", "period"]).filter(F.abs(F.col("_a") - F.col("_b")) > TOLERANCE).select("region_id", "period")
    own = revenue.filter(F.col("revenue_code") == OWN).select("region_id", "period", F.lit("Own-source revenue").alias("measure"), (F.col("actual_ytd_rub") / 1e9).alias("rub_bn"))
    spent = fiscal.filter("metric_code = 'expenditure_total'").select("region_id", "period", F.lit("Expenditure").alias("measure"), (F.col("actual_ytd_rub") / 1e9).alias("rub_bn"))
    return own.unionByName(spent).join(apart, ["region_id", "period"], "left_anti")


def latest_profile(fiscal: DataFrame, revenue: DataFrame) -> DataFrame:
    """One row a region: balance and the five components at its latest period."""
    parts = revenue_components(revenue).groupBy("region_id", "period").agg(*[F.max(F.when(F.col("component_code") == n, F.col("amount_rub"))).alias(n) for n, _ in COMPONENTS])
    ends = balance_endpoints(fiscal).select("region_id", "period", "revenue", "spending", "balance")
    joined = ends.filter("balance IS NOT NULL").join(parts, ["region_id", "period"])
    return joined.withColumn("_last", F.max("period").over(Window.partitionBy("region_id"))).filter("period = _last").drop("_last")
