"""Claims: one row for each computed statement, with its value or the reason why there is none, how it was computed,
and from which published rows.

Evidence travels with the numbers: a source is a struct of a row's period and lineage, a value carries the array of sources that
stand behind it, aggregates and calendar windows move both together, and a derived value has those of its operands. So a
prior end that no row has leaves no evidence of it, and nothing is looked up or inferred from dates afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import FIELDS
from ..functions.numbers import share
from ..operators.joins import calendar_join
from ..operators.windows import last_n
from .fiscal import COMPONENTS, KEYS, balance_endpoints, fiscal_growth, observations, revenue_components, spending_functions, transfer_share, transfers
from .panels import FUNCTIONS, TOTAL, TRANSFERS

CLAIM = ["region_id", "period", "amount_basis", "claim_code", "value", "unit", "availability", "formula", "evidence"]
CONTEXT = [k for k in KEYS if k not in ("region_id", "period")]
#: Reasons for a missing value.
MISSING, BEFORE, NOT_DERIVABLE = "endpoint_unavailable", "comparison_unavailable", "not_derivable_from_cumulative_index"
#: Claim, unit, reason where it is missing, formula, and whether it compares with the year before.
STATEMENTS = {
    "budget_balance": ("RUB", MISSING, "balance", False),
    "budget_balance_change": ("RUB", BEFORE, "balance - prior balance", True),
    "transfer_share": ("%", MISSING, "transfers / total revenue * 100", False),
    "transfer_share_change": ("pp", BEFORE, "transfer share - prior transfer share", True),
    "own_source_growth": ("%", BEFORE, "(own revenue - prior own revenue) / prior own revenue * 100", True),
    "retained_pit_change": ("RUB", BEFORE, "retained PIT - prior retained PIT", True),
    "retained_pit_contribution": ("pp", BEFORE, "(retained PIT - prior retained PIT) / prior total revenue * 100", True),
    "cit_change": ("RUB", BEFORE, "CIT - prior CIT", True),
    "cit_contribution": ("pp", BEFORE, "(CIT - prior CIT) / prior total revenue * 100", True),
    "social_policy_share": ("%", MISSING, "social policy spending / total spending * 100", False),
    "production_growth": ("%", MISSING, "January-to-month index - 100", True),
    "price_growth": ("%", BEFORE, "(price - prior price) / prior price * 100", True),
}


def evidence(period: Column, prior: Column | None = None) -> Column:
    """The periods whose rows a claim rests on, as JSON; a prior row that is not there stays out."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return F.to_json(F.struct(day(period).alias("period"), *([] if prior is None else [day(prior).alias("prior_period")])))


def _stated(df: DataFrame, basis: Column, values: dict[str, Column], reasons: dict[str, str] | None = None) -> DataFrame:
    """One row a row of df and claim, from a single pass over df, whose prior_period is that of its row of the year before."""
    rows = []
    for code, value in values.items():
        unit, why, formula, compares = STATEMENTS[code]
        known = F.when(value.isNull(), F.lit((reasons or {}).get(code, why))).otherwise("available")
        said = evidence(F.col("period"), F.col("prior_period") if compares else None)
        fields = {"claim_code": F.lit(code), "value": value, "unit": F.lit(unit), "availability": known, "formula": F.lit(formula), "evidence": said}
        rows.append(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return df.select("region_id", "period", basis.alias("amount_basis"), F.explode(F.array(*rows)).alias("c")).select("region_id", "period", "amount_basis", "c.*")


def _dated(df: DataFrame, *keys: str, snap: str | None = None) -> DataFrame:
    """df with the period of each row's row of the year before, if there is one."""
    return calendar_join(df, ["region_id", *keys], [], "prior_", snap=snap, keep_period=True)


def claims(fiscal: DataFrame, revenue: DataFrame, cumulative: DataFrame, history: DataFrame, basis: str = "YTD") -> DataFrame:
    """Balance, revenue, spending, transfers, components, functions, production and prices as long rows for all regions and periods."""
    own = F.col("amount_basis")
    out = [
        _stated(_dated(balance_endpoints(fiscal, basis), *CONTEXT), own, {"budget_balance": F.col("balance"), "budget_balance_change": F.col("balance") - F.col("prior_balance")}),
        _stated(_dated(transfers(revenue, basis), *CONTEXT), own, {"transfer_share": F.col("transfer_share_pct"), "transfer_share_change": F.col("transfer_share_change_pp"), "own_source_growth": F.col("own_source_growth_yoy_pct")}),
    ]
    part = revenue_components(revenue, basis).filter(F.col("component_code").isin("retained_pit", "cit"))
    of = lambda n, v: F.max(F.when(F.col("component_code") == n, F.col(v)))
    wide = part.groupBy("region_id", "period", "amount_basis", "window").agg(*[of(n, v).alias(f"{n}_{k}") for n in ("retained_pit", "cit") for k, v in (("change", "change_yoy_rub"), ("contribution", "contribution_pp"))])
    out.append(_stated(_dated(wide, "amount_basis", "window"), own, {c: F.col(c) for c in ("retained_pit_change", "retained_pit_contribution", "cit_change", "cit_contribution")}))
    out.append(_stated(spending_functions(fiscal, basis).filter("metric_code = '1000'"), own, {"social_policy_share": F.col("share_pct")}))
    made = _dated(cumulative.filter("section = 'TOTAL'"), snap="month_end")
    if basis == "YTD":
        out.append(_stated(made, F.lit(basis), {"production_growth": F.col("growth_yoy_pct")}))
    else:  # never derived from cumulative indices
        out.append(_stated(made, F.lit(basis), {"production_growth": F.lit(None).cast("double")}, {"production_growth": NOT_DERIVABLE}))
    price = history.filter("fuel_grade = '2-HIGH'").select("region_id", F.last_day("period").alias("period"), F.last_day("previous_year_period").alias("prior_period"), "yoy_change_pct")
    out.append(_stated(price, F.lit(basis), {"price_growth": F.col("yoy_change_pct")}))
    return reduce(DataFrame.unionByName, out).select(*CLAIM)


#: Lineage of a published row; fields that a table lacks are null.
SOURCE = ("period", *FIELDS)
STATEMENT = ["region_id", "period", "amount_basis", "window", "claim_code", "value", "unit", "formula", "availability", "reason", "current", "prior"]
NO_WINDOW, NO_CHANGE = "current window or flow endpoint unavailable", "current or prior-year matching window unavailable"
NO_INDEX, NO_OUTPUT_FLOW = "no published January-to-month observation", "a standalone quarter is not derivable from cumulative indices"
NO_PRICE, NO_PRICE_CHANGE = "no price at the window's end", "no price at the window's end or in the same month a year earlier"


def _source(df: DataFrame) -> Column:
    return F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast("date" if c == "period" else "string").alias(c) for c in SOURCE])


_SOURCE_TYPE = "array<struct<period: date, " + ", ".join(f"{c}: string" for c in FIELDS) + ">>"


def _amounts(df: DataFrame, basis: str) -> DataFrame:
    """Amounts of every window with the rows behind them: one to date, both endpoints of a flow."""
    work = observations(df, basis)
    own = F.array(_source(df))
    if basis == "period_flow":
        start = F.from_json("evidence", "start struct<period: date, " + ", ".join(f"{c}: string" for c in FIELDS) + ">")["start"]
        own = F.array_compact(F.array(_source(df), F.when(F.col("window") == "Q2", start)))
    return work.withColumn("sources", F.when(F.col("amount_rub").isNotNull(), own))


def _pivoted(work: DataFrame, column: str, codes: dict[str, str]) -> DataFrame:
    """Codes side by side, each with its sources, and those of exactly the year before."""
    of = lambda code, c: F.first(F.when(F.col(column) == code, F.col(c)), ignorenulls=True)
    names = {f"{n}{end}": of(code, c) for n, code in codes.items() for end, c in (("", "amount_rub"), ("_from", "sources"))}
    wide = work.groupBy(*KEYS).agg(*[c.alias(n) for n, c in names.items()])
    return calendar_join(wide, ["region_id", *CONTEXT], list(names), "prior_")


def _joined(*sources: Column) -> Column:
    """The distinct sources of several values."""
    none = F.array().cast(_SOURCE_TYPE)
    return F.array_distinct(F.concat(*[F.coalesce(x, none) for x in sources])) if sources else none


def _say(code: str | Column, value: Column, unit: str, formula: str, reason: str | Column, current: Column, prior: Column | None = None) -> Column:
    why = F.lit(reason) if isinstance(reason, str) else reason
    known = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    fields = {
        "claim_code": F.lit(code) if isinstance(code, str) else code, "value": F.when(known, value), "unit": F.lit(unit), "formula": F.lit(formula), "availability": F.when(known, "available").otherwise("unavailable"),
        "reason": F.when(~F.coalesce(known, F.lit(False)), why), "current": current, "prior": _joined() if prior is None else prior,
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _rows(df: DataFrame, said: list[Column] | Column) -> DataFrame:
    listed = F.array(*said) if isinstance(said, list) else said
    return df.select("region_id", "period", "amount_basis", "window", F.explode(listed).alias("c")).select("region_id", "period", "amount_basis", "window", "c.*")


def _movers(fiscal_amounts: DataFrame) -> DataFrame:
    """The functions with the largest increase and the largest decrease, where all of them have both ends."""
    wide = _pivoted(fiscal_amounts.filter("kind = 'expenditure_function'"), "metric_code", {f"f{c}": c for c in FUNCTIONS})
    each = F.array(*[F.struct((F.col(f"f{c}") - F.col(f"prior_f{c}")).alias("change"), F.lit(c).alias("code"), _joined(F.col(f"f{c}_from")).alias("now"), _joined(F.col(f"prior_f{c}_from")).alias("then")) for c in FUNCTIONS])
    wide = wide.select(*KEYS, each.alias("_each")).filter(F.forall("_each", lambda m: m["change"].isNotNull()))
    # Ties go to the greatest code among increases and to the least among decreases.
    order = lambda m: F.struct(m["change"].alias("change"), m["code"].alias("code"), m["now"].alias("now"), m["then"].alias("then"))
    up, down = (F.array_max(F.transform(F.filter("_each", lambda m: m["change"] > 0), order)), F.array_min(F.transform(F.filter("_each", lambda m: m["change"] < 0), order)))
    say = lambda m: F.when(m.isNotNull(), _say(F.concat(F.lit("spending_"), m["code"]), m["change"], "RUB", "spending function less the same window a year before", NO_CHANGE, m["now"], m["then"]))
    return _rows(wide, F.array_compact(F.array(say(up), say(down))))


def statements(fiscal: DataFrame, revenue: DataFrame, cumulative: DataFrame, history: DataFrame, basis: str = "YTD", grades: tuple[str, ...] = ()) -> DataFrame:
    """Every statement about a region and a first or second quarter's end, available or not, with the published rows behind both ends.

    Columns of FIELDS that the inputs have are their lineage. history: prices by month start, `previous_year_` columns included (price_history
    with the lineage columns carried along). current and prior are arrays of sources, empty where there is no such row."""
    fiscal_amounts, revenue_amounts = _amounts(fiscal, basis), _amounts(revenue, basis)
    supported = "window IN ('Q1', 'H1', 'Q2')"
    totals = _pivoted(fiscal_amounts.filter("kind = 'summary'"), "metric_code", {c: c for c in ("revenue_total", "expenditure_total", "budget_balance")}).filter(supported)
    said = []
    for c in ("revenue_total", "expenditure_total", "budget_balance"):
        now, then = _joined(F.col(f"{c}_from")), _joined(F.col(f"prior_{c}_from"))
        said.append(_say(c, F.col(c), "RUB", "selected window's actual", NO_WINDOW, now))
        said.append(_say(f"{c}_change", F.col(c) - F.col(f"prior_{c}"), "RUB", "current less the same window a year before", NO_CHANGE, now, then))
    out = [_rows(totals, said), _movers(fiscal_amounts.filter(supported))]

    codes = sorted({c for _, parts in COMPONENTS for _, c in parts} | {TOTAL})
    wide = _pivoted(revenue_amounts, "revenue_code", {f"c{c}": c for c in codes}).filter(supported)
    of = lambda end, parts: reduce(lambda a, b: a + b, [sign * F.col(f"{end}c{c}") for sign, c in parts])
    behind = lambda end, *names: _joined(*[F.col(f"{end}c{c}_from") for c in names])
    said = [_say(f"component_{n}", of("", parts) - of("prior_", parts), "RUB", "revenue component less the same window a year before", NO_CHANGE, behind("", *[c for _, c in parts]), behind("prior_", *[c for _, c in parts])) for n, parts in COMPONENTS]
    now, then = share(f"c{TRANSFERS}", f"c{TOTAL}"), share(f"prior_c{TRANSFERS}", f"prior_c{TOTAL}")
    ends = behind("", TRANSFERS, TOTAL), behind("prior_", TRANSFERS, TOTAL)
    said += [_say("transfer_share", now, "%", "transfers / total revenue * 100", NO_WINDOW, ends[0]), _say("transfer_share_change", now - then, "pp", "transfer share less that of the same window a year before", NO_CHANGE, *ends)]
    out.append(_rows(wide, said))

    # Production and prices are stated for each context that the budget has, whether they are there or not.
    contexts = totals.select("region_id", "period", "amount_basis", "window")
    made = cumulative.filter(F.col("section").isin("TOTAL", "C")).groupBy("region_id", "period").agg(
        *[F.first(F.when(F.col("section") == n, c), ignorenulls=True).alias(f"{k}_{n}") for n in ("TOTAL", "C") for k, c in (("growth", F.col("index_value") - 100), ("from", F.array(_source(cumulative))))]
    )
    apart = F.col("window") == "Q2"
    said = [_say(f"production_{n}", F.when(~apart, F.col(f"growth_{n}")), "%", "January-to-month index less 100", F.when(apart, NO_OUTPUT_FLOW).otherwise(NO_INDEX), F.when(apart, _joined()).otherwise(_joined(F.col(f"from_{n}")))) for n in ("TOTAL", "C")]
    out.append(_rows(contexts.join(made, ["region_id", "period"], "left"), said))
    if grades:
        before = history.select(*[F.col(f"previous_year_{c}").alias(c) for c in SOURCE if f"previous_year_{c}" in history.columns])
        old = F.when(F.col("previous_year_period").isNotNull(), F.array(F.struct(*[(F.col(f"previous_year_{c}") if c in before.columns else F.lit(None)).cast("date" if c == "period" else "string").alias(c) for c in SOURCE])))
        wanted = {"price": F.col("price"), "change": F.col("yoy_change_pct"), "from": F.array(_source(history)), "then": old}
        priced = history.filter(F.col("fuel_grade").isin(*grades)).groupBy("region_id", F.last_day("period").alias("period")).agg(
            *[F.first(F.when(F.col("fuel_grade") == g, c), ignorenulls=True).alias(f"{k}_{i}") for i, g in enumerate(grades) for k, c in wanted.items()]
        )
        said = []
        for i, g in enumerate(grades):
            now, then = _joined(F.col(f"from_{i}")), _joined(F.col(f"then_{i}"))
            said += [_say(f"fuel_{g}_price", F.col(f"price_{i}"), "RUB/litre", "price at the window's end", NO_PRICE, now), _say(f"fuel_{g}_yoy", F.col(f"change_{i}"), "%", "(price - prior price) / prior price * 100", NO_PRICE_CHANGE, now, then)]
        out.append(_rows(contexts.join(priced, ["region_id", "period"], "left"), said))
    return reduce(DataFrame.unionByName, out).select(*STATEMENT)


def claim_coverage(rows: DataFrame) -> DataFrame:
    """Per claim: how many contexts have a value and how many do not."""
    return rows.groupBy("claim_code").agg(F.count_if(F.col("availability") == "available").alias("n_available"), F.count_if(F.col("availability") != "available").alias("n_withheld"))


def largest_movers(fiscal: DataFrame, basis: str = "YTD") -> DataFrame:
    """Function with the largest increase and decrease in every region and period."""
    from ..operators.order import extreme_movers

    return extreme_movers(spending_functions(fiscal, basis), ["region_id", "period"], "change_yoy_rub", "metric_code")


def profile_facts(headline: DataFrame, revenue: DataFrame, fiscal: DataFrame) -> DataFrame:
    """Numbers behind a profile: production's last three months, revenue against spending, and the shift of the transfer share."""
    recent = last_n(headline, ["region_id"], 3)
    months = recent.groupBy("region_id").agg(F.count("growth_yoy_pct").alias("n"), F.count_if(F.col("growth_yoy_pct") < 0).alias("n_below"))
    from .fiscal import revenue_indicators
    from .panels import OWN

    keys = ["region_id", "period"]
    own = revenue_indicators(revenue).filter(F.col("revenue_code") == OWN).select(*keys, F.col("growth_yoy_pct").alias("own_growth_pct"))
    spent = fiscal_growth(fiscal).filter("metric_code = 'expenditure_total'").select(*keys, F.col("growth_yoy_pct").alias("spending_growth_pct"))
    now = transfer_share(revenue)
    then = now.select("region_id", F.add_months("period", 12).alias("period"), F.col("transfer_share_pct").alias("before"))
    shift = now.join(then, keys).select(*keys, (F.col("transfer_share_pct") - F.col("before")).alias("transfer_share_shift_pp"))
    out = own.join(spent, keys).join(shift, keys, "left").join(months.filter("n = 3").select("region_id", "n_below"), "region_id", "left")
    return out.select(*keys, "own_growth_pct", "spending_growth_pct", "transfer_share_shift_pp", F.col("n_below").alias("production_months_below"))
