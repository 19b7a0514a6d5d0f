"""Queries L01 to L36: the composites over all regions and periods."""

from __future__ import annotations

from ..operators import windows
from ..plans import claims, fiscal, overview, prices, production
from .base import F, Registry, once, p, q_monthly, q_receipts, table

QUERIES = Registry()

#: SQL of amounts on both bases, for fiscal and revenue rows.
_WINDOW = "CASE WHEN period = last_day(period) AND month(period) = 3 THEN 'Q1' WHEN period = last_day(period) AND month(period) = 6 THEN '{half}' ELSE 'unsupported' END"
_F = f", o AS (SELECT region_id, period, kind, metric_code, actual_ytd_rub AS v, {_WINDOW.format(half='H1')} AS win FROM fiscal)"
_R = f", o AS (SELECT region_id, period, revenue_code, actual_ytd_rub AS v, {_WINDOW.format(half='H1')} AS win FROM revenue)"
_FLOW = """
, q AS (SELECT a.region_id, a.period, a.{code}, a.actual_ytd_rub AS ytd, b.actual_ytd_rub AS start FROM {t} a LEFT JOIN {t} b ON a.region_id = b.region_id AND a.{code} = b.{code} AND month(b.period) = 3 AND a.period = CAST(last_day(b.period + INTERVAL 3 MONTH) AS DATE)),
o AS (SELECT region_id, period, {code}, CASE month(period) WHEN 3 THEN ytd WHEN 6 THEN ytd - start END AS v, CASE month(period) WHEN 3 THEN 'Q1' WHEN 6 THEN 'Q2' ELSE 'unsupported' END AS win FROM q)"""
_NEXT = "CAST({p}.period + INTERVAL 12 MONTH AS DATE)"
_W = """
, w AS (SELECT region_id, period, win, max(CASE WHEN revenue_code = 'TOTAL_REVENUE' THEN v END) AS t, max(CASE WHEN revenue_code = '100' THEN v END) AS own, max(CASE WHEN revenue_code = '101_PIT' THEN v END) AS pit,
  max(CASE WHEN revenue_code = '101_CIT' THEN v END) AS cit, max(CASE WHEN revenue_code = '200' THEN v END) AS oth, max(CASE WHEN revenue_code = '202' THEN v END) AS tr FROM o GROUP BY ALL)"""
_COMPONENTS = _W + """
, c AS (SELECT region_id, period, win, t, unnest(['retained_pit', 'cit', 'other_own', 'transfers', 'other_non_repayable']) AS component_code, unnest([pit, cit, own - pit - cit, tr, oth - tr]) AS x FROM w),
k AS (SELECT region_id, period, win, t, component_code, CASE WHEN win <> 'unsupported' THEN x END AS x FROM c),
j AS (SELECT a.*, b.x AS px, b.t AS pt FROM k a LEFT JOIN k b ON a.region_id = b.region_id AND a.win = b.win AND a.component_code = b.component_code AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE))"""
_ENDS = """
, e AS (SELECT region_id, period, win, max(CASE WHEN metric_code = 'revenue_total' THEN v END) AS r, max(CASE WHEN metric_code = 'expenditure_total' THEN v END) AS s, max(CASE WHEN metric_code = 'budget_balance' THEN v END) AS b FROM o WHERE metric_code IN ('revenue_total', 'expenditure_total', 'budget_balance') GROUP BY ALL),
n AS (SELECT a.*, p.r AS pr, p.s AS ps, p.b AS pb, CASE WHEN p.r IS NULL OR p.s IS NULL OR p.b IS NULL OR a.win = 'unsupported' THEN 'prior-year same-window actuals are unavailable' WHEN abs(p.r - p.s - p.b) > 0.02 THEN 'prior-year balance is not revenue minus spending'
  WHEN a.r IS NULL OR a.s IS NULL OR a.b IS NULL THEN 'current same-window actuals are unavailable' WHEN abs(a.r - a.s - a.b) > 0.02 THEN 'current balance is not revenue minus spending' END AS reason
  FROM e a LEFT JOIN e p ON a.region_id = p.region_id AND a.win = p.win AND a.period = CAST(p.period + INTERVAL 12 MONTH AS DATE))"""


def _named(df):
    return df.withColumnRenamed("window", "win") if "window" in df.columns else df


@QUERIES.add("l01_fiscal_flows", """
SELECT a.region_id, a.period, a.kind, a.metric_code, CASE month(a.period) WHEN 3 THEN a.actual_ytd_rub WHEN 6 THEN a.actual_ytd_rub - b.actual_ytd_rub END AS quarter_flow_rub,
  CASE WHEN month(a.period) = 3 THEN 'Q1 equals YTD' WHEN month(a.period) = 6 AND b.actual_ytd_rub IS NOT NULL THEN 'H1 minus Q1 YTD' WHEN month(a.period) = 6 THEN 'missing endpoint' ELSE 'unsupported snapshot' END AS flow_status,
  '{"end":{"period":"' || CAST(a.period AS VARCHAR) || '"}' || CASE WHEN b.period IS NOT NULL THEN ',"start":{"period":"' || CAST(b.period AS VARCHAR) || '"}' ELSE '' END || '}' AS evidence
FROM fiscal a LEFT JOIN fiscal b ON a.region_id = b.region_id AND a.kind = b.kind AND a.metric_code = b.metric_code AND month(b.period) = 3 AND a.period = CAST(last_day(b.period + INTERVAL 3 MONTH) AS DATE)""", "fiscal")
def l01(s, d):
    return fiscal.flows(p.fiscal(s, d)).select("region_id", "period", "kind", "metric_code", "quarter_flow_rub", "flow_status", "evidence")


@QUERIES.add("l02_observations", _F + "SELECT region_id, period, kind, metric_code, win, 'YTD' AS amount_basis, v AS amount_rub FROM o", "fiscal")
def l02(s, d):
    return _named(fiscal.observations(p.fiscal(s, d), "YTD")).select("region_id", "period", "kind", "metric_code", "win", "amount_basis", "amount_rub")


@QUERIES.add("l03_validated_input", "SELECT region_id, period, kind, metric_code, actual_ytd_rub FROM fiscal", "fiscal")
def l03(s, d):
    return fiscal.validated(p.fiscal(s, d)).select("region_id", "period", "kind", "metric_code", "actual_ytd_rub")


def _spending_sql(flow: bool) -> str:
    start = _FLOW.format(t="fiscal", code="metric_code") if flow else _F
    return start + f"""
, g AS (SELECT DISTINCT region_id, period, win, unnest([{", ".join(f"'{c}'" for c in p.FUNCTIONS)}]) AS metric_code FROM o), t AS (SELECT region_id, period, win, v AS t FROM o WHERE metric_code = 'expenditure_total'),
x AS (SELECT g.*, o.v, t.t, CASE WHEN t.t > 0 THEN o.v / t.t * 100 END AS share FROM g LEFT JOIN o USING (region_id, period, win, metric_code) LEFT JOIN t USING (region_id, period, win)),
y AS (SELECT a.*, b.v AS pv, b.t AS pt, b.share AS pshare FROM x a LEFT JOIN x b ON a.region_id = b.region_id AND a.win = b.win AND a.metric_code = b.metric_code AND a.period = {_NEXT.format(p="b")})
SELECT region_id, period, win, metric_code, v AS amount_rub, t AS total_spending_rub, share AS share_pct, v - pv AS change_yoy_rub, CASE WHEN pv > 0 THEN (v - pv) / pv * 100 END AS growth_yoy_pct, share - pshare AS share_change_pp,
  CASE WHEN pt > 0 THEN (v - pv) / pt * 100 END AS contribution_pp, count(v) OVER k = 14 AS functions_complete, count(v) OVER k = 14 AND count(pv) OVER k = 14 AND t IS NOT NULL AND pt IS NOT NULL AS comparison_complete
FROM y WINDOW k AS (PARTITION BY region_id, period, win)"""


_SPENDING = ["region_id", "period", "win", "metric_code", "amount_rub", "total_spending_rub", "share_pct", "change_yoy_rub", "growth_yoy_pct", "share_change_pp", "contribution_pp", "functions_complete", "comparison_complete"]


@QUERIES.add("l04_spending_functions", _spending_sql(False), "fiscal")
def l04(s, d):
    return _named(fiscal.spending_functions(p.fiscal(s, d))).select(*_SPENDING)


@QUERIES.add("l04_spending_functions_flow", _spending_sql(True), "fiscal")
def l04_flow(s, d):
    return _named(fiscal.spending_functions(p.fiscal(s, d), "period_flow")).select(*_SPENDING)


def _bridge_sql(flow: bool) -> str:
    start = _FLOW.format(t="fiscal", code="metric_code") if flow else _F
    return start + _ENDS + """
SELECT region_id, period, win, unnest([0, 1, 2, 3]) AS step, unnest(['Prior balance', 'Revenue change', 'Expenditure change', 'Current balance']) AS label, unnest([pb, r - pr, -(s - ps), b]) AS value_rub,
  unnest([0.0::DOUBLE, pb, pb + (r - pr), 0.0::DOUBLE]) AS from_rub, unnest([pb, pb + (r - pr), b, b]) AS to_rub FROM n WHERE reason IS NULL"""


@QUERIES.add("l05_balance_bridge", _bridge_sql(False), "fiscal")
def l05(s, d):
    return _named(fiscal.balance_bridge(p.fiscal(s, d))).select("region_id", "period", "win", "step", "label", "value_rub", "from_rub", "to_rub")


@QUERIES.add("l05_balance_bridge_flow", _bridge_sql(True), "fiscal")
def l05_flow(s, d):
    return _named(fiscal.balance_bridge(p.fiscal(s, d), "period_flow")).select("region_id", "period", "win", "step", "label", "value_rub", "from_rub", "to_rub")


@QUERIES.add("l06_bridge_register", _F + _ENDS + "SELECT region_id, period, 'YTD' AS amount_basis, win, coalesce(reason, 'available') AS availability FROM n", "fiscal")
def l06(s, d):
    return _named(fiscal.bridge_register(p.fiscal(s, d)))


def _components_sql(flow: bool) -> str:
    start = _FLOW.format(t="revenue", code="revenue_code") if flow else _R
    return start + _COMPONENTS + """
SELECT region_id, period, win, component_code, x AS amount_rub, CASE WHEN x IS NOT NULL THEN 'available' ELSE 'unavailable' END AS availability, x - px AS change_yoy_rub, CASE WHEN px > 0 THEN (x - px) / px * 100 END AS growth_yoy_pct, CASE WHEN t > 0 THEN x / t * 100 END AS share_pct,
  CASE WHEN pt > 0 THEN (x - px) / pt * 100 END AS contribution_pp, coalesce(x < 0, false) AS negative_amount_flag, count(x - px) OVER (PARTITION BY region_id, period, win) = 5 AS comparison_complete FROM j"""


_PARTS = ["region_id", "period", "win", "component_code", "amount_rub", "availability", "change_yoy_rub", "growth_yoy_pct", "share_pct", "contribution_pp", "negative_amount_flag", "comparison_complete"]


@QUERIES.add("l07_revenue_components", _components_sql(False), "revenue")
def l07(s, d):
    return _named(fiscal.revenue_components(p.revenue(s, d))).select(*_PARTS)


@QUERIES.add("l07_revenue_components_flow", _components_sql(True), "revenue")
def l07_flow(s, d):
    return _named(fiscal.revenue_components(p.revenue(s, d), "period_flow")).select(*_PARTS)


@QUERIES.add("l08_detailed_bridge", _F + _ENDS + _COMPONENTS.replace("FROM o GROUP", "FROM oo GROUP").replace(", w AS", _R.replace(", o AS", ", oo AS") + ", w AS", 1) + """
, d AS (SELECT region_id, period, win, max(t) AS t, max(pt) AS pt, max(CASE component_code WHEN 'retained_pit' THEN x - px END) AS c1, max(CASE component_code WHEN 'cit' THEN x - px END) AS c2, max(CASE component_code WHEN 'other_own' THEN x - px END) AS c3,
  max(CASE component_code WHEN 'transfers' THEN x - px END) AS c4, max(CASE component_code WHEN 'other_non_repayable' THEN x - px END) AS c5 FROM j GROUP BY ALL HAVING count(x - px) = 5)
SELECT region_id, period, win, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS step, unnest(['prior_balance', 'retained_pit', 'cit', 'other_own', 'transfers', 'other_non_repayable', 'expenditure', 'current_balance']) AS label, unnest([pb, c1, c2, c3, c4, c5, -(s - ps), b]) AS value_rub,
  unnest([0.0::DOUBLE, pb, pb + c1, pb + c1 + c2, pb + c1 + c2 + c3, pb + c1 + c2 + c3 + c4, pb + c1 + c2 + c3 + c4 + c5, 0.0::DOUBLE]) AS from_rub,
  unnest([pb, pb + c1, pb + c1 + c2, pb + c1 + c2 + c3, pb + c1 + c2 + c3 + c4, pb + c1 + c2 + c3 + c4 + c5, pb + c1 + c2 + c3 + c4 + c5 - (s - ps), b]) AS to_rub
FROM n JOIN d USING (region_id, period, win) WHERE reason IS NULL AND abs(n.r - d.t) <= 0.02 AND abs(n.pr - d.pt) <= 0.02""", "fiscal")
def l08(s, d):
    return _named(fiscal.detailed_bridge(p.fiscal(s, d), p.revenue(s, d))).select("region_id", "period", "win", "step", "label", "value_rub", "from_rub", "to_rub")


@QUERIES.add("l09_transfers", _R + _W + """
, x AS (SELECT region_id, period, win, t, tr, own, CASE WHEN t > 0 THEN tr / t * 100 END AS sh FROM w)
SELECT a.region_id, a.period, a.win, a.t AS total_revenue_rub, a.tr AS transfers_rub, a.own AS own_source_rub, a.sh AS transfer_share_pct, a.sh - b.sh AS transfer_share_change_pp, a.tr - b.tr AS transfers_change_yoy_rub, CASE WHEN b.tr > 0 THEN (a.tr - b.tr) / b.tr * 100 END AS transfers_growth_yoy_pct,
  CASE WHEN b.own > 0 THEN (a.own - b.own) / b.own * 100 END AS own_source_growth_yoy_pct FROM x a LEFT JOIN x b ON a.region_id = b.region_id AND a.win = b.win AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE)""", "revenue")
def l09(s, d):
    return _named(fiscal.transfers(p.revenue(s, d))).select("region_id", "period", "win", "total_revenue_rub", "transfers_rub", "own_source_rub", "transfer_share_pct", "transfer_share_change_pp", "transfers_change_yoy_rub", "transfers_growth_yoy_pct", "own_source_growth_yoy_pct")


_INDICATORS = """
SELECT a.region_id, a.period, a.revenue_code, a.actual_ytd_rub - b.actual_ytd_rub AS change_yoy_rub, CASE WHEN b.actual_ytd_rub > 0 THEN (a.actual_ytd_rub / b.actual_ytd_rub - 1) * 100 END AS growth_yoy_pct, CASE WHEN month(a.period) = 3 THEN a.actual_ytd_rub ELSE a.actual_ytd_rub - c.actual_ytd_rub END AS quarter_flow_rub,
  CASE WHEN month(a.period) = 3 THEN 'Q1 equals YTD' WHEN c.actual_ytd_rub IS NOT NULL THEN 'adjacent YTD difference' ELSE 'missing adjacent snapshot' END AS flow_status, CASE WHEN a.plan_components_reconciled AND a.approved_plan_rub > 0 THEN a.actual_ytd_rub / a.approved_plan_rub * 100 END AS snapshot_execution_pct
FROM {t} a LEFT JOIN {t} b ON a.region_id = b.region_id AND a.revenue_code = b.revenue_code AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE) LEFT JOIN {t} c ON a.region_id = c.region_id AND a.revenue_code = c.revenue_code AND a.period = CAST(last_day(c.period + INTERVAL 3 MONTH) AS DATE)"""
_IND = ["region_id", "period", "revenue_code", "change_yoy_rub", "growth_yoy_pct", "quarter_flow_rub", "flow_status", "snapshot_execution_pct"]


@QUERIES.add("l10_revenue_indicators", _INDICATORS.format(t="revenue"), "revenue")
def l10(s, d):
    return fiscal.revenue_indicators(p.revenue(s, d)).select(*_IND)


@QUERIES.add("l11_social_spending", """
, g AS (SELECT DISTINCT region_id, period, unnest(['1000', '0700', '0900']) AS metric_code FROM fiscal), t AS (SELECT region_id, period, actual_ytd_rub AS t FROM fiscal WHERE metric_code = 'expenditure_total'),
x AS (SELECT region_id, period, metric_code, actual_ytd_rub AS v, CASE WHEN t > 0 THEN actual_ytd_rub / t * 100 END AS sh FROM g LEFT JOIN (SELECT * FROM fiscal WHERE kind = 'expenditure_function') USING (region_id, period, metric_code) LEFT JOIN t USING (region_id, period))
SELECT a.region_id, a.period, a.metric_code, a.v AS actual_ytd_rub, a.sh AS share_pct, CASE WHEN b.v > 0 THEN (a.v / b.v - 1) * 100 END AS growth_yoy_pct, a.sh - b.sh AS share_change_pp, CASE WHEN a.v IS NOT NULL THEN 'reported' ELSE 'unavailable' END AS availability
FROM x a LEFT JOIN x b ON a.region_id = b.region_id AND a.metric_code = b.metric_code AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE)""", "fiscal")
def l11(s, d):
    return fiscal.social_spending(p.fiscal(s, d)).select("region_id", "period", "metric_code", "actual_ytd_rub", "share_pct", "growth_yoy_pct", "share_change_pp", "availability")


@QUERIES.add("l12_fiscal_growth", "SELECT a.region_id, a.period, a.kind, a.metric_code, CASE WHEN b.actual_ytd_rub > 0 THEN (a.actual_ytd_rub / b.actual_ytd_rub - 1) * 100 END AS growth_yoy_pct FROM fiscal a LEFT JOIN fiscal b ON a.region_id = b.region_id AND a.kind = b.kind AND a.metric_code = b.metric_code AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE)", "fiscal")
def l12(s, d):
    return fiscal.fiscal_growth(p.fiscal(s, d)).select("region_id", "period", "kind", "metric_code", "growth_yoy_pct")


@QUERIES.add("l13_budget_history", ", r AS (SELECT * FROM revenue WHERE revenue_code IN ('TOTAL_REVENUE', '100'))" + _INDICATORS.format(t="r"), "revenue")
def l13(s, d):
    concept = F.when(F.col("revenue_code") == p.TOTAL, "Total revenue").when(F.col("revenue_code") == p.OWN, "Own-source revenue")
    return fiscal.budget_history(p.revenue(s, d).withColumn("concept", concept), {"Total revenue": p.TOTAL, "Own-source revenue": p.OWN}).select(*_IND)


@QUERIES.add("l14_own_and_spending", """
SELECT region_id, period, 'Own-source revenue' AS measure, actual_ytd_rub / 1e9 AS rub_bn FROM revenue WHERE revenue_code = '100' UNION ALL SELECT region_id, period, 'Expenditure', actual_ytd_rub / 1e9 FROM fiscal WHERE metric_code = 'expenditure_total'""", "fiscal")
def l14(s, d):
    return fiscal.own_and_spending(p.revenue(s, d), p.fiscal(s, d))


@QUERIES.add("l15_transfer_share", "SELECT a.region_id, a.period, b.actual_ytd_rub / a.actual_ytd_rub * 100 AS transfer_share_pct FROM revenue a JOIN revenue b USING (region_id, period) WHERE a.revenue_code = 'TOTAL_REVENUE' AND b.revenue_code = '202' AND a.actual_ytd_rub > 0", "revenue")
def l15(s, d):
    return fiscal.transfer_share(p.revenue(s, d))


@QUERIES.add("l16_headline_history", """
, b AS (SELECT region_id, CAST(date_trunc('month', min(period)) AS DATE) AS a, max(CASE WHEN growth_yoy_pct IS NOT NULL THEN period END) AS z FROM production WHERE section = 'TOTAL' GROUP BY ALL), c AS (SELECT region_id, CAST(last_day(m) AS DATE) AS period FROM (SELECT region_id, unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS m FROM b)),
j AS (SELECT region_id, period, index_value, growth_yoy_pct FROM c LEFT JOIN (SELECT * FROM production WHERE section = 'TOTAL') USING (region_id, period)),
k AS (SELECT *, CAST((growth_yoy_pct IS NOT NULL) <> coalesce(lag(growth_yoy_pct IS NOT NULL) OVER (PARTITION BY region_id ORDER BY period), false) AS INT) AS x FROM j)
SELECT region_id, period, index_value, growth_yoy_pct, CAST(sum(x) OVER (PARTITION BY region_id ORDER BY period) AS BIGINT) AS segment FROM k""", "production")
def l16(s, d):
    return production.headline_history(p.production(s, d))


_SECTIONED = "SELECT region_id, CASE section WHEN 'AUTOMOBILE' THEN 'B' WHEN 'BUILDING' THEN 'C' WHEN 'FURNITURE' THEN 'D' WHEN 'HOUSEHOLD' THEN 'E' ELSE 'X' END AS section, period, flow, ytd FROM receipts"


@QUERIES.add("l17_matched_receipts", f"""
, r AS ({_SECTIONED}), g AS (SELECT DISTINCT region_id, period, unnest(['B', 'C', 'D', 'E']) AS section FROM r)
SELECT g.region_id, g.period, g.section, n.ytd AS pit_current, b.ytd AS pit_prior, n.ytd - b.ytd AS pit_change, CASE WHEN b.ytd > 0 THEN 100 * (n.ytd - b.ytd) / b.ytd END AS pit_yoy_pct, c.index_value, c.growth_yoy_pct AS production_yoy_pct,
  coalesce(nullif(concat_ws(';', CASE WHEN n.ytd IS NULL THEN 'current_pit_unavailable' END, CASE WHEN b.ytd IS NULL THEN 'prior_pit_unavailable' END, CASE WHEN b.ytd <= 0 THEN 'nonpositive_prior_pit_growth_withheld' END, CASE WHEN c.index_value IS NULL THEN 'production_unavailable' END), ''), 'matched') AS availability
FROM g LEFT JOIN r n USING (region_id, period, section) LEFT JOIN r b ON g.region_id = b.region_id AND g.section = b.section AND g.period = CAST(last_day(b.period + INTERVAL 12 MONTH) AS DATE) LEFT JOIN cumulative c ON g.region_id = c.region_id AND g.section = c.section AND g.period = c.period""", "receipts cumulative")
def l17(s, d):
    out = production.matched_receipts(_sectioned(q_receipts(s, d)), p.production(s, d, True))
    return out.select("region_id", "period", "section", "pit_current", "pit_prior", "pit_change", "pit_yoy_pct", "index_value", "production_yoy_pct", "availability")


def _sectioned(df):
    codes = {"AUTOMOBILE": "B", "BUILDING": "C", "FURNITURE": "D", "HOUSEHOLD": "E"}
    return df.withColumn("section", F.coalesce(*[F.when(F.col("section") == k, v) for k, v in codes.items()], F.lit("X")))


@QUERIES.add("l18_cutoff_snapshot", f"""
, x AS ({_SECTIONED}), m AS (SELECT *, max(period) OVER (PARTITION BY region_id) AS l FROM x), n AS (SELECT * FROM m WHERE period = l),
t AS (SELECT n.region_id, n.period, n.section, n.flow AS pit_current, n.flow - b.flow AS pit_change, CASE WHEN b.flow > 0 THEN (n.flow / b.flow - 1) * 100 END AS pit_yoy_pct FROM n LEFT JOIN x b ON n.region_id = b.region_id AND n.section = b.section AND n.period = CAST(b.period + INTERVAL 12 MONTH AS DATE) WHERE n.section <> 'X'),
i AS (SELECT region_id, period, section, index_value FROM cumulative WHERE section <> 'TOTAL' AND index_value IS NOT NULL AND (region_id, period) IN (SELECT (region_id, period) FROM n))
SELECT region_id, period, section, pit_current, pit_change, pit_yoy_pct, index_value FROM t FULL JOIN i USING (region_id, period, section)""", "receipts cumulative")
def l18(s, d):
    return production.cutoff_snapshot(_sectioned(q_receipts(s, d)), p.production(s, d, True))


@QUERIES.add("l19_regional_status", _R + _W + """
, x AS (SELECT region_id, period, tr, CASE WHEN t > 0 THEN tr / t * 100 END AS sh FROM w), y AS (SELECT a.*, a.sh - b.sh AS ch FROM x a LEFT JOIN x b ON a.region_id = b.region_id AND month(a.period) = month(b.period) AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE))
SELECT region_id, period, tr AS transfers_rub, sh AS transfer_share_pct, ch AS transfer_share_change_pp, f.actual_ytd_rub AS budget_balance_rub, c.index_value AS production_index, c.growth_yoy_pct FROM (SELECT DISTINCT region_id, period FROM fiscal)
LEFT JOIN y USING (region_id, period) LEFT JOIN (SELECT * FROM fiscal WHERE metric_code = 'budget_balance') f USING (region_id, period) LEFT JOIN (SELECT * FROM cumulative WHERE section = 'TOTAL') c USING (region_id, period)""", "fiscal cumulative")
def l19(s, d):
    return overview.regional_status(p.fiscal(s, d), p.revenue(s, d), p.production(s, d, True))


@QUERIES.add("l20_compared_regions", """
, h AS (SELECT region_id, section, index_value, period, max(period) OVER (PARTITION BY region_id) AS l FROM production WHERE index_value IS NOT NULL AND region_id IN ('3', '8')),
t AS (SELECT region_id, period, CAST(sum(CAST(flow AS DECIMAL(18,2))) AS DOUBLE) AS total, list_sort(list(DISTINCT section)) AS s FROM receipts WHERE region_id IN ('3', '8') GROUP BY ALL),
g AS (SELECT a.region_id, a.period, CASE WHEN b.total <> 0 AND NOT coalesce(a.s <> b.s, false) THEN (a.total / b.total - 1) * 100 END AS v FROM t a LEFT JOIN t b ON a.region_id = b.region_id AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE) QUALIFY a.period = max(a.period) OVER (PARTITION BY a.region_id)),
x AS (SELECT region_id, CASE WHEN plan_components_reconciled AND coalesce(revised_plan_rub, approved_plan_rub) > 0 THEN actual_ytd_rub / coalesce(revised_plan_rub, approved_plan_rub) * 100 END AS v FROM (SELECT *, max(period) OVER (PARTITION BY region_id) AS l FROM revenue WHERE region_id IN ('3', '8')) WHERE period = l AND revenue_code = '101_PIT'),
u AS (SELECT 'production_headline' AS indicator, region_id, index_value AS v FROM h WHERE period = l AND section = 'TOTAL' UNION ALL SELECT 'receipts_yoy_pct', region_id, v FROM g UNION ALL SELECT 'pit_plan_execution_pct', region_id, v FROM x)
SELECT indicator, round(max(CASE WHEN region_id = '3' THEN v END), 6) AS value_a, round(max(CASE WHEN region_id = '8' THEN v END), 6) AS value_b FROM u GROUP BY indicator""", "production revenue receipts")
def l20(s, d):
    out = overview.compared_regions(q_receipts(s, d), p.production(s, d), p.revenue(s, d), "3", "8", p.PIT)
    return out.select("indicator", F.round("value_a", 6).alias("value_a"), F.round("value_b", 6).alias("value_b"))


_HISTORY = """
, h AS (SELECT a.region_id, a.fuel_grade, a.period, a.source_price AS price, b.period AS bp, b.source_price AS b, c.period AS cp, c.source_price AS c FROM prices a LEFT JOIN prices b ON a.region_id = b.region_id AND a.fuel_grade = b.fuel_grade AND a.period = CAST(b.period + INTERVAL 1 MONTH AS DATE)
  LEFT JOIN prices c ON a.region_id = c.region_id AND a.fuel_grade = c.fuel_grade AND a.period = CAST(c.period + INTERVAL 12 MONTH AS DATE)),
x AS (SELECT *, 100 * (price - b) / b AS mom_change_pct, CASE WHEN bp IS NULL THEN 'prior_period_unavailable' ELSE 'matched' END AS mom_status, 100 * (price - c) / c AS yoy_change_pct, CASE WHEN cp IS NULL THEN 'prior_period_unavailable' ELSE 'matched' END AS yoy_status FROM h),
z AS (SELECT *, coalesce(abs(mom_change_pct) > 10 AND NOT abs(abs(mom_change_pct) - 10) <= 1e-10, false) AS mom_review_flag FROM x)"""
_H = ["region_id", "fuel_grade", "period", "price", "mom_change_pct", "mom_status", "yoy_change_pct", "yoy_status", "mom_review_flag"]


@QUERIES.add("l21_price_history", _HISTORY + f"SELECT {', '.join(_H)} FROM z", "prices")
def l21(s, d):
    return prices.price_history(p.prices(s, d)).select(*_H)


@QUERIES.add("l22_latest_prices", _HISTORY + """
, m AS (SELECT region_id, max(period) AS period FROM prices GROUP BY ALL), g AS (SELECT region_id, period, unnest(['1-URGENT', '2-HIGH', 'NO SUCH GRADE']) AS fuel_grade FROM m)
SELECT region_id, period, fuel_grade, price, z.price IS NOT NULL AS observation_present, CASE WHEN z.price IS NULL THEN 'no_observation_for_reporting_month' ELSE 'reported' END AS availability, mom_change_pct, coalesce(mom_status, 'current_price_unavailable') AS mom_status, coalesce(mom_review_flag, false) AS mom_review_flag FROM g LEFT JOIN z USING (region_id, period, fuel_grade)""", "prices")
def l22(s, d):
    out = prices.latest_prices(prices.price_history(p.prices(s, d)), ["1-URGENT", "2-HIGH", "NO SUCH GRADE"])
    return out.select("region_id", "period", "fuel_grade", "price", "observation_present", "availability", "mom_change_pct", "mom_status", "mom_review_flag")


@QUERIES.add("l23_scoped_prices", _HISTORY + f"SELECT {', '.join(_H)} FROM z WHERE region_id IN ('1', '2') AND fuel_grade IN ('2-HIGH')", "prices")
def l23(s, d):
    return prices.scoped_history(prices.price_history(p.prices(s, d)), ["1", "2"], ["2-HIGH"]).select(*_H)


@QUERIES.add("l24_selected_panel", "SELECT region_id, period, event_type, event_id, value FROM vintages QUALIFY row_number() OVER (PARTITION BY region_id, period, event_type ORDER BY vintage DESC, event_id DESC) = 1", "vintages")
def l24(s, d):
    return production.selected_panel(p.vintages(s, d), ["region_id", "period", "event_type"], "vintage", "event_id").select("region_id", "period", "event_type", "event_id", "value")


def _claims(s, d, basis="YTD"):
    revenue_rows = once(p.revenue(s, d), "revenue")
    fiscal_rows = once(p.fiscal(s, d, revenue_rows), "fiscal")
    return claims.claims(fiscal_rows, revenue_rows, p.production(s, d, True), prices.price_history(p.prices(s, d)), basis)


_CLAIMS = _F + _ENDS.replace("FROM o WHERE", "FROM o WHERE") + _COMPONENTS.replace("FROM o GROUP", "FROM oo GROUP").replace(", w AS", _R.replace(", o AS", ", oo AS") + ", w AS", 1) + """
, tx AS (SELECT region_id, period, own, CASE WHEN t > 0 THEN tr / t * 100 END AS sh, win FROM w), ty AS (SELECT a.*, b.sh AS psh, b.own AS pown FROM tx a LEFT JOIN tx b ON a.region_id = b.region_id AND a.win = b.win AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE)),
sp AS (SELECT region_id, period, f.v, t.v AS t FROM (SELECT DISTINCT region_id, period FROM o) LEFT JOIN (SELECT * FROM o WHERE metric_code = '1000') f USING (region_id, period) LEFT JOIN (SELECT * FROM o WHERE metric_code = 'expenditure_total') t USING (region_id, period)),
pz AS (SELECT a.region_id, CAST(last_day(a.period) AS DATE) AS period, 100 * (a.source_price - c.source_price) / c.source_price AS v FROM prices a LEFT JOIN prices c ON a.region_id = c.region_id AND a.fuel_grade = c.fuel_grade AND a.period = CAST(c.period + INTERVAL 12 MONTH AS DATE) WHERE a.fuel_grade = '2-HIGH'),
cl AS (SELECT region_id, period, 'budget_balance' AS claim_code, b AS value, 'RUB' AS unit, 'endpoint_unavailable' AS why FROM n UNION ALL SELECT region_id, period, 'budget_balance_change', b - pb, 'RUB', 'comparison_unavailable' FROM n
 UNION ALL SELECT region_id, period, 'transfer_share', sh, '%', 'endpoint_unavailable' FROM ty UNION ALL SELECT region_id, period, 'transfer_share_change', sh - psh, 'pp', 'comparison_unavailable' FROM ty UNION ALL SELECT region_id, period, 'own_source_growth', CASE WHEN pown > 0 THEN (own - pown) / pown * 100 END, '%', 'comparison_unavailable' FROM ty
 UNION ALL SELECT region_id, period, component_code || '_change', x - px, 'RUB', 'comparison_unavailable' FROM j WHERE component_code IN ('retained_pit', 'cit') UNION ALL SELECT region_id, period, component_code || '_contribution', CASE WHEN pt > 0 THEN (x - px) / pt * 100 END, 'pp', 'comparison_unavailable' FROM j WHERE component_code IN ('retained_pit', 'cit')
 UNION ALL SELECT region_id, period, 'social_policy_share', CASE WHEN t > 0 THEN v / t * 100 END, '%', 'endpoint_unavailable' FROM sp UNION ALL SELECT region_id, period, 'production_growth', growth_yoy_pct, '%', 'endpoint_unavailable' FROM cumulative WHERE section = 'TOTAL' UNION ALL SELECT region_id, period, 'price_growth', v, '%', 'comparison_unavailable' FROM pz)"""


#: How each claim is computed, and whether it compares with the year before.
_STATED = """
, st(claim_code, formula, compares) AS (VALUES ('budget_balance', 'balance', false), ('budget_balance_change', 'balance - prior balance', true), ('transfer_share', 'transfers / total revenue * 100', false),
 ('transfer_share_change', 'transfer share - prior transfer share', true), ('own_source_growth', '(own revenue - prior own revenue) / prior own revenue * 100', true), ('retained_pit_change', 'retained PIT - prior retained PIT', true),
 ('retained_pit_contribution', '(retained PIT - prior retained PIT) / prior total revenue * 100', true), ('cit_change', 'CIT - prior CIT', true), ('cit_contribution', '(CIT - prior CIT) / prior total revenue * 100', true),
 ('social_policy_share', 'social policy spending / total spending * 100', false), ('production_growth', 'January-to-month index - 100', true), ('price_growth', '(price - prior price) / prior price * 100', true))
, pp AS (SELECT DISTINCT claim_code, region_id, period FROM cl)
SELECT cl.region_id, cl.period, 'YTD' AS amount_basis, cl.claim_code, value, unit, CASE WHEN value IS NULL THEN why ELSE 'available' END AS availability, formula,
  '{"period":"' || CAST(cl.period AS VARCHAR) || '"' || CASE WHEN compares THEN coalesce(',"prior_period":"' || CAST(pp.period AS VARCHAR) || '"', '') ELSE '' END || '}' AS evidence
FROM cl JOIN st USING (claim_code) LEFT JOIN pp ON pp.claim_code = cl.claim_code AND pp.region_id = cl.region_id AND year(pp.period) + 1 = year(cl.period) AND month(pp.period) = month(cl.period)"""


@QUERIES.add("l25_claims", _CLAIMS + _STATED, "fiscal cumulative prices")
def l25(s, d):
    return _claims(s, d)


def _lineage(df, keys):
    """The lineage of a test panel's rows: a file a period, its hash, a member a key, the day after as cutoff."""
    name = F.concat(F.lit("report_"), F.date_format("period", "yyyy-MM-dd"), F.lit(".zip"))
    return df.withColumns({"source_file": name, "source_sha256": F.sha2(name, 256), "source_member": F.concat_ws("/", *keys), "reporting_cutoff": F.date_add("period", 1)})


#: file and member of a source, and the whole hash, as they come back from a statement.
def _behind(c: str):
    return F.array_join(F.array_sort(F.transform(c, lambda x: F.concat_ws("|", x["period"].cast("string"), x["source_file"], F.substring(x["source_sha256"], 1, 8), x["source_member"], x["reporting_cutoff"].cast("string")))), ";")


_SRC = "CAST({p}.period AS VARCHAR) || '|report_' || CAST({p}.period AS VARCHAR) || '.zip|' || sha256('report_' || CAST({p}.period AS VARCHAR) || '.zip')[1:8] || '|' || {m} || '|' || CAST(CAST({p}.period + INTERVAL 1 DAY AS DATE) AS VARCHAR)"
_STATEMENTS = f"""
, f AS (SELECT region_id, period, CASE month(period) WHEN 3 THEN 'Q1' ELSE 'H1' END AS win, kind, metric_code AS code, actual_ytd_rub AS v, {_SRC.format(p='fiscal', m="metric_code || '/' || kind")} AS src FROM fiscal WHERE month(period) IN (3, 6)),
r AS (SELECT region_id, period, CASE month(period) WHEN 3 THEN 'Q1' ELSE 'H1' END AS win, revenue_code AS code, actual_ytd_rub AS v, {_SRC.format(p='revenue', m='revenue_code')} AS src FROM revenue WHERE month(period) IN (3, 6)),
fc AS (SELECT DISTINCT region_id, period, win FROM f WHERE kind = 'summary'), rc AS (SELECT DISTINCT region_id, period, win FROM r),
fp AS (SELECT a.region_id, a.period, a.win, a.kind, a.code, a.v, a.src, b.v AS pv, b.src AS psrc FROM f a LEFT JOIN f b ON a.region_id = b.region_id AND a.kind = b.kind AND a.code = b.code AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE)),
fx AS (SELECT fc.*, u.code, f.v, f.src, g.v AS pv, g.src AS psrc FROM fc CROSS JOIN (VALUES ('revenue_total'), ('expenditure_total'), ('budget_balance')) u(code) LEFT JOIN f ON f.region_id = fc.region_id AND f.period = fc.period AND f.code = u.code AND f.kind = 'summary'
  LEFT JOIN (SELECT f.* FROM f JOIN fc USING (region_id, period)) g ON g.region_id = fc.region_id AND g.code = u.code AND g.kind = 'summary' AND fc.period = CAST(g.period + INTERVAL 12 MONTH AS DATE)),
mv AS (SELECT *, v - pv AS ch FROM fp WHERE kind = 'expenditure_function' QUALIFY count(v - pv) OVER (PARTITION BY region_id, period) = 14),
parts(name, code, sign) AS (VALUES ('retained_pit', '101_PIT', 1), ('cit', '101_CIT', 1), ('other_own', '100', 1), ('other_own', '101_PIT', -1), ('other_own', '101_CIT', -1), ('transfers', '202', 1), ('other_non_repayable', '200', 1), ('other_non_repayable', '202', -1)),
cp AS (SELECT rc.region_id, rc.period, rc.win, name, CASE WHEN count(*) = count(r.v) THEN sum(sign * r.v) END AS v, string_agg(r.src, ';' ORDER BY r.src) AS src, CASE WHEN count(*) = count(q.v) THEN sum(sign * q.v) END AS pv, string_agg(q.src, ';' ORDER BY q.src) AS psrc
  FROM rc CROSS JOIN parts LEFT JOIN r ON r.region_id = rc.region_id AND r.period = rc.period AND r.code = parts.code LEFT JOIN r q ON q.region_id = rc.region_id AND q.code = parts.code AND rc.period = CAST(q.period + INTERVAL 12 MONTH AS DATE) GROUP BY ALL),
ts AS (SELECT rc.region_id, rc.period, rc.win, CASE WHEN max(r.v) FILTER (r.code = 'TOTAL_REVENUE') > 0 THEN max(r.v) FILTER (r.code = '202') / max(r.v) FILTER (r.code = 'TOTAL_REVENUE') * 100 END AS v, string_agg(r.src, ';' ORDER BY r.src) AS src
  FROM rc LEFT JOIN r ON r.region_id = rc.region_id AND r.period = rc.period AND r.code IN ('202', 'TOTAL_REVENUE') GROUP BY ALL),
tp AS (SELECT a.*, b.v AS pv, b.src AS psrc FROM ts a LEFT JOIN ts b ON a.region_id = b.region_id AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE)),
pd AS (SELECT fc.*, u.sec, c.index_value - 100 AS v, CASE WHEN c.period IS NOT NULL THEN {_SRC.format(p='c', m='c.section')} END AS src FROM fc CROSS JOIN (VALUES ('TOTAL'), ('C')) u(sec) LEFT JOIN cumulative c ON c.region_id = fc.region_id AND c.period = fc.period AND c.section = u.sec),
pq AS (SELECT fc.*, a.source_price AS v, CASE WHEN a.period IS NOT NULL THEN {_SRC.format(p='a', m="a.fuel_grade")} END AS src, 100 * (a.source_price - b.source_price) / b.source_price AS ch, CASE WHEN b.period IS NOT NULL THEN {_SRC.format(p='b', m="b.fuel_grade")} END AS psrc
  FROM fc LEFT JOIN prices a ON a.region_id = fc.region_id AND a.fuel_grade = '2-HIGH' AND a.period = date_trunc('month', fc.period) LEFT JOIN prices b ON b.region_id = a.region_id AND b.fuel_grade = a.fuel_grade AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE)),
x AS (SELECT region_id, period, win, code AS claim_code, v AS value, src AS current, '' AS prior FROM fx UNION ALL SELECT region_id, period, win, code || '_change', v - pv, src, psrc FROM fx
 UNION ALL SELECT region_id, period, win, 'spending_' || code, ch, src, psrc FROM (SELECT * FROM mv WHERE ch > 0 QUALIFY row_number() OVER (PARTITION BY region_id, period ORDER BY ch DESC, code DESC) = 1)
 UNION ALL SELECT region_id, period, win, 'spending_' || code, ch, src, psrc FROM (SELECT * FROM mv WHERE ch < 0 QUALIFY row_number() OVER (PARTITION BY region_id, period ORDER BY ch, code) = 1)
 UNION ALL SELECT region_id, period, win, 'component_' || name, v - pv, src, psrc FROM cp UNION ALL SELECT region_id, period, win, 'transfer_share', v, src, '' FROM tp UNION ALL SELECT region_id, period, win, 'transfer_share_change', v - pv, src, psrc FROM tp
 UNION ALL SELECT region_id, period, win, 'production_' || sec, v, src, '' FROM pd UNION ALL SELECT region_id, period, win, 'fuel_2-HIGH_price', v, src, '' FROM pq UNION ALL SELECT region_id, period, win, 'fuel_2-HIGH_yoy', ch, src, psrc FROM pq)
SELECT region_id, period, win, claim_code, CASE WHEN abs(value) < 0.00005 THEN 0.0 ELSE round(value, 4) END AS value, CASE WHEN value IS NULL THEN 'unavailable' ELSE 'available' END AS availability, coalesce(current, '') AS current, coalesce(prior, '') AS prior FROM x"""


@QUERIES.add("l25_statements", _STATEMENTS, "fiscal cumulative prices")
def l25_statements(s, d):
    """All statements with the rows behind both ends, whose lineage came along through aggregations and calendar windows."""
    revenue_rows = once(p.revenue(s, d), "revenue")
    fiscal_rows = once(p.fiscal(s, d, revenue_rows), "fiscal")
    history = prices.price_history(_lineage(p.prices(s, d), ["fuel_grade"]), ("source_file", "source_sha256", "source_member", "reporting_cutoff"))
    out = claims.statements(_lineage(fiscal_rows, ["metric_code", "kind"]), _lineage(revenue_rows, ["revenue_code"]), _lineage(p.production(s, d, True), ["section"]), history, grades=("2-HIGH",))
    return out.select("region_id", "period", F.col("window").alias("win"), "claim_code", F.when(F.abs("value") < 0.00005, 0.0).otherwise(F.round("value", 4)).alias("value"), "availability", _behind("current").alias("current"), _behind("prior").alias("prior"))


@QUERIES.add("l26_claim_coverage", _CLAIMS + "SELECT claim_code, count(value) AS n_available, count(*) - count(value) AS n_withheld FROM cl GROUP BY claim_code", "fiscal cumulative prices")
def l26(s, d):
    return claims.claim_coverage(_claims(s, d))


@QUERIES.add("l27_profile_facts", """
, o AS (SELECT a.region_id, a.period, CASE WHEN b.actual_ytd_rub > 0 THEN (a.actual_ytd_rub / b.actual_ytd_rub - 1) * 100 END AS g FROM revenue a LEFT JOIN revenue b ON a.region_id = b.region_id AND a.revenue_code = b.revenue_code AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE) WHERE a.revenue_code = '100'),
e AS (SELECT a.region_id, a.period, CASE WHEN b.actual_ytd_rub > 0 THEN (a.actual_ytd_rub / b.actual_ytd_rub - 1) * 100 END AS g FROM fiscal a LEFT JOIN fiscal b ON a.region_id = b.region_id AND a.metric_code = b.metric_code AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE) WHERE a.metric_code = 'expenditure_total'),
t AS (SELECT a.region_id, a.period, b.actual_ytd_rub / a.actual_ytd_rub * 100 AS sh FROM revenue a JOIN revenue b USING (region_id, period) WHERE a.revenue_code = 'TOTAL_REVENUE' AND b.revenue_code = '202' AND a.actual_ytd_rub > 0), u AS (SELECT a.region_id, a.period, a.sh - b.sh AS v FROM t a JOIN t b ON a.region_id = b.region_id AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE)),
m AS (SELECT region_id, growth_yoy_pct FROM production WHERE section = 'TOTAL' QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY period DESC) <= 3), k AS (SELECT region_id, count(*) FILTER (growth_yoy_pct < 0) AS below FROM m GROUP BY ALL HAVING count(growth_yoy_pct) = 3)
SELECT o.region_id, o.period, o.g AS own_growth_pct, e.g AS spending_growth_pct, u.v AS transfer_share_shift_pp, k.below AS production_months_below FROM o JOIN e USING (region_id, period) LEFT JOIN u USING (region_id, period) LEFT JOIN k USING (region_id)""", "fiscal production")
def l27(s, d):
    return claims.profile_facts(production.headline_history(p.production(s, d)), once(p.revenue(s, d), "revenue"), p.fiscal(s, d))


@QUERIES.add("l28_profile_evidence", """SELECT 'industrial_production' AS dataset, region_id, period, section AS indicator, index_value AS value, 'index, previous-year month = 100' AS units, 'monthly' AS amount_basis FROM production
UNION ALL SELECT 'budget_revenue', region_id, period, revenue_code, actual_ytd_rub, 'RUB', 'YTD' FROM revenue UNION ALL SELECT 'fiscal_observations', region_id, period, metric_code, actual_ytd_rub, 'RUB', 'YTD' FROM fiscal
UNION ALL SELECT 'industry_pit', region_id, period, section, flow, 'RUB', 'observed period flow' FROM receipts""", "fiscal production receipts")
def l28(s, d):
    from ..operators.sets import evidence_union

    return evidence_union(
        ("industrial_production", p.production(s, d), "section", "index_value", "index, previous-year month = 100", "monthly"), ("budget_revenue", p.revenue(s, d), "revenue_code", "actual_ytd_rub", "RUB", "YTD"),
        ("fiscal_observations", p.fiscal(s, d), "metric_code", "actual_ytd_rub", "RUB", "YTD"), ("industry_pit", q_receipts(s, d), "section", "flow", "RUB", "observed period flow"),
    )


@QUERIES.add("l29_latest_profile", _F + _ENDS + _W.replace("FROM o GROUP", "FROM oo GROUP").replace(", w AS", _R.replace(", o AS", ", oo AS") + ", w AS", 1) + """
, x AS (SELECT region_id, period, n.r AS revenue, s AS spending, b AS balance, w.win, pit, cit, own, tr, oth FROM n JOIN w USING (region_id, period) WHERE b IS NOT NULL)
SELECT region_id, period, revenue, spending, balance, CASE WHEN win <> 'unsupported' THEN pit END AS retained_pit, CASE WHEN win <> 'unsupported' THEN cit END AS cit, CASE WHEN win <> 'unsupported' THEN own - pit - cit END AS other_own, CASE WHEN win <> 'unsupported' THEN tr END AS transfers, CASE WHEN win <> 'unsupported' THEN oth - tr END AS other_non_repayable
FROM x QUALIFY period = max(period) OVER (PARTITION BY region_id)""", "fiscal")
def l29(s, d):
    return fiscal.latest_profile(p.fiscal(s, d), p.revenue(s, d))


@QUERIES.add("l30_largest_movers", """
, x AS (SELECT a.region_id, a.period, a.metric_code, a.actual_ytd_rub - b.actual_ytd_rub AS c FROM fiscal a JOIN fiscal b ON a.region_id = b.region_id AND a.metric_code = b.metric_code AND month(a.period) = month(b.period) AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE) WHERE a.kind = 'expenditure_function')
SELECT region_id, period, arg_min(metric_code, struct_pack(a := -c, b := metric_code)) AS largest_increase, max(c) AS increase, arg_min(metric_code, struct_pack(a := c, b := metric_code)) AS largest_decrease, min(c) AS decrease FROM x GROUP BY ALL""", "fiscal")
def l30(s, d):
    return claims.largest_movers(p.fiscal(s, d))


@QUERIES.add("l31_source_rollup", """
, f AS (SELECT CAST(l_suppkey AS VARCHAR) AS sid, l_returnflag, CAST(l_shipdate AS DATE) AS period FROM lineitem), n AS (SELECT *, max(period) OVER (PARTITION BY l_returnflag) AS l FROM f)
SELECT l_returnflag, max(period) AS period, count(DISTINCT sid) AS n_sources, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS labels FROM n LEFT JOIN supplier ON sid = CAST(s_suppkey AS VARCHAR) WHERE period = l GROUP BY l_returnflag""".replace("\n, f AS", "\nWITH f AS", 1))
def l31(s, d):
    facts = table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("sid"), "l_returnflag", F.to_date("l_shipdate").alias("period"))
    register = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("source_id"), "s_name")
    return overview.source_rollup(facts, register, ["l_returnflag"], "sid", "s_name")


@QUERIES.add("l32_region_list", "SELECT CAST(n_nationkey AS VARCHAR) AS region_id, CASE WHEN n_nationkey % 3 <> 0 THEN n_name ELSE 'supplier ' || CAST(n_nationkey AS VARCHAR) END AS label FROM nation WHERE n_nationkey % 3 <> 0 OR n_nationkey IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT CAST(n_nationkey AS VARCHAR), NULL FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def l32(s, d):
    first = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("region_id"), F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.col("n_name")).alias("label"))
    second = table(s, d, "supplier").select(F.col("s_nationkey").cast("string").alias("region_id"), F.concat(F.lit("supplier "), F.col("s_nationkey").cast("string")).alias("label")).distinct()
    return overview.region_list(first, second)


@QUERIES.add("l36_coverage_registry", """
SELECT 'vintages' AS table_name, count(*) AS n_rows, min(period) AS earliest, max(period) AS latest, count(*) - count(value) AS n_missing, (SELECT count(*) - count(value) FROM vintages WHERE period = (SELECT max(period) FROM vintages)) AS n_missing_latest FROM vintages
UNION ALL SELECT 'receipts', count(*), min(period), max(period), 0, 0 FROM receipts""", "vintages receipts")
def l36(s, d):
    return overview.coverage_registry({"vintages": (p.vintages(s, d), "value"), "receipts": (q_receipts(s, d), "flow")})


@QUERIES.add("l19_latest_status", "SELECT region_id, section, max(period) AS period, arg_max(flow, period) AS flow FROM monthly GROUP BY ALL", "monthly")
def l19_latest(s, d):
    return windows.last_n(q_monthly(s, d), ["region_id", "section"], 1).select("region_id", "section", "period", "flow")
