"""Queries K01 to K30."""

from __future__ import annotations

from .. import contracts
from ..operators import filters, quality
from .base import F, Registry, once, p, q_monthly, q_receipts, table

QUERIES = Registry()


def _event(check: str, table_name: str, severity: str, observed: str, failed: str = "failed", source: str = "") -> str:
    """SQL of one event row."""
    return f"SELECT '{check}' AS check_id, '{table_name}' AS table_name, '{severity}' AS severity, CASE WHEN n = 0 THEN 'passed' ELSE '{failed}' END AS status, n AS observed, CAST(0 AS BIGINT) AS expected FROM (SELECT CAST(coalesce({observed}, 0) AS BIGINT) AS n FROM {source})"


def _union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def receipts_contract(s, d):
    """Receipts under the contract's names: a report a quarter, as of the day after; its vintage is the year."""
    df = q_receipts(s, d).select(
        "region_id", "period", "frequency", F.date_add("period", 1).alias("reporting_cutoff"), F.col("section").alias("okved_section"), F.col("section").alias("okved_raw"), F.col("ytd").alias("pit_ytd_rub"),
        F.col("flow").alias("pit_flow_rub"), F.lit("s1").alias("source_id"), F.year("period").cast("string").alias("source_vintage"), F.lit("verified").alias("quality_status"),
    )
    return filters.project(df, contracts.CONTRACTS["pit_receipts"])


@QUERIES.add("k01_contract_columns", "SELECT 'contract_columns' AS check_id, 'pit_receipts' AS table_name, 'critical' AS severity, 'failed' AS status, CAST(2 AS BIGINT) AS observed, CAST(0 AS BIGINT) AS expected FROM (SELECT count(*) FROM orders)")
def k01(s, d):
    return quality.check_columns("pit_receipts", receipts_contract(s, d).drop("source_id", "source_vintage"))


@QUERIES.add("k02_unique_grain", _event("unique_grain", "lineitem", "critical", "sum(n)", source="(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"))
def k02(s, d):
    return quality.check_grain("lineitem", table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@QUERIES.add("k03_not_null", _union(_event("not_null:value", "vintages", "high", "count(*) - count(value)", source="vintages"), _event("not_null:event_type", "vintages", "high", "count(*) - count(event_type)", source="vintages")), "vintages")
def k03(s, d):
    return quality.check_not_null("vintages", p.vintages(s, d), ["value", "event_type"])


@QUERIES.add("k04_domain", _event("domain:event_type", "events", "high", "count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase'))", source="events"))
def k04(s, d):
    return quality.check_domain("events", table(s, d, "events"), "event_type", ["click", "view", "purchase"])


@QUERIES.add("k05_nonnegative", _event("nonnegative:ytd", "receipts", "medium", "count(*) FILTER (ytd < 0)", "warning", "receipts"), "receipts")
def k05(s, d):
    return quality.check_nonnegative("receipts", q_receipts(s, d), "ytd")


@QUERIES.add("k06_industrial_scope", _event("industrial_scope", "production", "medium", "count(*) FILTER (section NOT IN ('TOTAL', 'B', 'C'))", "warning", "production"), "production")
def k06(s, d):
    return quality.check_scope("production", p.production(s, d), "section", ("TOTAL", "B", "C"))


@QUERIES.add("k07_negative_amounts", _event("negative_amounts", "receipts", "medium", "count(*) FILTER (flow < 0 OR ytd < 0)", "warning", "receipts"), "receipts")
def k07(s, d):
    return quality.check_amounts("receipts", q_receipts(s, d), "flow", "ytd")


@QUERIES.add("k08_known_table", "SELECT 'known_table' AS check_id, 'lineitem' AS table_name, 'critical' AS severity, 'failed' AS status, count(*) AS observed, CAST(0 AS BIGINT) AS expected FROM lineitem")
def k08(s, d):
    """How many rows no contract covers."""
    return quality.validate("lineitem", table(s, d, "lineitem"))


def validated_sql() -> str:
    rows = [_event("contract_columns", "pit_receipts", "critical", "0 * count(*)", source="receipts")]
    rows.append(_event("unique_grain", "pit_receipts", "critical", "sum(n)", source="(SELECT count(*) AS n FROM receipts GROUP BY region_id, period, section HAVING count(*) > 1)"))
    rows += [_event(f"not_null:{c}", "pit_receipts", "high", f"count(*) - count({x})", source="receipts") for c, x in (("region_id", "region_id"), ("period", "period"), ("reporting_cutoff", "period"), ("okved_raw", "section"), ("pit_ytd_rub", "ytd"), ("source_id", "1"), ("source_vintage", "period"))]
    rows += [_event("domain:frequency", "pit_receipts", "high", "0 * count(*)", source="receipts"), _event("domain:quality_status", "pit_receipts", "medium", "0 * count(*)", source="receipts"), _event("nonnegative:pit_ytd_rub", "pit_receipts", "medium", "count(*) FILTER (ytd < 0)", "warning", "receipts")]
    return _union(*rows)


@QUERIES.add("k09_validate_table", validated_sql(), "receipts")
def k09(s, d):
    return quality.validate("pit_receipts", receipts_contract(s, d))


@QUERIES.add("k10_blocking_events", f"SELECT * FROM ({_event('unique_grain', 'lineitem', 'critical', 'sum(n)', source='(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)')}) WHERE status = 'failed'")
def k10(s, d):
    events = quality.check_grain("lineitem", table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    return quality.blocking(events.unionByName(quality.check_nonnegative("lineitem", table(s, d, "lineitem"), "l_quantity")))


@QUERIES.add("k11_reconcile_events", """
, a AS (SELECT region_id, period, max(CASE WHEN revenue_code = '101_PIT' THEN actual_ytd_rub END) AS total_a, max(CASE WHEN revenue_code = 'TOTAL_REVENUE' THEN actual_ytd_rub END) AS total_b FROM revenue GROUP BY ALL HAVING total_a IS NOT NULL AND total_b IS NOT NULL)
SELECT *, CASE WHEN total_b <> 0 THEN (total_a - total_b) / total_b * 100 END AS gap_pct, CASE WHEN abs((total_a - total_b) / nullif(total_b, 0) * 100) > 60 THEN 'warning' ELSE 'passed' END AS status FROM a""", "revenue")
def k11(s, d):
    r = p.revenue(s, d)
    return quality.reconcile(r.filter(F.col("revenue_code") == p.PIT), r.filter(F.col("revenue_code") == p.TOTAL), ["region_id", "period"], "actual_ytd_rub", "actual_ytd_rub", 60.0)


@QUERIES.add("k12_source_coverage", """
SELECT 'skipped:' || reason AS check_id, 'sources' AS table_name, 'medium' AS severity, 'warning' AS status, n AS observed, CAST(0 AS BIGINT) AS expected FROM (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'missing_dictionary' ELSE 'duplicate' END AS reason, count(*) AS n FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY ALL)
UNION ALL SELECT 'core_table_not_empty', 'orders', 'critical', CASE WHEN count(*) > 0 THEN 'passed' ELSE 'failed' END, CAST(count(*) = 0 AS BIGINT), 0 FROM orders""")
def k12(s, d):
    rejects = table(s, d, "supplier").filter("s_suppkey % 2 = 0").select(F.when(F.col("s_suppkey") % 3 == 0, "missing_dictionary").otherwise("duplicate").alias("why"))
    return quality.source_coverage(rejects, "why", {"orders": table(s, d, "orders")})


@QUERIES.add("k13_components", """
, w AS (SELECT region_id, period, max(CASE WHEN revenue_code = 'TOTAL_REVENUE' THEN actual_ytd_rub END) AS total, max(CASE WHEN revenue_code = '100' THEN actual_ytd_rub END) + max(CASE WHEN revenue_code = '200' THEN actual_ytd_rub END) AS parts FROM revenue GROUP BY ALL)
SELECT region_id, period, total, parts, total - parts AS gap, CASE WHEN total - parts IS NULL THEN 'not_assessable' WHEN abs(total - parts) <= 0.02 THEN 'passed' ELSE 'failed' END AS status FROM w""", "revenue")
def k13(s, d):
    return quality.check_components(p.revenue(s, d), ["region_id", "period"], "revenue_code", "actual_ytd_rub", p.TOTAL, [p.OWN, p.OTHER])


_IDENTITIES = """
, w AS (SELECT region_id, period, max(CASE WHEN metric_code = 'revenue_total' THEN actual_ytd_rub END) AS r, max(CASE WHEN metric_code = 'expenditure_total' THEN actual_ytd_rub END) AS e, max(CASE WHEN metric_code = 'budget_balance' THEN actual_ytd_rub END) AS b,
  max(CASE WHEN metric_code = 'financing_total' THEN actual_ytd_rub END) AS f, CASE WHEN count(*) FILTER (kind = 'expenditure_function') = 14 THEN CAST(sum(CAST(actual_ytd_rub AS DECIMAL(20,2))) FILTER (kind = 'expenditure_function') AS DOUBLE) END AS g FROM fiscal GROUP BY ALL),
c AS (SELECT region_id, period, unnest(['revenue_minus_spending_is_balance', 'balance_plus_financing_is_zero', 'functions_sum_to_spending']) AS check_id, unnest([r - e - b, b + f, g - e]) AS gap FROM w)"""


@QUERIES.add("k14_accounting_checks", _IDENTITIES + "SELECT region_id, period, check_id, CASE WHEN gap IS NULL THEN 'not_assessable' WHEN abs(gap) <= 0.02 THEN 'passed' ELSE 'failed' END AS status FROM c", "fiscal")
def k14(s, d):
    return quality.accounting_checks(p.fiscal(s, d)).drop("gap")


@QUERIES.add("k15_fiscal_load", _IDENTITIES + _union(_event("unique_grain", "fiscal_observations", "critical", "sum(n)", source="(SELECT count(*) AS n FROM fiscal GROUP BY region_id, period, kind, metric_code HAVING count(*) > 1)"), _event("finite", "fiscal_observations", "critical", "count(*) FILTER (NOT isfinite(actual_ytd_rub))", source="fiscal"), _event("identities", "fiscal_observations", "critical", "count(*) FILTER (abs(gap) > 0.02)", source="c")), "fiscal")
def k15(s, d):
    return quality.check_fiscal(p.fiscal(s, d))


@QUERIES.add("k16_revenue_load", """
, w AS (SELECT region_id, period, array_to_string([x for x in ['101_PIT', '202', 'TOTAL_REVENUE'] if NOT list_contains(list(revenue_code), x)], ',') AS missing_codes,
  max(CASE WHEN revenue_code = 'TOTAL_REVENUE' THEN actual_ytd_rub END) - max(CASE WHEN revenue_code = '100' THEN actual_ytd_rub END) - max(CASE WHEN revenue_code = '200' THEN actual_ytd_rub END) AS gap,
  max(CASE WHEN revenue_code = 'TOTAL_REVENUE' THEN approved_plan_rub END) - max(CASE WHEN revenue_code = '100' THEN approved_plan_rub END) - max(CASE WHEN revenue_code = '200' THEN approved_plan_rub END) AS plan_gap, bool_and(plan_components_reconciled) AS flag FROM revenue GROUP BY ALL)
SELECT region_id, period, missing_codes, gap, coalesce(abs(gap) <= 0.02, false) AS actual_reconciles, flag = coalesce(abs(plan_gap) <= 0.02, false) AS plan_flag_agrees FROM w""", "revenue")
def k16(s, d):
    return quality.check_revenue(p.revenue(s, d), [p.PIT, p.TRANSFERS, p.TOTAL], p.TOTAL, p.OWN, p.OTHER)


@QUERIES.add("k17_sources", _union(_event("orphan_source", "facts", "high", "count(*)", source="lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 <> 4)"), _event("hash_format", "sources", "high", "count(*) FILTER (s_suppkey % 11 = 0)", source="(SELECT * FROM supplier WHERE s_suppkey % 9 <> 4)"), _event("unique_grain", "sources", "critical", "0 * count(*)", source="supplier")))
def k17(s, d):
    register = table(s, d, "supplier").filter("s_suppkey % 9 <> 4").select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_suppkey") % 11 == 0, "bad").otherwise(F.sha2("s_name", 256)).alias("sha256"))
    return quality.check_sources(table(s, d, "lineitem").select("l_suppkey"), register, "l_suppkey")


@QUERIES.add("k18_windows", _union(_event("month_end", "production", "high", "count(*) FILTER (period <> last_day(period))", source="cumulative"), _event("starts_on_1_january", "production", "high", "count(*) FILTER (region_id = '4')", source="cumulative"), _event("window_months", "production", "high", "count(*) FILTER (month(period) > 11)", source="cumulative")), "cumulative")
def k18(s, d):
    df = p.production(s, d, True)
    start = F.when(F.col("region_id") == "4", F.date_sub(F.trunc("period", "year"), 1)).otherwise(F.trunc("period", "year"))
    return quality.check_windows(df.withColumns({"window_start": start, "window_months": F.least(F.month("period"), F.lit(11))}))


@QUERIES.add("k19_index_values", _union(*[_event(c, "production", "high", x, source="production") for c, x in (("finite", "0 * count(*)"), ("nonnegative", "count(*) FILTER (index_value < 0)"), ("growth_is_index_less_100", "0 * count(*)"), ("availability_says_value", "count(*) FILTER (section = 'E' AND index_value IS NOT NULL)"))]), "production")
def k19(s, d):
    df = p.production(s, d).withColumn("availability", F.when((F.col("section") == "E") | F.col("index_value").isNull(), "unavailable").otherwise("reported"))
    return quality.check_index_values(df)


@QUERIES.add("k20_provenance", _union(_event("file_in_manifest", "production", "critical", "count(*) FILTER (s_suppkey % 10 = 1)", source="supplier"), _event("hash_agrees", "production", "critical", "count(*) FILTER (s_suppkey % 10 = 2)", source="supplier")))
def k20(s, d):
    sup = table(s, d, "supplier")
    facts = sup.select(F.col("s_name").alias("source_file"), F.sha2("s_name", 256).alias("source_sha256"))
    manifest = sup.filter("s_suppkey % 10 <> 1").select(F.col("s_name").alias("source_file"), F.when(F.col("s_suppkey") % 10 == 2, "other").otherwise(F.sha2("s_name", 256)).alias("sha256"))
    return quality.check_provenance(facts, manifest)


@QUERIES.add("k21_calendar_grid_gaps", """
, b AS (SELECT CAST(date_trunc('month', min(period)) AS DATE) AS a, max(period) AS z FROM monthly), c AS (SELECT CAST(last_day(m) AS DATE) AS period FROM (SELECT unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS m FROM b)),
g AS (SELECT region_id, period, unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS section FROM (SELECT DISTINCT region_id FROM monthly), c)
SELECT region_id, period, section FROM g ANTI JOIN monthly USING (region_id, period, section)""", "monthly")
def k21(s, d):
    return quality.calendar_grid_gaps(once(q_monthly(s, d), "monthly"), "region_id", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "section")


@QUERIES.add("k22_annual", _union(_event("year_end", "production_annual", "high", "count(*) FILTER (month(period) <> 12)", source="cumulative"), _event("growth_is_index_less_100", "production_annual", "high", "0 * count(*)", source="cumulative")), "cumulative")
def k22(s, d):
    return quality.check_annual(p.production(s, d, True))


@QUERIES.add("k23_prices", _union(*[_event(c, "prices", sev, x, source="prices") for c, sev, x in (("grain_not_null", "critical", "0 * count(*)"), ("month_start", "critical", "0 * count(*)"), ("known_grade", "high", "count(*) FILTER (fuel_grade = '5-LOW')"), ("positive", "high", "count(*) FILTER (source_price <= 0)"), ("unique_grain", "critical", "0 * count(*)"))]), "prices")
def k23(s, d):
    return quality.check_prices(quality.price_availability(p.prices(s, d)), p.GRADES[:4])


@QUERIES.add("k24_price_availability", """
SELECT event_id, CASE WHEN value > 5 THEN value END AS price, CASE WHEN value > 5 THEN 'reported' WHEN value IS NULL THEN 'missing_source_value' ELSE 'invalid_source_value' END AS availability FROM (SELECT event_id, CASE WHEN value > 5 THEN value WHEN value IS NOT NULL THEN -1 END AS value FROM vintages)""", "vintages")
def k24(s, d):
    v = p.vintages(s, d)
    raw = F.when(F.col("value") > 5, F.col("value").cast("string")).when(F.col("value").isNotNull(), F.when(F.col("event_id") % 2 == 0, "-1").otherwise("n/a"))
    return quality.price_availability(v.withColumn("source_price", raw)).select("event_id", "price", "availability")


@QUERIES.add("k25_price_coverage", """
, b AS (SELECT min(period) AS a, max(period) AS z FROM prices), c AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS period FROM b), g AS (SELECT region_id, period, unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS fuel_grade FROM (SELECT DISTINCT region_id FROM prices), c),
x AS (SELECT fuel_grade, count(*) AS n FROM g ANTI JOIN prices USING (region_id, period, fuel_grade) GROUP BY ALL)
SELECT fuel_grade, count(source_price) AS n_reported, count(*) - count(source_price) AS n_missing, coalesce(any_value(n), 0) AS n_absent FROM prices LEFT JOIN x USING (fuel_grade) GROUP BY fuel_grade""", "prices")
def k25(s, d):
    return quality.price_coverage(quality.price_availability(p.prices(s, d)), p.GRADES)


@QUERIES.add("k26_validate_dataset", _union(_event("period_end", "receipts", "high", "0 * count(*)", source="receipts"), _event("finite", "receipts", "high", "0 * count(*)", source="receipts"), _event("nonnegative", "receipts", "high", "count(*) FILTER (flow < 0)", source="receipts"), _event("unique_grain", "receipts", "critical", "0 * count(*)", source="receipts"), _event("eligible_region", "receipts", "high", "count(*) FILTER (CAST(region_id AS INT) >= 20)", source="receipts")), "receipts")
def k26(s, d):
    eligible = table(s, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("region_id"))
    return quality.validate_dataset("receipts", q_receipts(s, d), ["region_id", "section", "period"], "flow", eligible, "quarter", True)


@QUERIES.add("k27_references", _union(_event("foreign_key", "customer", "high", "count(*)", source="(SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 23))"), _event("whole_population", "customer", "medium", "count(*)", "warning", "(SELECT n_nationkey FROM nation WHERE n_nationkey < 23 AND n_nationkey NOT IN (SELECT c_nationkey FROM customer))"), _event("foreign_key", "supplier", "high", "count(*)", source="(SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 23))"), _event("whole_population", "supplier", "medium", "count(*)", "warning", "(SELECT n_nationkey FROM nation WHERE n_nationkey < 23 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier))")))
def k27(s, d):
    nations = table(s, d, "nation").filter("n_nationkey < 23").select(F.col("n_nationkey").alias("k"))
    return quality.check_references({"customer": table(s, d, "customer").select(F.col("c_nationkey").alias("k")), "supplier": table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))}, nations, "k")


@QUERIES.add("k28_parity", """
, a AS (SELECT region_id, section, period, flow FROM receipts WHERE quarter(period) <> 2), b AS (SELECT region_id, section, period, CASE WHEN region_id = '7' THEN flow + 1 ELSE flow END AS flow FROM receipts WHERE quarter(period) <> 3)
SELECT CASE WHEN b.flow IS NULL THEN 'only_a' WHEN a.flow IS NULL THEN 'only_b' WHEN abs(a.flow - b.flow) <= 0.5 THEN 'same' ELSE 'different' END AS verdict, count(*) AS n FROM a FULL JOIN b USING (region_id, section, period) GROUP BY ALL""", "receipts")
def k28(s, d):
    df = q_receipts(s, d).select("region_id", "section", "period", "flow")
    b = df.filter("quarter(period) <> 3").withColumn("flow", F.when(F.col("region_id") == "7", F.col("flow") + 1).otherwise(F.col("flow")))
    return quality.parity(df.filter("quarter(period) <> 2"), b, ["region_id", "section", "period"], ["flow"], 0.5)


@QUERIES.add("k29_compare_frames", "SELECT c_custkey, a.c_acctbal AS a_c_acctbal, b.v AS b_c_acctbal FROM customer a FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN c_acctbal + 1 ELSE c_acctbal * (1 + 1e-12) END AS v FROM customer WHERE c_custkey % 7 <> 0) b USING (c_custkey) WHERE v IS NULL OR c_custkey % 50 = 0")
def k29(s, d):
    a = table(s, d, "customer").select("c_custkey", "c_acctbal")
    b = a.filter("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 50 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal") * (1 + 1e-12)))
    return quality.compare_frames(a, b, ["c_custkey"])


@QUERIES.add("k30_mixed_provenance", "SELECT o_custkey, count(DISTINCT coalesce(o_orderstatus, chr(0))) AS n_o_orderstatus, count(DISTINCT o_orderpriority) AS n_o_orderpriority FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1")
def k30(s, d):
    return quality.mixed_provenance(table(s, d, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])
