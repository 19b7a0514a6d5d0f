"""Queries D01 to D22."""

from __future__ import annotations

from ..operators import aggregates as agg
from ..operators import distinct
from ..plans import overview, prices
from .base import F, Registry, once, p, q_monthly, q_receipts, table

QUERIES = Registry()
M = "CAST(flow AS DECIMAL(18,2))"


def _money(df, c="flow"):
    return df.withColumn(c, F.col(c).cast("decimal(18,2)"))


@QUERIES.add("d01_sum_or_null", "SELECT region_id, event_type, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM vintages GROUP BY ALL", "vintages")
def d01(s, d):
    v = p.vintages(s, d).withColumn("value", F.col("value").cast("decimal(18,4)"))
    return agg.sum_with_least(v, ["region_id", "event_type"], "value").withColumn("value", F.col("value").cast("double"))


@QUERIES.add("d02_sum_with_least", f"SELECT region_id, period, CASE WHEN count(flow) >= 5 THEN CAST(sum({M}) AS DOUBLE) END AS flow FROM receipts GROUP BY ALL", "receipts")
def d02(s, d):
    return agg.sum_with_least(_money(q_receipts(s, d)), ["region_id", "period"], "flow", 5).withColumn("flow", F.col("flow").cast("double"))


@QUERIES.add("d03_contributions", f"""
, a AS (SELECT region_id, section, sum({M}) AS c FROM receipts WHERE year(period) = 1998 GROUP BY ALL), b AS (SELECT region_id, section, sum({M}) AS p FROM receipts WHERE year(period) = 1997 GROUP BY ALL),
j AS (SELECT region_id, section, CAST(coalesce(c, 0) AS DOUBLE) AS current, CAST(coalesce(p, 0) AS DOUBLE) AS previous, CAST(coalesce(c, 0) - coalesce(p, 0) AS DOUBLE) AS change, CAST(sum(coalesce(p, 0)) OVER (PARTITION BY region_id) AS DOUBLE) AS t FROM a FULL JOIN b USING (region_id, section))
SELECT region_id, section, current, previous, change, CASE WHEN t > 0 THEN change / t * 100 END AS contribution_pp FROM j""", "receipts")
def d03(s, d):
    df = _money(q_receipts(s, d))
    out = agg.contributions(df.filter("year(period) = 1998"), df.filter("year(period) = 1997"), "section", "flow", ["region_id"])
    from pyspark.sql import Window

    total = F.sum("previous").over(Window.partitionBy("region_id")).cast("double")
    out = out.withColumn("t", total)
    cast = {c: F.col(c).cast("double") for c in ("current", "previous", "change")}
    return out.withColumns(cast).withColumn("contribution_pp", F.when(F.col("t") > 0, F.col("change") / F.col("t") * 100)).drop("t")


@QUERIES.add("d04_receipts_summary", f"""
, b AS (SELECT region_id, period, CAST(sum({M}) AS DOUBLE) AS total, list_sort(list(DISTINCT section)) AS s FROM monthly GROUP BY ALL), e AS (SELECT region_id, list_sort(list(DISTINCT section)) AS ever, max(period) AS period FROM monthly GROUP BY ALL)
SELECT region_id, period, b.total, CASE WHEN p.total <> 0 AND NOT coalesce(b.s <> p.s, false) THEN (b.total / p.total - 1) * 100 END AS yoy_pct, coalesce(b.s <> p.s, false) AS coverage_changed, array_to_string([x for x in ever if NOT list_contains(b.s, x)], ',') AS missing_sections
FROM b JOIN e USING (region_id, period) LEFT JOIN (SELECT region_id AS r, CAST(period + INTERVAL 12 MONTH AS DATE) AS q, total, s FROM b) p ON r = region_id AND q = period""", "monthly")
def d04(s, d):
    df = _money(q_monthly(s, d))
    out = overview.receipts_summary(df)
    return _as_double_growth(df, out)


def _as_double_growth(df, out):
    """Totals as doubles, so that the ratio is that of doubles in both engines."""
    by = df.groupBy("region_id", "period").agg(F.sum("flow").cast("double").alias("t"))
    prior = by.select("region_id", F.add_months("period", 12).alias("period"), F.col("t").alias("b"))
    out = out.drop("total").join(by, ["region_id", "period"]).join(prior, ["region_id", "period"], "left")
    growth = F.when((F.col("b") != 0) & ~F.col("coverage_changed"), (F.col("t") / F.col("b") - 1) * 100)
    return out.select("region_id", "period", F.col("t").alias("total"), growth.alias("yoy_pct"), "coverage_changed", "missing_sections")


@QUERIES.add("d05_section_snapshot", """
, s AS (SELECT region_id, period, section, flow AS level, max(period) OVER (PARTITION BY region_id) AS l FROM receipts)
SELECT a.region_id, a.period, a.section, a.level, CASE WHEN CAST(sum(CAST(a.level AS DECIMAL(18,2))) OVER (PARTITION BY a.region_id) AS DOUBLE) <> 0 THEN a.level / CAST(sum(CAST(a.level AS DECIMAL(18,2))) OVER (PARTITION BY a.region_id) AS DOUBLE) * 100 END AS share_pct,
  b.level AS prior, a.level - b.level AS change, CASE WHEN b.level > 0 THEN (a.level / b.level - 1) * 100 END AS yoy_pct
FROM (SELECT * FROM s WHERE period = l) a LEFT JOIN s b ON a.region_id = b.region_id AND a.section = b.section AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE)""", "receipts")
def d05(s, d):
    from pyspark.sql import Window

    out = overview.section_snapshot(q_receipts(s, d))
    total = F.sum(F.col("level").cast("decimal(18,2)")).over(Window.partitionBy("region_id")).cast("double")
    return out.withColumn("t", total).withColumn("share_pct", F.when(F.col("t") != 0, F.col("level") / F.col("t") * 100)).drop("t")


@QUERIES.add("d06_headline_and_sections", """
, n AS (SELECT *, max(period) OVER (PARTITION BY region_id) AS l FROM production WHERE index_value IS NOT NULL)
SELECT region_id, period, section, index_value, headline FROM (SELECT *, max(CASE WHEN section = 'TOTAL' THEN index_value END) OVER (PARTITION BY region_id) AS headline FROM n WHERE period = l) WHERE section <> 'TOTAL'""", "production")
def d06(s, d):
    return overview.headline_and_sections(p.production(s, d))


@QUERIES.add("d07_plan_snapshot", """
, n AS (SELECT *, max(period) OVER (PARTITION BY region_id) AS l FROM revenue), o AS (SELECT region_id, period, CASE revenue_code WHEN 'TOTAL_REVENUE' THEN 'Total revenue' WHEN '100' THEN 'Own-source revenue' WHEN '101_PIT' THEN 'PIT' END AS metric,
  actual_ytd_rub AS a, coalesce(revised_plan_rub, approved_plan_rub) AS pl, revised_plan_rub IS NOT NULL AS rv, plan_components_reconciled AS ok FROM n WHERE period = l)
SELECT region_id, period, metric, a AS actual_rub, pl AS plan_rub, CASE WHEN bool_and(ok) OVER (PARTITION BY region_id) AND pl > 0 THEN a / pl * 100 END AS execution_pct, CASE WHEN rv THEN 'Revised plan' ELSE 'Reported approved plan' END AS plan_basis FROM o WHERE metric IS NOT NULL""", "revenue")
def d07(s, d):
    return overview.plan_snapshot(p.revenue(s, d), {p.TOTAL: "Total revenue", p.OWN: "Own-source revenue", p.PIT: "PIT"})


@QUERIES.add("d08_plan_execution", """
SELECT region_id, period, revenue_code, coalesce(revised_plan_rub, approved_plan_rub) AS plan_used_rub, CASE WHEN coalesce(revised_plan_rub, approved_plan_rub) > 0 THEN actual_ytd_rub / coalesce(revised_plan_rub, approved_plan_rub) * 100 END AS execution_pct,
  coalesce(revised_plan_rub, approved_plan_rub) - actual_ytd_rub AS remaining_to_plan_rub FROM revenue""", "revenue")
def d08(s, d):
    return agg.plan_execution(p.revenue(s, d)).select("region_id", "period", "revenue_code", "plan_used_rub", "execution_pct", "remaining_to_plan_rub")


@QUERIES.add("d09_coverage", "SELECT region_id, event_type, count(*) AS n_rows, count(value) AS n_reported, count(*) - count(value) AS n_missing, min(period) AS earliest, max(period) AS latest FROM vintages GROUP BY ALL", "vintages")
def d09(s, d):
    return agg.coverage(p.vintages(s, d), ["region_id", "event_type"], "value")


@QUERIES.add("d10_calendar_holes", """
SELECT region_id, (datediff('month', min(period), max(period)) + 1) * 5 AS n_expected, count(*) AS n_present, (datediff('month', min(period), max(period)) + 1) * 5 - count(*) AS n_absent FROM monthly GROUP BY region_id""", "monthly")
def d10(s, d):
    return agg.calendar_holes(q_monthly(s, d), ["region_id"], 5)


_SECTIONS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@QUERIES.add("d11_distinct_counts", "SELECT period, " + ", ".join(f'count(DISTINCT CASE WHEN section = \'{c}\' THEN region_id END) AS "{c}"' for c in _SECTIONS) + " FROM monthly GROUP BY period", "monthly")
def d11(s, d):
    return agg.distinct_counts(q_monthly(s, d), "period", "section", _SECTIONS, "region_id")


@QUERIES.add("d11_merged_distinct", """
SELECT CAST(year(o_orderdate) AS INT) AS year, c_mktsegment AS section, count(DISTINCT o_custkey) AS n_o_custkey, count(DISTINCT c_nationkey) AS n_c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
UNION ALL SELECT NULL, c_mktsegment, count(DISTINCT o_custkey), count(DISTINCT c_nationkey) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def d11_merged(s, d):
    """Distinct customers and regions by year and section; the totals over all years come from the years' states, not from rows."""
    rows = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("section"), "o_custkey", "c_nationkey")
    columns, early, late = ["o_custkey", "c_nationkey"], F.col("year") < 1995, F.col("year") >= 1995
    # Two releases: the second adds to the dictionary and brings a state of its own.
    known = distinct.dictionary(rows.filter(early), columns)
    grown = distinct.dictionary(rows.filter(late), columns, known)
    states = [once(distinct.state(rows.filter(part), ["year", "section"], columns, numbers), "state") for part, numbers in ((early, known), (late, grown))]
    years = distinct.counts(distinct.merged(states, ["year", "section"]), ["year", "section"], columns)
    total = distinct.counts(distinct.merged(states, ["section"]), ["section"], columns)
    return years.unionByName(total.withColumn("year", F.lit(None).cast("int")))


@QUERIES.add("d12_status_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def d12(s, d):
    return agg.status_counts(table(s, d, "orders"), "o_orderstatus", "o_orderpriority")


@QUERIES.add("d13_codes_to_columns", """
SELECT region_id, period, max(CASE WHEN revenue_code = 'TOTAL_REVENUE' THEN actual_ytd_rub END) AS total, max(CASE WHEN revenue_code = '100' THEN actual_ytd_rub END) AS own, max(CASE WHEN revenue_code = '200' THEN actual_ytd_rub END) AS other,
  abs(max(CASE WHEN revenue_code = 'TOTAL_REVENUE' THEN actual_ytd_rub END) - max(CASE WHEN revenue_code = '100' THEN actual_ytd_rub END) - max(CASE WHEN revenue_code = '200' THEN actual_ytd_rub END)) <= 0.02 AS reconciles FROM revenue GROUP BY ALL""", "revenue")
def d13(s, d):
    out = agg.codes_to_columns(p.revenue(s, d), ["region_id", "period"], "revenue_code", "actual_ytd_rub", {p.TOTAL: "total", p.OWN: "own", p.OTHER: "other"})
    return out.withColumn("reconciles", F.abs(F.col("total") - F.col("own") - F.col("other")) <= 0.02)


#: All years that the orders of the given tables have.
_YEARS = range(1992, 2006)


@QUERIES.add("d14_coverage_matrix", "SELECT region_id, " + ", ".join(f"""coalesce(min(CASE WHEN year(period) = {y} THEN 'seen' END), 'absent') AS "{y}\"""" for y in _YEARS) + " FROM monthly GROUP BY region_id", "monthly")
def d14(s, d):
    df = q_monthly(s, d).select("region_id", F.year("period").alias("y"), F.lit("seen").alias("status"))
    return agg.coverage_matrix(df, "region_id", "y", list(_YEARS), "status")


@QUERIES.add("d15_duplicate_grain", "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def d15(s, d):
    return agg.duplicate_grain(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@QUERIES.add("d16_missing_counts", """
SELECT unnest(['region_id', 'period', 'event_type', 'event_id', 'value']) AS field, unnest([count(*) - count(region_id), count(*) - count(period), count(*) - count(event_type), count(*) - count(event_id), count(*) - count(value)]) AS n_missing FROM vintages""", "vintages")
def d16(s, d):
    return agg.missing_counts(p.vintages(s, d).drop("vintage"))


@QUERIES.add("d17_field_dictionary", """
SELECT 'customer' AS table_name, unnest(['c_custkey', 'c_name', 'c_acctbal']) AS field, unnest(['bigint', 'string', 'double']) AS type, unnest([true, false, false]) AS is_key, unnest([count(*) - count(c_custkey), count(*) - count(c_name), count(*) - count(c_acctbal)]) AS n_missing FROM customer""")
def d17(s, d):
    return agg.field_dictionary(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "customer", ["c_custkey"])


@QUERIES.add("d18_all_and_any", "SELECT region_id, period, bool_and(flow > 0) AS all_hold, bool_or(flow > 0) AS any_holds FROM receipts GROUP BY ALL", "receipts")
def d18(s, d):
    return agg.all_and_any(q_receipts(s, d), ["region_id", "period"], F.col("flow") > 0)


@QUERIES.add("d19_registry", """
SELECT p_brand, min(p_size) AS first_period, max(p_size) AS last_period, count(DISTINCT p_size) AS n_periods, count(DISTINCT p_type) AS n_labels, min(p_type) AS label, count(DISTINCT p_type) > 1 AS label_drift FROM part GROUP BY p_brand""")
def d19(s, d):
    return agg.registry(table(s, d, "part"), "p_brand", "p_type", "p_size")


@QUERIES.add("d20_column_fingerprints", """
SELECT field, count(*) AS n_entities, CAST(sum(CAST('0x' || substr(h, 1, 7) AS BIGINT)) AS BIGINT) AS low, CAST(sum(CAST('0x' || substr(h, 8, 7) AS BIGINT)) AS BIGINT) AS high FROM (SELECT field, md5(k || '=' || coalesce(v, '')) AS h FROM (
  SELECT CAST(p_partkey AS VARCHAR) AS k, unnest(['brand', 'brand_again', 'type']) AS field, unnest([p_brand, p_brand, p_type]) AS v FROM part)) GROUP BY field""")
def d20(s, d):
    df = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_brand").alias("brand_again"), F.col("p_type").alias("type"))
    return agg.column_fingerprints(df, "p_partkey", ["brand", "brand_again", "type"])


@QUERIES.add("d21_review_queue", """
SELECT region_id, section, count(DISTINCT period) AS n_observed, count(*) FILTER (flow > 0) AS n_passed, min(period) AS first_period, max(period) AS last_period, count(*) FILTER (flow > 0) < count(DISTINCT period) AS needs_review FROM receipts GROUP BY region_id, section""", "receipts")
def d21(s, d):
    return agg.review_queue(q_receipts(s, d), ["region_id", "section"], "period", F.col("flow") > 0)


@QUERIES.add("d22_missing_by_region", "SELECT region_id, count(*) AS n_missing FROM vintages WHERE value IS NULL GROUP BY region_id", "vintages")
def d22(s, d):
    return agg.missing_by(p.vintages(s, d), "region_id", "value")


@QUERIES.add("l34_price_audit", """
, h AS (SELECT fuel_grade, period, source_price, CASE WHEN datediff('month', lag(period) OVER w, period) = 1 THEN 100 * (source_price - lag(source_price) OVER w) / lag(source_price) OVER w END AS m FROM prices WINDOW w AS (PARTITION BY region_id, fuel_grade ORDER BY period))
SELECT fuel_grade, count(DISTINCT period) AS n_months, count(source_price) AS n_reported, count(*) - count(source_price) AS n_missing, count(m) AS n_compared, count(*) FILTER (abs(m) > 10 AND NOT abs(abs(m) - 10) <= 1e-10) AS n_flagged FROM h GROUP BY fuel_grade""", "prices")
def l34(s, d):
    return prices.audit_summary(prices.price_history(p.prices(s, d)))
