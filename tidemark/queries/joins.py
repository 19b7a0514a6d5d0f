"""Queries C01 to C20 and G01 to G06."""

from __future__ import annotations

from ..functions import text
from ..operators import joins, sets, windows
from ..plans import production
from .base import F, Registry, once, p, q_monthly, q_receipts, table

QUERIES = Registry()
K = ["region_id", "section"]


@QUERIES.add("c01_reconcile_join", """
, a AS (SELECT region_id, period, CAST(sum(CAST(flow AS DECIMAL(18,2))) AS DOUBLE) AS total_a FROM receipts GROUP BY ALL),
b AS (SELECT region_id, period, actual_ytd_rub AS total_b FROM revenue WHERE revenue_code = 'TOTAL_REVENUE')
SELECT region_id, period, total_a, total_b, CASE WHEN total_b <> 0 THEN (total_a - total_b) / total_b * 100 END AS gap_pct,
  CASE WHEN abs(CASE WHEN total_b <> 0 THEN (total_a - total_b) / total_b * 100 END) > 5 THEN 'warning' WHEN total_b = 0 THEN 'not_assessable' ELSE 'passed' END AS status
FROM a JOIN b USING (region_id, period)""", "receipts revenue")
def c01(s, d):
    from ..operators.quality import reconcile

    a = q_receipts(s, d).withColumn("flow", F.col("flow").cast("decimal(18,2)"))
    b = p.revenue(s, d).filter(F.col("revenue_code") == p.TOTAL)
    out = reconcile(a, b, ["region_id", "period"], "flow", "actual_ytd_rub")
    total = F.col("total_a").cast("double")
    gap = F.when(F.col("total_b") != 0, (total - F.col("total_b")) / F.col("total_b") * 100)
    return out.withColumns({"total_a": total, "gap_pct": gap})


@QUERIES.add("c02_year_shift_join", """
SELECT a.region_id, a.section, a.period, a.flow, b.flow AS prior_flow FROM receipts a
LEFT JOIN receipts b ON a.region_id = b.region_id AND a.section = b.section AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE)""", "receipts")
def c02(s, d):
    return joins.calendar_join(q_receipts(s, d).select(*K, "period", "flow"), K, ["flow"], "prior_")


@QUERIES.add("c03_quarter_shift_join", """
SELECT a.region_id, a.section, a.period, a.flow, b.flow AS prior_flow FROM receipts a
LEFT JOIN receipts b ON a.region_id = b.region_id AND a.section = b.section AND a.period = CAST(last_day(b.period + INTERVAL 3 MONTH) AS DATE)""", "receipts")
def c03(s, d):
    return joins.calendar_join(q_receipts(s, d).select(*K, "period", "flow"), K, ["flow"], "prior_", 3, snap="month_end")


@QUERIES.add("c04_first_quarter_join", """
SELECT a.region_id, a.section, a.period, a.ytd, b.period AS start_period, b.ytd AS start_ytd FROM receipts a
LEFT JOIN receipts b ON a.region_id = b.region_id AND a.section = b.section AND month(b.period) = 3 AND a.period = CAST(last_day(b.period + INTERVAL 3 MONTH) AS DATE)""", "receipts")
def c04(s, d):
    return joins.first_quarter_join(q_receipts(s, d).select(*K, "period", "ytd"), K, ["ytd"])


@QUERIES.add("c05_month_shift_join", """
SELECT a.region_id, a.fuel_grade, a.period, a.source_price, b.source_price AS before_source_price, b.period AS before_period, CAST(a.period - INTERVAL 1 MONTH AS DATE) AS expected_period FROM prices a
LEFT JOIN prices b ON a.region_id = b.region_id AND a.fuel_grade = b.fuel_grade AND a.period = CAST(b.period + INTERVAL 1 MONTH AS DATE)""", "prices")
def c05(s, d):
    out = joins.calendar_join(p.prices(s, d), ["region_id", "fuel_grade"], ["source_price"], "before_", 1, keep_period=True)
    return out.withColumn("expected_period", F.add_months("period", -1))


@QUERIES.add("c06_grid_join", """
, g AS (SELECT DISTINCT region_id, period, unnest(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']) AS section FROM monthly)
SELECT region_id, period, section, flow FROM g LEFT JOIN monthly USING (region_id, period, section)""", "monthly")
def c06(s, d):
    df = q_monthly(s, d).select("region_id", "period", "section", "flow")
    return joins.grid_join(df, df, ["region_id", "period"], "section", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@QUERIES.add("c07_parity_join", """
, a AS (SELECT region_id, section, period, flow FROM receipts WHERE quarter(period) <> 2), b AS (SELECT region_id, section, period, CASE WHEN region_id = '7' THEN flow + 1 ELSE flow END AS flow FROM receipts WHERE quarter(period) <> 3)
SELECT region_id, section, period, a.flow AS a_flow, b.flow AS b_flow, CASE WHEN b.flow IS NULL THEN 'only_a' WHEN a.flow IS NULL THEN 'only_b' WHEN a.flow = b.flow THEN 'same' ELSE 'different' END AS verdict
FROM a FULL JOIN b USING (region_id, section, period)""", "receipts")
def c07(s, d):
    df = q_receipts(s, d).select(*K, "period", "flow")
    b = df.filter("quarter(period) <> 3").withColumn("flow", F.when(F.col("region_id") == "7", F.col("flow") + 1).otherwise(F.col("flow")))
    return joins.parity_join(df.filter("quarter(period) <> 2"), b, [*K, "period"], ["flow"])


@QUERIES.add("c08_outer_labelled", """
, a AS (SELECT section, count(*) AS n_a, CASE WHEN section < 'D' THEN 'Section ' || section END AS label FROM production WHERE section IN ('B','C','D') GROUP BY ALL), b AS (SELECT section, count(*) AS n_b FROM cumulative WHERE section IN ('C','D','E') GROUP BY ALL)
SELECT section, n_a, n_b, coalesce(label, CASE section WHEN 'D' THEN 'Energy' WHEN 'E' THEN 'Water' END) AS label FROM a FULL JOIN b USING (section)""", "production cumulative")
def c08(s, d):
    a = p.production(s, d).filter("section IN ('B', 'C', 'D')").groupBy("section").agg(F.count(F.lit(1)).alias("n_a"))
    a = a.withColumn("label", F.when(F.col("section") < "D", F.concat(F.lit("Section "), "section")))
    b = p.production(s, d, True).filter("section IN ('C', 'D', 'E')").groupBy("section").agg(F.count(F.lit(1)).alias("n_b"))
    return joins.outer_labelled(a, b, "section", "label", {"D": "Energy", "E": "Water"})


@QUERIES.add("c09_in_key_set", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def c09(s, d):
    keys = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return joins.in_key_set(table(s, d, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey")


@QUERIES.add("c10_orphans", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3)")
def c10(s, d):
    known = table(s, d, "supplier").filter("s_suppkey % 10 <> 3")
    return joins.orphans(table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), known, "l_suppkey", "s_suppkey")


@QUERIES.add("c11_checked_join", "SELECT o_custkey, o_orderkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def c11(s, d):
    customers = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return joins.checked_join(table(s, d, "orders").select("o_custkey", "o_orderkey"), customers, ["o_custkey"], validate="many_to_one")


@QUERIES.add("c12_dimension_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def c12(s, d):
    nations = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(s, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@QUERIES.add("c13_either_key_lookup", """
SELECT s_suppkey, coalesce(a.n_name, b.n_name) AS n_name FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS code, s_nationkey % 25 AS alt FROM supplier)
LEFT JOIN nation a ON code = a.n_nationkey LEFT JOIN nation b ON alt = b.n_nationkey""")
def c13(s, d):
    df = table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("code"), (F.col("s_nationkey") % 25).alias("alt"))
    return joins.either_key_lookup(df, table(s, d, "nation"), (F.col("code"), "n_nationkey"), (F.col("alt"), "n_nationkey"), "n_name").select("s_suppkey", "n_name")


@QUERIES.add("c14_status_star", """
, l AS (SELECT region_id, max(period) AS period FROM fiscal GROUP BY ALL), r AS (SELECT region_id, period, actual_ytd_rub AS transfers_rub FROM revenue WHERE revenue_code = '202'),
b AS (SELECT region_id, period, actual_ytd_rub AS budget_balance_rub FROM fiscal WHERE metric_code = 'budget_balance'), m AS (SELECT region_id, period, index_value AS production_index FROM cumulative WHERE section = 'TOTAL')
SELECT region_id, period, transfers_rub, budget_balance_rub, production_index FROM l LEFT JOIN r USING (region_id, period) LEFT JOIN b USING (region_id, period) LEFT JOIN m USING (region_id, period)""", "fiscal cumulative")
def c14(s, d):
    """A row a region at its latest period, each part joined one to one."""
    fiscal = once(p.fiscal(s, d), "fiscal")
    moved = p.revenue(s, d).filter(F.col("revenue_code") == p.TRANSFERS).select("region_id", "period", F.col("actual_ytd_rub").alias("transfers_rub"))
    balance = fiscal.filter("metric_code = 'budget_balance'").select("region_id", "period", F.col("actual_ytd_rub").alias("budget_balance_rub"))
    made = p.production(s, d, True).filter("section = 'TOTAL'").select("region_id", "period", F.col("index_value").alias("production_index"))
    return joins.star_join(fiscal.groupBy("region_id").agg(F.max("period").alias("period")), [moved, balance, made], ["region_id", "period"])


@QUERIES.add("c15_lineage_agreement", """
SELECT a.region_id, a.period, a.revenue_code, a.actual_ytd_rub, b.v AS lineage_actual_ytd_rub, coalesce(abs(a.actual_ytd_rub - b.v) <= 0.02, false) AS agrees FROM revenue a
LEFT JOIN (SELECT region_id, period, revenue_code, CASE WHEN quarter(period) = 2 THEN actual_ytd_rub + 1 ELSE actual_ytd_rub END AS v FROM revenue WHERE region_id <> '3') b USING (region_id, period, revenue_code)""", "revenue")
def c15(s, d):
    r = p.revenue(s, d).select("region_id", "period", "revenue_code", "actual_ytd_rub")
    other = r.filter("region_id <> '3'").withColumn("actual_ytd_rub", F.when(F.quarter("period") == 2, F.col("actual_ytd_rub") + 1).otherwise(F.col("actual_ytd_rub")))
    return joins.lineage_agreement(r, other, ["region_id", "period", "revenue_code"], "actual_ytd_rub")


@QUERIES.add("c16_vintage_overlap", """
, n AS (SELECT *, count(*) OVER w AS n, last_value(value) OVER r AS sv, last_value(event_id) OVER r AS se FROM vintages
  WINDOW w AS (PARTITION BY region_id, period, event_type), r AS (PARTITION BY region_id, period, event_type ORDER BY vintage, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT region_id, period, event_type, event_id, value, sv AS selected_value, se AS selected_event_id, event_id = se AS is_selected, value - sv AS difference,
  CASE WHEN value - sv = 0 THEN 'unchanged' WHEN value IS NOT NULL AND sv IS NOT NULL THEN 'revised' WHEN value IS NOT NULL THEN 'latest_missing' WHEN sv IS NOT NULL THEN 'original_missing' ELSE 'both_missing' END AS comparison_status
FROM n WHERE n > 1""", "vintages")
def c16(s, d):
    v = p.vintages(s, d)
    grain = ["region_id", "period", "event_type"]
    chosen = windows.latest_vintage(v, grain, "vintage", "event_id")
    return joins.vintage_overlap(v.drop("vintage"), chosen, grain, "value", "event_id")


@QUERIES.add("c17_two_vintages", """
, a AS (SELECT * FROM vintages QUALIFY row_number() OVER (PARTITION BY region_id, period, event_type ORDER BY vintage, event_id) = 1), b AS (SELECT * FROM vintages QUALIFY row_number() OVER (PARTITION BY region_id, period, event_type ORDER BY vintage DESC, event_id DESC) = 1)
SELECT region_id, period, event_type, a.value AS older, b.value AS newer, b.value - a.value AS difference, (a.value IS NULL) <> (b.value IS NULL) OR coalesce(abs(b.value - a.value) > 1e-9, false) AS changed FROM a JOIN b USING (region_id, period, event_type)""", "vintages")
def c17(s, d):
    from pyspark.sql import Window

    v, grain = p.vintages(s, d), ["region_id", "period", "event_type"]
    first = v.withColumn("r", F.row_number().over(Window.partitionBy(*grain).orderBy("vintage", "event_id"))).filter("r = 1")
    return joins.two_vintages(first, windows.latest_vintage(v, grain, "vintage", "event_id"), grain, "value")


@QUERIES.add("c18_concordance", """
, a AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, replace(replace(lower(n_name), ' ', ''), '-', '') AS k FROM nation WHERE n_nationkey % 5 <> 0), b AS (SELECT CAST(n_nationkey + 100 AS VARCHAR) AS id, replace(replace(lower(n_name), ' ', ''), '-', '') AS k FROM nation WHERE n_nationkey % 4 <> 0), c AS (SELECT CAST(n_nationkey + 200 AS VARCHAR) AS id, replace(replace(lower(n_name), ' ', ''), '-', '') AS k FROM nation)
SELECT k, a.id AS a_id, b.id AS b_id, c.id AS c_id, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL AND c.id IS NOT NULL THEN 'matched' ELSE 'only_' || CASE WHEN a.id IS NULL THEN '' ELSE 'a' END || CASE WHEN b.id IS NULL THEN '' ELSE 'b' END || CASE WHEN c.id IS NULL THEN '' ELSE 'c' END END AS status
FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""".replace("\n, a AS", "\nWITH a AS", 1))
def c18(s, d):
    n = table(s, d, "nation")
    side = lambda f, add: n.filter(f).select((F.col("n_nationkey") + add).cast("string").alias("id"), text.name_key("n_name").alias("k"))
    return joins.concordance(side("n_nationkey % 5 <> 0", 0), side("n_nationkey % 4 <> 0", 100), side("true", 200), "k")


@QUERIES.add("c19_borrowed_context", """
, f AS (SELECT region_id, period, section, region_id || ':' || CAST(period AS VARCHAR) AS source_id FROM monthly), r AS (SELECT region_id, period, min(source_id) AS release_source_id FROM f GROUP BY ALL HAVING count(DISTINCT source_id) = 1),
g AS (SELECT DISTINCT region_id, period, unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS section FROM f)
SELECT region_id, period, section, source_id, release_source_id FROM g LEFT JOIN f USING (region_id, period, section) LEFT JOIN r USING (region_id, period)""", "monthly")
def c19(s, d):
    f = q_monthly(s, d).select("region_id", "period", "section", F.concat_ws(":", "region_id", F.col("period").cast("string")).alias("source_id"))
    grid = joins.grid_join(f, f, ["region_id", "period"], "section", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    return joins.borrowed_context(grid, f, ["region_id", "period"], ["source_id"])


@QUERIES.add("c20_cutoff_snapshot", """
, x AS (SELECT region_id, CASE section WHEN 'AUTOMOBILE' THEN 'B' WHEN 'BUILDING' THEN 'C' WHEN 'FURNITURE' THEN 'D' WHEN 'HOUSEHOLD' THEN 'E' ELSE 'X' END AS section, period, flow FROM monthly),
m AS (SELECT *, max(period) OVER (PARTITION BY region_id) AS l FROM x), n AS (SELECT * FROM m WHERE period = l),
t AS (SELECT n.region_id, n.period, n.section, n.flow AS pit_current, n.flow - b.flow AS pit_change, CASE WHEN b.flow > 0 THEN (n.flow / b.flow - 1) * 100 END AS pit_yoy_pct
  FROM n LEFT JOIN x b ON n.region_id = b.region_id AND n.section = b.section AND n.period = CAST(b.period + INTERVAL 12 MONTH AS DATE) WHERE n.section <> 'X'),
i AS (SELECT region_id, period, section, index_value FROM production WHERE section IN ('B', 'C', 'D', 'E') AND index_value IS NOT NULL AND (region_id, period) IN (SELECT (region_id, period) FROM n))
SELECT region_id, period, section, pit_current, pit_change, pit_yoy_pct, index_value FROM t FULL JOIN i USING (region_id, period, section)""", "monthly production")
def c20(s, d):
    return production.cutoff_snapshot(_as_sections(q_monthly(s, d)), p.production(s, d))


def _as_sections(receipts):
    codes = {"AUTOMOBILE": "B", "BUILDING": "C", "FURNITURE": "D", "HOUSEHOLD": "E"}
    return receipts.withColumn("section", F.coalesce(*[F.when(F.col("section") == k, v) for k, v in codes.items()], F.lit("X")))


@QUERIES.add("g01_union_sources", """
SELECT 'supplier' AS origin, s_suppkey AS source_id, s_name AS title, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT 'customer', c_custkey, NULL, c_mktsegment FROM customer""")
def g01(s, d):
    a = table(s, d, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("title"))
    b = table(s, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("segment"))
    return sets.union_sources(a, b)


@QUERIES.add("g02_key_population", "SELECT DISTINCT region_id, period FROM monthly", "monthly")
def g02(s, d):
    return sets.key_population(q_monthly(s, d), ["region_id", "period"])


@QUERIES.add("g03_domain_offenders", "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def g03(s, d):
    return sets.domain_offenders(table(s, d, "events"), "event_type", ["click", "view"])


@QUERIES.add("g04_same_population", """
SELECT *, n_only_a = 0 AND n_only_b = 0 AS same FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey % 7 <> 2 EXCEPT SELECT s_suppkey FROM supplier)) AS n_only_a,
  (SELECT count(*) FROM (SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_suppkey % 7 <> 2)) AS n_only_b)""")
def g04(s, d):
    a = table(s, d, "lineitem").filter("l_suppkey % 7 <> 2").select(F.col("l_suppkey").alias("k"))
    return sets.same_population(a, table(s, d, "supplier").select(F.col("s_suppkey").alias("k")), "k")


@QUERIES.add("g05_common_keys", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def g05(s, d):
    return sets.common_keys(table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@QUERIES.add("g06_evidence_union", """
SELECT 'industrial_production' AS dataset, region_id, period, section AS indicator, index_value AS value, 'index' AS units, 'monthly' AS amount_basis FROM production
UNION ALL SELECT 'budget_revenue', region_id, period, revenue_code, actual_ytd_rub, 'RUB', 'YTD' FROM revenue UNION ALL SELECT 'industry_pit', region_id, period, section, flow, 'RUB', 'period_flow' FROM receipts""", "production revenue receipts")
def g06(s, d):
    return sets.evidence_union(
        ("industrial_production", p.production(s, d), "section", "index_value", "index", "monthly"),
        ("budget_revenue", p.revenue(s, d), "revenue_code", "actual_ytd_rub", "RUB", "YTD"),
        ("industry_pit", q_receipts(s, d), "section", "flow", "RUB", "period_flow"),
    )
