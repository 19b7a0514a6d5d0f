"""Queries E01 to E13 and F01 to F06."""

from __future__ import annotations

from ..operators import order, windows
from ..plans import prices
from .base import F, Registry, p, q_monthly, q_receipts

QUERIES = Registry()
K = ["region_id", "section"]


@QUERIES.add("e01_ytd_flows", """
SELECT region_id, section, period, ytd, CASE WHEN quarter(period) = 1 THEN ytd
  WHEN year(period) * 4 + quarter(period) - lag(year(period) * 4 + quarter(period)) OVER w = 1 THEN ytd - lag(ytd) OVER w END AS period_flow
FROM receipts WINDOW w AS (PARTITION BY region_id, section, year(period) ORDER BY period)""", "receipts")
def e01(s, d):
    return windows.ytd_flows(q_receipts(s, d), "ytd", K).select(*K, "period", "ytd", "period_flow")


@QUERIES.add("e01_ytd_flows_monthly", """
SELECT region_id, section, period, ytd, CASE WHEN month(period) = 1 THEN ytd
  WHEN month(period) - lag(month(period)) OVER w = 1 THEN ytd - lag(ytd) OVER w END AS period_flow
FROM monthly WINDOW w AS (PARTITION BY region_id, section, year(period) ORDER BY period)""", "monthly")
def e01_monthly(s, d):
    return windows.ytd_flows(q_monthly(s, d), "ytd", K).select(*K, "period", "ytd", "period_flow")


@QUERIES.add("e02_same_period_yoy", """
SELECT region_id, section, period, flow, CASE WHEN year(period) - lag(year(period)) OVER w = 1 AND lag(flow) OVER w > 0 THEN (flow / lag(flow) OVER w - 1) * 100 END AS yoy_pct
FROM receipts WINDOW w AS (PARTITION BY region_id, section, quarter(period) ORDER BY year(period))""", "receipts")
def e02(s, d):
    return windows.same_period_yoy(q_receipts(s, d), "flow", K).select(*K, "period", "flow", "yoy_pct")


@QUERIES.add("e03_adjacent_month_change", """
SELECT region_id, fuel_grade, period, source_price, CASE WHEN datediff('month', lag(period) OVER w, period) = 1 AND lag(source_price) OVER w <> 0
  THEN 100 * (source_price - lag(source_price) OVER w) / lag(source_price) OVER w END AS mom_change_pct
FROM prices WINDOW w AS (PARTITION BY region_id, fuel_grade ORDER BY period)""", "prices")
def e03(s, d):
    return windows.adjacent_change(p.prices(s, d), "source_price", ["region_id", "fuel_grade"])


@QUERIES.add("e04_segments", """
, b AS (SELECT region_id, section, min(period) AS a, max(period) AS z FROM monthly GROUP BY ALL),
c AS (SELECT region_id, section, CAST(unnest(generate_series(CAST(date_trunc('month', a) AS DATE), z, INTERVAL 1 MONTH)) AS DATE) AS m FROM b),
g AS (SELECT DISTINCT region_id, section, CAST(last_day(m) AS DATE) AS period FROM c),
j AS (SELECT g.region_id, g.section, g.period, flow, flow IS NOT NULL AS here FROM g LEFT JOIN monthly USING (region_id, section, period))
SELECT region_id, section, period, flow, CAST(sum(x) OVER (PARTITION BY region_id, section ORDER BY period) AS BIGINT) AS segment
FROM (SELECT *, CAST(here <> coalesce(lag(here) OVER (PARTITION BY region_id, section ORDER BY period), false) AS INT) AS x FROM j)""", "monthly")
def e04(s, d):
    from ..functions import calendar as cal

    df = q_monthly(s, d).select(*K, "period", "flow")
    months = df.groupBy(*K).agg(F.min("period").alias("a"), F.max("period").alias("b")).select(*K, F.explode(cal.calendar("a", "b")).alias("period"))
    return windows.segments(months.join(df, [*K, "period"], "left"), F.col("flow").isNotNull(), K)


@QUERIES.add("e05_latest_vintage", """
SELECT region_id, period, event_type, vintage, event_id, value FROM vintages
QUALIFY row_number() OVER (PARTITION BY region_id, period, event_type ORDER BY vintage DESC, event_id DESC) = 1""", "vintages")
def e05(s, d):
    return windows.latest_vintage(p.vintages(s, d), ["region_id", "period", "event_type"], "vintage", "event_id")


@QUERIES.add("e06_keep_last", """
, u AS (SELECT 0 AS r, event_type, region_id, event_id, value FROM vintages WHERE event_id % 2 = 0 UNION ALL SELECT 1, event_type, region_id, event_id, value FROM vintages WHERE event_id % 2 = 1)
SELECT event_type, region_id, event_id, value FROM u QUALIFY row_number() OVER (PARTITION BY event_type, region_id ORDER BY r DESC, event_id DESC) = 1""", "vintages")
def e06(s, d):
    v = p.vintages(s, d).select("event_type", "region_id", "event_id", "value")
    return windows.keep_last([v.filter("event_id % 2 = 0"), v.filter("event_id % 2 = 1")], ["event_type", "region_id"], "event_id")


@QUERIES.add("e07_group_complete", """
SELECT region_id, period, section, flow, count(flow) OVER w = 5 AS complete, CASE WHEN count(flow) OVER w >= 5 THEN CAST(sum(CAST(flow AS DECIMAL(18,2))) OVER w AS DOUBLE) END AS total
FROM receipts WINDOW w AS (PARTITION BY region_id, period)""", "receipts")
def e07(s, d):
    df = q_receipts(s, d).select("region_id", "period", "section", "flow").withColumn("m", F.col("flow").cast("decimal(18,2)"))
    df = windows.group_complete(df, "flow", ["region_id", "period"], 5, "complete")
    return df.withColumn("total", windows.group_total("m", ["region_id", "period"], 5).cast("double")).drop("m")


@QUERIES.add("e08_share_of_group", """
, t AS (SELECT *, CAST(flow AS DECIMAL(18,2)) AS m FROM receipts)
SELECT region_id, period, section, CASE WHEN sum(m) OVER w > 0 THEN flow / CAST(sum(m) OVER w AS DOUBLE) * 100 END AS share_pct FROM t WINDOW w AS (PARTITION BY region_id, period)""", "receipts")
def e08(s, d):
    df = q_receipts(s, d).withColumn("m", F.col("flow").cast("decimal(18,2)"))
    df = df.withColumn("total", windows.group_total("m", ["region_id", "period"]).cast("double"))
    return df.select("region_id", "period", "section", F.when(F.col("total") > 0, F.col("flow") / F.col("total") * 100).alias("share_pct"))


@QUERIES.add("e09_running_positions", """
SELECT region_id, section, period, CAST(sum(m) OVER w AS DOUBLE) AS to_value, CAST(sum(m) OVER w - m AS DOUBLE) AS from_value
FROM (SELECT *, CAST(flow AS DECIMAL(18,2)) AS m FROM receipts) WINDOW w AS (PARTITION BY region_id, section ORDER BY period)""", "receipts")
def e09(s, d):
    df = q_receipts(s, d).select(*K, "period", F.col("flow").cast("decimal(18,2)").alias("m"))
    out = windows.running_positions(df, "m", K, "period", F.lit(0).cast("decimal(18,2)"))
    return out.select(*K, "period", F.col("to_value").cast("double"), F.col("from_value").cast("double"))


@QUERIES.add("e10_latest_period", "SELECT region_id, section, period, max(period) OVER (PARTITION BY region_id) AS latest_period FROM receipts", "receipts")
def e10(s, d):
    return windows.latest_period(q_receipts(s, d), ["region_id"]).select(*K, "period", "latest_period")


@QUERIES.add("e11_last_three", """
SELECT region_id, section, period, growth_yoy_pct FROM production QUALIFY row_number() OVER (PARTITION BY region_id, section ORDER BY period DESC) <= 3""", "production")
def e11(s, d):
    return windows.last_n(p.production(s, d), K, 3).select(*K, "period", "growth_yoy_pct")


@QUERIES.add("e12_trailing_months", """
SELECT region_id, section, period, flow FROM (SELECT *, max(period) OVER (PARTITION BY region_id, section) AS l FROM monthly) WHERE period > CAST(l - INTERVAL 24 MONTH AS DATE)""", "monthly")
def e12(s, d):
    return windows.trailing_months(q_monthly(s, d), K, 24).select(*K, "period", "flow")


@QUERIES.add("e13_forward_fill", """
SELECT region_id, period, event_type, event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY region_id, event_type ORDER BY event_id) AS value FROM vintages""", "vintages")
def e13(s, d):
    return windows.forward_fill(p.vintages(s, d), "value", ["region_id", "event_type"], "event_id").select("region_id", "period", "event_type", "event_id", "value")


@QUERIES.add("f01_top_levels", "SELECT region_id, section, period, flow FROM receipts ORDER BY flow DESC NULLS LAST, region_id, section, period LIMIT 12", "receipts")
def f01(s, d):
    return order.top_n(q_receipts(s, d).select(*K, "period", "flow"), "flow", 12, *K, "period")


@QUERIES.add("f02_top_absolute_change", """
SELECT region_id, section, period, change FROM (SELECT region_id, section, period, flow - lag(flow) OVER (PARTITION BY region_id, section ORDER BY period) AS change FROM receipts)
ORDER BY abs(change) DESC NULLS LAST, region_id, section, period LIMIT 6""", "receipts")
def f02(s, d):
    from pyspark.sql import Window

    before = F.lag("flow").over(Window.partitionBy(*K).orderBy("period"))
    return order.top_n(q_receipts(s, d).select(*K, "period", (F.col("flow") - before).alias("change")), F.abs("change"), 6, *K, "period")


@QUERIES.add("f03_top_moves", """
, h AS (SELECT region_id, fuel_grade, period, source_price, lag(source_price) OVER w AS b, datediff('month', lag(period) OVER w, period) AS m FROM prices WINDOW w AS (PARTITION BY region_id, fuel_grade ORDER BY period))
SELECT region_id, fuel_grade, period, 100 * (source_price - b) / b AS mom_change_pct FROM h WHERE m = 1
ORDER BY abs(100 * (source_price - b) / b) DESC NULLS LAST, region_id, fuel_grade, period LIMIT 24""", "prices")
def f03(s, d):
    moves = prices.price_history(p.prices(s, d)).select("region_id", "fuel_grade", "period", "mom_change_pct")
    return order.top_n(moves, F.abs("mom_change_pct"), 24, "region_id", "fuel_grade", "period")


@QUERIES.add("f04_extreme_movers", """
SELECT region_id, period, arg_min(section, struct_pack(a := -flow, b := section)) AS largest_increase, max(flow) AS increase, arg_min(section, struct_pack(a := flow, b := section)) AS largest_decrease, min(flow) AS decrease
FROM receipts WHERE flow IS NOT NULL GROUP BY ALL""", "receipts")
def f04(s, d):
    return order.extreme_movers(q_receipts(s, d), ["region_id", "period"], "flow", "section")


@QUERIES.add("f05_domain_order", """
SELECT region_id, period, section, CASE section WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 3 END AS domain_order FROM receipts""", "receipts")
def f05(s, d):
    return order.ordered_by_domain(q_receipts(s, d), "section", ["MACHINERY", "BUILDING", "FURNITURE"]).select("region_id", "period", "section", "domain_order")


@QUERIES.add("f06_stable_order", "SELECT region_id, section, period, flow FROM receipts", "receipts")
def f06(s, d):
    return order.stable_order(q_receipts(s, d).select(*K, "period", "flow"), ["period", "region_id", "section"])
