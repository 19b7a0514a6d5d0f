"""Driver tables as observation panels, each with the same definition in SQL.

Money is summed as decimals and leaves a panel as doubles, so that both engines start from equal numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import SCOPE
from ..functions import calendar as cal
from ..operators.joins import calendar_join

#: A panel's own revenue codes and what they hold, as conditions on a line item.
TOTAL, OWN, PIT, CIT, OTHER, TRANSFERS = "TOTAL_REVENUE", "100", "101_PIT", "101_CIT", "200", "202"
REVENUE_CODES = {
    TOTAL: "true",
    OWN: "l_returnflag IN ('A', 'N')",
    PIT: "l_returnflag = 'A'",
    CIT: "l_returnflag = 'N' AND l_linestatus = 'F'",
    OTHER: "l_returnflag = 'R'",
    TRANSFERS: "l_returnflag = 'R' AND l_linestatus = 'F'",
}
FUNCTIONS = [f"{i:02d}00" for i in range(1, 15)]
GRADES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SECTION_SIZES = {"B": (1, 12), "C": (13, 25), "D": (26, 38), "E": (39, 50)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(expression: str):
    return F.expr(f"cast({expression} AS decimal(18,2))")


def _running(df: DataFrame, keys: list[str], value: str, output: str) -> DataFrame:
    year = Window.partitionBy(*keys, F.year("period")).orderBy("period")
    return df.withColumn(output, F.sum(value).over(year.rowsBetween(Window.unboundedPreceding, 0)).cast("double"))


def receipts(spark: SparkSession, sf_dir: str, frequency: str = "quarterly") -> DataFrame:
    """region_id, section, period, frequency, flow, ytd: orders by nation and segment; orders in state P count negative."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    end = cal.quarter_end(F.to_date("o_orderdate")) if frequency == "quarterly" else F.last_day("o_orderdate")
    signed = F.when(F.col("o_orderstatus") == "P", -_money("o_totalprice")).otherwise(_money("o_totalprice"))
    flows = (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy(F.col("c_nationkey").cast("string").alias("region_id"), F.col("c_mktsegment").alias("section"), end.alias("period"))
        .agg(F.sum(signed).alias("_flow"))
    )
    out = _running(flows, ["region_id", "section"], "_flow", "ytd")
    return out.select("region_id", "section", "period", F.lit(frequency).alias("frequency"), F.col("_flow").cast("double").alias("flow"), "ytd")


def _receipts_sql(frequency: str) -> str:
    end = "last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)" if frequency == "quarterly" else "last_day(o_orderdate)"
    return f"""
SELECT region_id, section, period, '{frequency}' AS frequency, CAST(f AS DOUBLE) AS flow,
  CAST(sum(f) OVER (PARTITION BY region_id, section, year(period) ORDER BY period) AS DOUBLE) AS ytd
FROM (SELECT CAST(c_nationkey AS VARCHAR) AS region_id, c_mktsegment AS section, CAST({end} AS DATE) AS period,
  sum(CASE WHEN o_orderstatus = 'P' THEN -CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END) AS f
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def _line_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    keys = [F.col("c_nationkey").cast("string").alias("region_id"), cal.quarter_end(F.to_date("o_orderdate")).alias("period")]
    # All codes in one aggregation: a line is summed once for each code that holds it, without being copied.
    sums = [F.sum(F.when(F.expr(c), _money("l_extendedprice"))).alias(k) for k, c in REVENUE_CODES.items()]
    return joined.groupBy(*keys).agg(*sums)


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, period, budget_level, revenue_code, actual_ytd_rub, plans, plan_components_reconciled: nested revenue codes, year to date."""
    long = _line_revenue(spark, sf_dir).unpivot(["region_id", "period"], [F.col(f"`{k}`").cast("decimal(28,2)").alias(k) for k in REVENUE_CODES], "revenue_code", "_flow").filter("_flow IS NOT NULL")
    out = _running(long, ["region_id", "revenue_code"], "_flow", "actual_ytd_rub")
    out = out.filter(~((F.col("revenue_code") == TRANSFERS) & ((F.col("region_id").cast("int") + F.quarter("period")) % 7 == 0)))
    return out.select(
        "region_id", "period", F.lit(SCOPE).alias("budget_level"), "revenue_code", "actual_ytd_rub", (F.col("actual_ytd_rub") * 2).alias("approved_plan_rub"),
        F.when(F.quarter("period") > 2, F.col("actual_ytd_rub") * 4).alias("revised_plan_rub"), ((F.col("region_id").cast("int") + F.year("period")) % 5 != 0).alias("plan_components_reconciled"),
    )


_REVENUE_SQL = f"""
SELECT region_id, period, '{SCOPE}' AS budget_level, revenue_code, actual_ytd_rub, actual_ytd_rub * 2 AS approved_plan_rub,
  CASE WHEN quarter(period) > 2 THEN actual_ytd_rub * 4 END AS revised_plan_rub, (CAST(region_id AS INT) + year(period)) % 5 <> 0 AS plan_components_reconciled
FROM (SELECT region_id, period, revenue_code, CAST(sum(f) OVER (PARTITION BY region_id, revenue_code, year(period) ORDER BY period) AS DOUBLE) AS actual_ytd_rub
  FROM (SELECT CAST(c_nationkey AS VARCHAR) AS region_id, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS period, revenue_code,
      sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS f
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN (VALUES {", ".join(f"('{k}')" for k in REVENUE_CODES)}) v(revenue_code) ON CASE revenue_code {" ".join(f"WHEN '{k}' THEN {c}" for k, c in REVENUE_CODES.items())} END
    GROUP BY ALL))
WHERE NOT (revenue_code = '{TRANSFERS}' AND (CAST(region_id AS INT) + quarter(period)) % 7 = 0)"""


def fiscal(spark: SparkSession, sf_dir: str, revenues: DataFrame | None = None) -> DataFrame:
    """region_id, period, budget_level, kind, metric_code, actual_ytd_rub: revenue, 14 spending functions, balance, financing.

    revenues: the revenue panel, where a query has it already."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    code = F.concat(F.lpad(((F.col("p_size") - 1) % 14 + 1).cast("string"), 2, "0"), F.lit("00"))
    flows = (
        lines.join(parts, lines.l_partkey == parts.p_partkey).join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .groupBy(F.col("s_nationkey").cast("string").alias("region_id"), cal.quarter_end(F.to_date("l_shipdate")).alias("period"), code.alias("metric_code"))
        .agg(F.sum(_money("l_extendedprice")).alias("_flow"))
    )
    # One pass over the lines: a quarter's functions stay together until its total is there.
    own = F.struct(F.lit("expenditure_function").alias("kind"), "metric_code", "_flow", F.lit(None).cast("double").alias("value"))
    quarters = flows.groupBy("region_id", "period").agg(F.sum("_flow").alias("_flow"), F.collect_list(own).alias("_functions"))
    totals = _running(quarters, ["region_id"], "_flow", "spending").drop("_flow")
    income = (revenues if revenues is not None else revenue(spark, sf_dir)).filter(F.col("revenue_code") == TOTAL).select("region_id", "period", F.col("actual_ytd_rub").alias("income"))
    both = income.join(totals, ["region_id", "period"], "full_outer").withColumn("balance", F.round(F.col("income") - F.col("spending"), 2))
    rows = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(m).alias("metric_code"), F.lit(None).cast(flows.schema["_flow"].dataType).alias("_flow"), v.alias("value"))
        for k, m, v in (
            ("summary", "revenue_total", F.col("income")), ("summary", "expenditure_total", F.col("spending")),
            ("summary", "budget_balance", F.col("balance")), ("financing_component", "financing_total", -F.col("balance")),
        )
    ])
    each = both.select("region_id", "period", F.explode(F.concat(F.coalesce("_functions", F.array().cast(totals.schema["_functions"].dataType)), rows)).alias("r")).select("region_id", "period", "r.*")
    out = _running(each, ["region_id", "kind", "metric_code"], "_flow", "_ytd").withColumn("actual_ytd_rub", F.when(F.col("kind") == "expenditure_function", F.col("_ytd")).otherwise(F.col("value")))
    return out.filter("actual_ytd_rub IS NOT NULL").select("region_id", "period", "kind", "metric_code", "actual_ytd_rub", F.lit(SCOPE).alias("budget_level"))


_FISCAL_SQL = f"""
SELECT *, '{SCOPE}' AS budget_level FROM (
  SELECT region_id, period, 'expenditure_function' AS kind, metric_code, CAST(sum(f) OVER (PARTITION BY region_id, metric_code, year(period) ORDER BY period) AS DOUBLE) AS actual_ytd_rub FROM spent
  UNION ALL SELECT region_id, period, kind, metric_code, v FROM (
    SELECT region_id, period, unnest(['summary', 'summary', 'summary', 'financing_component']) AS kind, unnest(['revenue_total', 'expenditure_total', 'budget_balance', 'financing_total']) AS metric_code,
      unnest([income, spending, round(income - spending, 2), -round(income - spending, 2)]) AS v
    FROM (SELECT region_id, period, actual_ytd_rub AS income FROM revenue WHERE revenue_code = '{TOTAL}')
    FULL JOIN (SELECT region_id, period, CAST(sum(f) OVER (PARTITION BY region_id, year(period) ORDER BY period) AS DOUBLE) AS spending
      FROM (SELECT region_id, period, sum(f) AS f FROM spent GROUP BY ALL)) USING (region_id, period)) WHERE v IS NOT NULL)"""
_SPENT_SQL = """
SELECT CAST(s_nationkey AS VARCHAR) AS region_id, CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS period,
  lpad(CAST((p_size - 1) % 14 + 1 AS VARCHAR), 2, '0') || '00' AS metric_code, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS f
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""


def production(spark: SparkSession, sf_dir: str, cumulative: bool = False) -> DataFrame:
    """region_id, section (TOTAL, B to E), period (month end), index_value, growth_yoy_pct: quantity over the year before, a month's or year to date."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    section = F.coalesce(*[F.when(F.col("p_size").between(a, b), k) for k, (a, b) in SECTION_SIZES.items()])
    base = (
        lines.join(parts, lines.l_partkey == parts.p_partkey).join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .groupBy(F.col("s_nationkey").cast("string").alias("region_id"), section.alias("section"), F.last_day("l_shipdate").alias("period"))
        .agg(F.sum(_money("l_quantity")).alias("_flow"))
    )
    both = F.explode(F.array("section", F.lit("TOTAL"))).alias("section")
    flows = base.select("region_id", both, "period", "_flow").groupBy("region_id", "section", "period").agg(F.sum("_flow").alias("_flow"))
    level = _running(flows, ["region_id", "section"], "_flow", "level") if cumulative else flows.withColumn("level", F.col("_flow").cast("double"))
    known = calendar_join(level, ["region_id", "section"], ["level"], "prior_", snap="month_end", keep_period=True).filter("prior_period IS NOT NULL")
    index = F.when(F.col("prior_level") > 0, 100 * F.col("level") / F.col("prior_level"))
    return known.select("region_id", "section", "period", index.alias("index_value"), (index - 100).alias("growth_yoy_pct"))


_MADE_SQL = f"""
SELECT region_id, section, period, sum(f) AS f FROM (
  SELECT region_id, unnest([section, 'TOTAL']) AS section, period, f FROM (
    SELECT CAST(s_nationkey AS VARCHAR) AS region_id, CASE {" ".join(f"WHEN p_size BETWEEN {a} AND {b} THEN '{k}'" for k, (a, b) in SECTION_SIZES.items())} END AS section,
      CAST(last_day(l_shipdate) AS DATE) AS period, CAST(l_quantity AS DECIMAL(18,2)) AS f
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)) GROUP BY ALL"""


def _production_sql(cumulative: bool) -> str:
    level = "CAST(sum(f) OVER (PARTITION BY region_id, section, year(period) ORDER BY period) AS DOUBLE)" if cumulative else "CAST(f AS DOUBLE)"
    return f"""
SELECT region_id, section, period, CASE WHEN before > 0 THEN 100 * level / before END AS index_value, CASE WHEN before > 0 THEN 100 * level / before END - 100 AS growth_yoy_pct
FROM (SELECT region_id, section, period, {level} AS level FROM made)
JOIN (SELECT region_id, section, CAST(last_day(period + INTERVAL 12 MONTH) AS DATE) AS period, {level} AS before FROM made) USING (region_id, section, period)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, period (month start), fuel_grade, source_price: mean order value by nation and priority, in thousands."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy(F.col("c_nationkey").cast("string").alias("region_id"), cal.month_start("o_orderdate").alias("period"), F.col("o_orderpriority").alias("fuel_grade"))
        .agg((F.sum(_money("o_totalprice")).cast("double") / F.count(F.lit(1))).alias("source_price"))
    )


_PRICES_SQL = """
SELECT CAST(c_nationkey AS VARCHAR) AS region_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderpriority AS fuel_grade,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS source_price
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day, event_type, vintage, event_id, value: events as releases; every seventh k is a missing value."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.select(F.col("user_id").cast("string").alias("region_id"), F.to_date("ts").alias("period"), "event_type", F.col("ts").alias("vintage"), "event_id", F.when(k % 7 != 0, F.col("value")).alias("value"))


_VINTAGES_SQL = """
SELECT CAST(user_id AS VARCHAR) AS region_id, CAST(ts AS DATE) AS period, event_type, ts AS vintage, event_id,
  CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 <> 0 THEN value END AS value FROM events"""

#: Panels by name, for WITH clauses.
PANELS = {
    "receipts": _receipts_sql("quarterly"), "monthly": _receipts_sql("monthly"), "revenue": _REVENUE_SQL, "spent": _SPENT_SQL, "fiscal": _FISCAL_SQL, "made": _MADE_SQL,
    "production": _production_sql(False), "cumulative": _production_sql(True), "prices": _PRICES_SQL, "vintages": _VINTAGES_SQL,
}
_NEEDS = {"fiscal": ["revenue", "spent"], "production": ["made"], "cumulative": ["made"]}


def with_panels(names: str, body: str) -> str:
    """`body` after the WITH clauses of these panels; the body may go on with further ones after a leading comma."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in [*_NEEDS.get(n, []), n] if x not in wanted]
    clauses = ",\n".join(f"{n} AS MATERIALIZED ({PANELS[n]})" for n in wanted)
    return f"WITH {clauses}\n{body}"
