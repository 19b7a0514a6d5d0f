"""Hand-worked panels: flows, comparisons, bridges, components, prices, alignment, vintages."""

from datetime import date

import pytest
from pyspark.errors import PySparkException

from tidemark.contracts import SCOPE
from tidemark.functions import numbers, text
from tidemark.operators import aggregates, filters, joins, quality, windows
from tidemark.plans import fiscal, overview, prices, production
from tidemark.plans.panels import CIT, FUNCTIONS, OTHER, OWN, PIT, TOTAL, TRANSFERS

Q1_23, H1_23, Q1_24, H1_24 = date(2023, 3, 31), date(2023, 6, 30), date(2024, 3, 31), date(2024, 6, 30)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def fiscal_panel(spark, drop=()):
    rows = []
    for region, k in (("A", 1.0), ("B", 2.0)):
        for p, rev, exp in ((Q1_23, 100, 80), (H1_23, 180, 160), (Q1_24, 120, 100), (H1_24, 210, 200)):
            if (region, p) in drop:
                continue
            rows += [(region, p, "summary", c, k * v) for c, v in (("revenue_total", rev), ("expenditure_total", exp), ("budget_balance", rev - exp))]
            rows.append((region, p, "financing_component", "financing_total", -k * (rev - exp)))
            rows += [(region, p, "expenditure_function", c, k * exp * (0.35 if i == 0 else 0.05)) for i, c in enumerate(FUNCTIONS)]
    return frame(spark, [(*r[:2], SCOPE, *r[2:]) for r in rows], "region_id string, period date, budget_level string, kind string, metric_code string, actual_ytd_rub double")


def revenue_panel(spark, skip=None):
    table = {Q1_23: (100, 60, 30, 20, 35), H1_23: (220, 150, 80, 40, 60), Q1_24: (120, 80, 45, 25, 30), H1_24: (250, 180, 100, 50, 65)}
    rows = []
    for p, (total, own, pit, cit, transfers) in table.items():
        for code, v in ((TOTAL, total), (OWN, own), (PIT, pit), (CIT, cit), (TRANSFERS, transfers), (OTHER, total - own)):
            if (p, code) != skip:
                rows.append(("A", p, SCOPE, code, float(v), 2.0 * v, None, True))
    return frame(spark, rows, "region_id string, period date, budget_level string, revenue_code string, actual_ytd_rub double, approved_plan_rub double, revised_plan_rub double, plan_components_reconciled boolean")


def ytd(spark, rows, frequency="quarterly"):
    return frame(spark, [("r", date.fromisoformat(p), frequency, v) for p, v in rows], "region_id string, period date, frequency string, ytd double")


def by_period(df, column):
    return [r[column] for r in df.orderBy("period").collect()]


def test_ytd_flows(spark):
    df = ytd(spark, [("2025-03-31", 100.0), ("2025-06-30", 150.0), ("2025-09-30", 140.0), ("2026-03-31", 110.0)])
    assert by_period(windows.ytd_flows(df, "ytd", ["region_id"]), "period_flow") == [100, 50, -10, 110]
    assert by_period(windows.ytd_flows(ytd(spark, [("2025-12-31", 400.0)]), "ytd", ["region_id"]), "period_flow") == [None]
    monthly = ytd(spark, [("2025-01-31", 5.0), ("2025-03-31", 9.0), ("2025-04-30", 10.0)], "monthly")
    assert by_period(windows.ytd_flows(monthly, "ytd", ["region_id"]), "period_flow") == [5, None, 1]


def test_yoy_needs_the_year_before(spark):
    df = ytd(spark, [("2022-03-31", 10.0), ("2024-03-31", 20.0), ("2025-03-31", 30.0), ("2026-03-31", -5.0), ("2027-03-31", 5.0)])
    assert by_period(windows.same_period_yoy(df, "ytd", ["region_id"]), "yoy_pct") == [None, None, pytest.approx(50), pytest.approx(-350 / 3), None]


def test_contributions_and_execution(spark):
    schema = "section string, v double"
    got = aggregates.contributions(frame(spark, [("B", 120.0), ("C", 220.0)], schema), frame(spark, [("B", 100.0), ("C", 200.0)], schema), "section", "v").collect()
    assert sum(r.contribution_pp for r in got) == pytest.approx((340 / 300 - 1) * 100)
    plan = frame(spark, [(1, 50.0, 100.0, 80.0), (2, 40.0, 100.0, None), (3, 1.0, 0.0, None)], "i int, actual_ytd_rub double, approved_plan_rub double, revised_plan_rub double")
    assert [r.execution_pct for r in aggregates.plan_execution(plan).orderBy("i").collect()] == [62.5, 40.0, None]


def test_flows_and_bridge(spark):
    df = fiscal_panel(spark)
    flow = fiscal.flows(df).filter("region_id = 'A' AND metric_code = 'budget_balance'")
    assert by_period(flow, "quarter_flow_rub") == [20, 0, 20, -10]
    for basis, want in (("YTD", (20, 30, -40, 10)), ("period_flow", (0, 10, -20, -10))):
        steps = fiscal.balance_bridge(df, basis).filter(f"region_id = 'A' AND period = '{H1_24}'").orderBy("step").collect()
        assert [r.value_rub for r in steps] == list(want)
    register = {(r.region_id, r.period): r.availability for r in fiscal.bridge_register(fiscal_panel(spark, {("A", H1_23)})).collect()}
    assert register["A", H1_24] == "prior-year same-window actuals are unavailable" and register["B", H1_24] == "available"


def test_functions_reconcile(spark):
    rows = fiscal.spending_functions(fiscal_panel(spark)).filter(f"period = '{H1_24}' AND region_id = 'B'").collect()
    assert len(rows) == 14 and all(r.functions_complete and r.comparison_complete and r.reconciles for r in rows)
    assert sum(r.share_pct for r in rows) == pytest.approx(100) and sum(r.contribution_pp for r in rows) == pytest.approx(25)


def test_components_and_detailed_bridge(spark):
    for basis, want in (("YTD", [20, 10, 0, 5, -5]), ("period_flow", [5, 5, 0, 10, -10])):
        rows = fiscal.revenue_components(revenue_panel(spark), basis).filter(f"period = '{H1_24}'").orderBy("place").collect()
        assert [r.change_yoy_rub for r in rows] == want and all(r.comparison_complete and r.reconciles for r in rows)
    rows = fiscal.revenue_components(revenue_panel(spark, (H1_24, TRANSFERS))).filter(f"period = '{H1_24}'").collect()
    assert {r.component_code for r in rows if r.availability == "unavailable"} == {"transfers", "other_non_repayable"} and not any(r.comparison_complete for r in rows)
    amounts = {p: (r, s) for p, r, s in ((H1_23, 220.0, 200.0), (H1_24, 250.0, 240.0))}
    spent = frame(spark, [("A", p, SCOPE, "summary", c, v) for p, (r, s) in amounts.items() for c, v in (("revenue_total", r), ("expenditure_total", s), ("budget_balance", r - s))], "region_id string, period date, budget_level string, kind string, metric_code string, actual_ytd_rub double")
    steps = fiscal.detailed_bridge(spent, revenue_panel(spark)).orderBy("step").collect()
    assert [r.value_rub for r in steps] == [20, 20, 10, 0, 5, -5, -40, 10] and steps[6].to_rub == 10
    assert fiscal.detailed_bridge(spent, revenue_panel(spark, (H1_24, TRANSFERS))).count() == 0


def test_revenue_indicators(spark):
    rows = [("A", date.fromisoformat(p), SCOPE, "PIT", v, 10.0, False) for p, v in (("2025-03-31", 100.0), ("2025-06-30", 90.0), ("2025-12-31", 400.0), ("2026-03-31", 120.0), ("2026-06-30", 180.0))]
    df = fiscal.revenue_indicators(frame(spark, rows, "region_id string, period date, budget_level string, revenue_code string, actual_ytd_rub double, approved_plan_rub double, plan_components_reconciled boolean"))
    assert by_period(df, "quarter_flow_rub") == [100, -10, None, 120, 60] and by_period(df, "growth_yoy_pct")[-1] == 100
    assert by_period(df, "snapshot_execution_pct") == [None] * 5


def test_prices(spark):
    schema = "region_id string, period date, fuel_grade string, source_price string"
    rows = [("r", date(2025, 1, 1), "92", "50"), ("r", date(2026, 1, 1), "92", "60"), ("r", date(2026, 2, 1), "92", "66"), ("r", date(2026, 1, 1), "95", None), ("r", date(2026, 2, 1), "95", "60"), ("r", date(2026, 1, 1), "DT", "50"), ("r", date(2026, 2, 1), "DT", "40"), ("g", date(2026, 1, 1), "92", "50"), ("g", date(2026, 3, 1), "92", "60"), ("g", date(2026, 4, 1), "92", "-1")]
    got = {(r.region_id, r.fuel_grade, r.period.month, r.period.year): r for r in prices.price_history(frame(spark, rows, schema)).collect()}
    assert got["r", "92", 1, 2026].yoy_change_pct == 20 and got["r", "92", 1, 2026].mom_status == "prior_period_unavailable"
    assert got["r", "92", 2, 2026].mom_change_pct == pytest.approx(10) and not got["r", "92", 2, 2026].mom_review_flag
    assert got["r", "95", 2, 2026].mom_status == "prior_price_unavailable"
    assert got["r", "DT", 2, 2026].mom_review_flag and got["r", "DT", 2, 2026].price == 40
    assert got["g", "92", 3, 2026].mom_change_pct is None and got["g", "92", 3, 2026].expected_previous_month_period == date(2026, 2, 1)
    assert got["g", "92", 4, 2026].availability == "invalid_source_value" and got["g", "92", 4, 2026].source_price == "-1"
    now = {r.fuel_grade: r for r in prices.latest_prices(prices.price_history(frame(spark, [("r", date(2026, 1, 1), "98", "60"), ("r", date(2026, 2, 1), "92", "50")], schema)), ["92", "98"]).collect()}
    assert now["92"].observation_present and now["98"].availability == "no_observation_for_reporting_month" and now["98"].price is None


def test_alignment(spark):
    pit = frame(spark, [("A", "C", date(2025, 3, 31), 100.0), ("A", "C", date(2026, 3, 31), 120.0), ("A", "D", date(2025, 3, 31), 0.0), ("A", "D", date(2026, 3, 31), 5.0)], "region_id string, section string, period date, ytd double")
    index = frame(spark, [("A", "C", date(2026, 3, 31), 95.0, -5.0)], "region_id string, section string, period date, index_value double, growth_yoy_pct double")
    got = {r.section: r for r in production.matched_receipts(pit, index).filter("period = '2026-03-31'").collect()}
    assert len(got) == 4 and (got["C"].pit_yoy_pct, got["C"].production_yoy_pct, got["C"].availability) == (20, -5, "matched")
    assert got["B"].availability == "current_pit_unavailable;prior_pit_unavailable;production_unavailable"
    assert got["D"].pit_yoy_pct is None and got["D"].availability == "nonpositive_prior_pit_growth_withheld;production_unavailable"


def test_headline_gaps(spark):
    df = frame(spark, [("r", "TOTAL", date(2026, 1, 31), 95.0, -5.0), ("r", "TOTAL", date(2026, 3, 31), 110.0, 10.0)], "region_id string, section string, period date, index_value double, growth_yoy_pct double")
    rows = production.headline_history(df).orderBy("period").collect()
    assert [r.growth_yoy_pct for r in rows] == [-5, None, 10] and rows[0].segment != rows[2].segment


def test_vintages(spark):
    df = frame(spark, [("r", date(2026, 4, 1), 105.2, "a"), ("r", date(2026, 4, 2), None, "b"), ("s", date(2026, 4, 1), 1.0, "a")], "region_id string, vintage date, value double, source string")
    got = {r.region_id: r.value for r in windows.latest_vintage(df, ["region_id"], "vintage").collect()}
    assert got == {"r": None, "s": 1.0}
    with pytest.raises(PySparkException, match="not unique"):
        windows.latest_vintage(df.union(df.limit(1)), ["region_id"], "vintage", fail_on_ties=True).count()


def test_guards_fail_closed(spark):
    doubled = fiscal_panel(spark).union(fiscal_panel(spark).limit(1))
    with pytest.raises(PySparkException, match="not unique"):
        fiscal.validated(doubled).count()
    with pytest.raises(PySparkException, match="not unique"):
        joins.checked_join(doubled, doubled, ["region_id", "period", "kind", "metric_code"]).count()
    with pytest.raises(ValueError, match="basis"):
        fiscal.observations(doubled, "yearly")


def test_coverage_change_withholds_growth(spark):
    rows = [("r", date(2025, 3, 31), "B", 1.0), ("r", date(2025, 3, 31), "C", 1.0), ("r", date(2026, 3, 31), "B", 4.0)]
    got = overview.receipts_summary(frame(spark, rows, "region_id string, period date, section string, flow double")).first()
    assert got.coverage_changed and got.yoy_pct is None and got.missing_sections == "C"


def test_validation_blocks(spark):
    from tidemark.contracts import CONTRACTS

    row = tuple({"period": date(2026, 3, 31), "frequency": "quarterly", "quality_status": "verified", "is_official": True}.get(f.name, 1.0 if f.name.endswith("rub") else "x") for f in CONTRACTS["budget_execution"])
    one = spark.createDataFrame([row], CONTRACTS["budget_execution"])
    assert quality.is_valid(quality.validate("budget_execution", one))
    with pytest.raises(ValueError, match="unique_grain"):
        quality.gate(quality.validate("budget_execution", one.union(one)))
    assert [r.status for r in quality.validate("budget_execution", one.drop("source_id")).collect()] == ["failed"]
    assert quality.validate("no_such_table", one).first().check_id == "known_table"


def test_corruptions_are_found(spark):
    df = fiscal_panel(spark)
    assert {r.status for r in quality.accounting_checks(df).collect()} == {"passed"}
    from pyspark.sql import functions as F

    off = df.withColumn("actual_ytd_rub", F.when((F.col("metric_code") == "budget_balance") & (F.col("region_id") == "A"), F.col("actual_ytd_rub") + 1).otherwise(F.col("actual_ytd_rub")))
    assert "failed" in {r.status for r in quality.accounting_checks(off).collect()}
    mixed = df.withColumn("source_file", F.when(F.col("metric_code") == "0100", "b").otherwise("a"))
    assert quality.mixed_provenance(mixed, ["region_id", "period"], ["source_file"]).count() == 8


def test_text_and_numbers(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        text.name_key(F.lit("Санкт-Петербург г. Ё")).alias("k"), text.latin_section(F.lit("с")).alias("s"), text.code_key(F.lit("000")).alias("z"), text.window_month(F.lit("январь-март3")).alias("w"), text.window_month(F.lit("февраль")).alias("none"),
        numbers.parse_decimal(F.lit("1 234 567,89")).cast("double").alias("d"), numbers.large_move(F.lit(10.00000000001)).alias("m"), text.classify_revenue(F.lit("x"), F.lit("Налог на прибыль организаций")).alias("c"),
    ).first()
    assert tuple(row) == ("санктпетербургге", "C", "0", 3, None, 1234567.89, False, "CIT")


def test_fixed_values_of_texts(spark):
    from pyspark.sql import functions as F

    rows = [("643", "x"), ("1", "Южный Федеральный округ"), ("45000000000", "a"), ("7", "Ненецкий автономный округ"), ("45286552001", "г. Москва"), (None, None)]
    df = spark.createDataFrame(rows, "code string, name string")
    assert [r[0] for r in df.select(text.territory_scope("code", "name")).collect()] == ["national", "federal_district", "region", "region", "surveyed_city", "surveyed_city"]
    rows = [("B-E", "x"), ("b–e", "x"), ("B—E ", None), ("ALL", "x"), ("ВСЕГО", ""), ("x", "Итого"), ("x", "all industries"), ("x", "B-E"), ("all industries", "ALL"), ("C", "Manufacturing"), (None, None)]
    kept = filters.without_totals(spark.createDataFrame(rows, "code string, name string"), "code", names=("name",)).collect()
    assert [tuple(r) for r in kept] == [("x", "B-E"), ("all industries", "ALL"), ("C", "Manufacturing"), (None, None)]
    keys = spark.createDataFrame([("Ⅳ Straße ﬁn",), ("iv strasse fin",), (None,)], "n string").select(text.name_key("n").alias("k")).collect()
    assert keys[0].k == keys[1].k == "ivstrassefin" and keys[2].k is None
    secrets = ["ghp_" + "a1" * 12, "github_pat_" + "b" * 24, "sk-proj-" + "c" * 26, "AKIA" + "D" * 16, "-----BEGIN RSA PRIVATE KEY-----", "https://u:p@host/", "http://h/x?a=1&X-Amz-Signature=abc", "http://h/?token=1"]
    plain = ["https://host/a/tmp/b", "see C/D", "12:30", None]
    paths = ["/Users/me/a b/c.csv", "C:\\data\\c.csv", "/var/folders/x/c.csv/"]
    prose = ["kept in /home/me/c.csv today", "at D:/x"]
    of = lambda xs, field="": [r[0] for r in spark.createDataFrame([(x,) for x in xs], "t string").coalesce(1).select(text.sanitized("t", field)).collect()]
    assert of(secrets) == [None] * 8 and of(plain) == plain and of(paths) == ["c.csv"] * 3 and of(prose) == [None] * 2
    assert of(["in /home/me/c.csv", "a/b.csv"], "source_file") == ["c.csv", "a/b.csv"] and of(["a/b.csv"], "local_path") == ["b.csv"]


def test_years_of_calendar_joins(spark):
    rows = [("a", d, float(i)) for i, d in enumerate((date(2023, 2, 28), date(2024, 2, 29), date(2025, 2, 28), date(2024, 3, 31), date(2026, 3, 31), date(2027, 3, 31)))] + [(None, date(2026, 3, 31), 9.0), (None, date(2027, 3, 31), 9.0)]
    df = spark.createDataFrame(rows, "k string, period date, v double")
    from pyspark.sql import functions as F

    want = {(r.k, r.period): r.o for r in df.alias("x").join(df.select("k", F.add_months("period", 12).alias("period"), F.col("v").alias("o")), ["k", "period"], "left").collect()}
    got = {(r.k, r.period): r.prior_v for r in joins.calendar_join(df, ["k"], ["v"], "prior_").collect()}
    assert got == want and got["a", date(2025, 2, 28)] == 1.0 and got["a", date(2026, 3, 31)] is None
    snapped = {r.period: r.prior_v for r in joins.calendar_join(df.filter("k = 'a'"), ["k"], ["v"], "prior_", snap="month_end").collect()}
    assert snapped[date(2024, 2, 29)] == 0.0 and snapped[date(2025, 2, 28)] == 1.0
    with pytest.raises(Exception, match="not unique"):
        joins.star_join(df, [df.union(df)], ["k", "period"]).collect()


def test_calendar_joins_are_one_to_one(spark):
    """Repeated keys are an error, on either side and for every shift; null keys and leap days are none; the check adds no exchange."""
    day = date.fromisoformat
    frame = lambda *rows: spark.createDataFrame([(k, day(d), v) for k, d, v in rows], "k string, period date, v int")
    now, before, other = ("a", "2021-03-31", 1), ("a", "2020-03-31", 2), ("a", "2020-12-31", 3)
    for months, snap in ((12, None), (12, "month_end"), (24, None), (3, "month_end"), (1, None)):
        join = lambda df, **m: joins.calendar_join(df, ["k"], ["v"], "prior_", months, snap=snap, **m)  # noqa: B023, E731
        good = frame(now, before, other, (None, "2021-03-31", 4), (None, "2021-03-31", 5))
        assert join(good).count() == 5
        for twice in ((now, now, before), (now, before, ("a", "2020-03-31", 9)), (other, other)):
            with pytest.raises(Exception, match="not unique|more than one row"):
                join(frame(*twice)).select("k").collect()  # although no value is asked for
        plan = join(good)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange") <= (1 if months % 12 == 0 else 2)
    leap = frame(("a", "2020-02-28", 1), ("a", "2020-02-29", 2), ("a", "2021-02-28", 3))
    assert joins.calendar_join(leap, ["k"], ["v"], "prior_").count() == 3
    with pytest.raises(Exception, match="more than one row"):
        joins.calendar_join(leap.union(leap.filter("v = 2")), ["k"], ["v"], "prior_").collect()
    # Two days of a month that would both be the prior of its end a year later.
    apart = frame(("a", "2020-02-10", 1), ("a", "2020-02-29", 2), ("a", "2021-02-28", 3))
    with pytest.raises(Exception, match="more than one row"):
        joins.calendar_join(apart, ["k"], ["v"], "prior_", snap="month_end").collect()
    ends = frame(("a", "2021-03-31", 1), ("a", "2021-06-30", 2), ("a", "2021-04-01", 3), ("a", "2021-04-01", 3))
    assert {r.v: r.start_v for r in joins.first_quarter_join(ends, ["k"], ["v"]).collect()} == {1: None, 2: 1, 3: None}
    with pytest.raises(Exception, match="more than one quarter end"):
        joins.first_quarter_join(ends.union(ends.limit(1)), ["k"], ["v"]).collect()
