"""Statements about a region's windows: values by hand, and the published rows that stand behind them."""

from datetime import date

import pytest

from tidemark.contracts import SCOPE
from tidemark.plans import claims, prices
from tidemark.plans.panels import CIT, FUNCTIONS, OTHER, OWN, PIT, TOTAL, TRANSFERS

D = date.fromisoformat
H1, Q1, BEFORE, BEFORE_Q1 = "2026-06-30", "2026-03-31", "2025-06-30", "2025-03-31"
LINEAGE = "source_file string, source_sha256 string, source_member string, reporting_cutoff date"


def lineage(day, member):
    return f"{day}.zip", f"hash of {day}", member, D(day)


@pytest.fixture(scope="module")
def inputs(spark):
    fiscal, revenue = [], []
    for day, scale in ((H1, 2.0), (Q1, 1.0), (BEFORE, 1.5)):  # the first quarter of the year before is absent
        for k, m, v in [("summary", "revenue_total", 100.0), ("summary", "expenditure_total", 90.0), ("summary", "budget_balance", 10.0), *[("expenditure_function", f, 5.0 + i) for i, f in enumerate(FUNCTIONS)]]:
            change = 20.0 if (day, m) == (BEFORE, "0200") else 0.0
            fiscal.append(("r", D(day), SCOPE, k, m, v * scale + change, *lineage(day, m)))
        for c, v in ((TOTAL, 100.0), (OWN, 60.0), (PIT, 20.0), (CIT, 30.0), (OTHER, 40.0), (TRANSFERS, 25.0)):
            if (day, c) != (BEFORE, CIT):
                revenue.append(("r", D(day), SCOPE, c, v * scale, *lineage(day, c)))
    made = [("r", s, D(day), v, v and v - 100, *lineage(day, s)) for s, day, v in (("TOTAL", H1, 103.0), ("TOTAL", Q1, 99.0), ("C", H1, None), ("B", H1, 1.0))]
    price = [("r", D(day), "95", v, *lineage(day, "95")) for day, v in (("2026-06-01", 66.0), ("2025-06-01", 60.0), ("2026-03-01", 63.0))]
    return (
        spark.createDataFrame(fiscal, f"region_id string, period date, budget_level string, kind string, metric_code string, actual_ytd_rub double, {LINEAGE}"),
        spark.createDataFrame(revenue, f"region_id string, period date, budget_level string, revenue_code string, actual_ytd_rub double, {LINEAGE}"),
        spark.createDataFrame(made, f"region_id string, section string, period date, index_value double, growth_yoy_pct double, {LINEAGE}"),
        prices.price_history(spark.createDataFrame(price, f"region_id string, period date, fuel_grade string, source_price double, {LINEAGE}"), ("source_file", "source_sha256", "source_member", "reporting_cutoff")),
    )


def said(rows, day, window=None):
    files = lambda sources: sorted((x["source_file"], x["source_sha256"], x["source_member"]) for x in sources)
    return {r.claim_code: (r.value and round(r.value, 6), r.availability, files(r.current), files(r.prior)) for r in rows if r.period == D(day) and window in (None, r.window)}


def source(day, *members):
    return sorted((f"{day}.zip", f"hash of {day}", m) for m in members)


def test_year_to_date(inputs):
    rows = claims.statements(*inputs, grades=("95",)).collect()
    got = said(rows, H1)
    assert len(got) == 6 + 5 + 2 + 2 + 2 + 2
    assert got["revenue_total"] == (200.0, "available", source(H1, "revenue_total"), [])
    assert got["budget_balance_change"] == (5.0, "available", source(H1, "budget_balance"), source(BEFORE, "budget_balance"))
    assert got["component_retained_pit"] == (10.0, "available", source(H1, PIT), source(BEFORE, PIT))
    # A missing prior code leaves no value, and evidence of those rows alone that are there.
    assert got["component_cit"] == (None, "unavailable", source(H1, CIT), [])
    assert got["component_other_own"] == (None, "unavailable", source(H1, OWN, PIT, CIT), source(BEFORE, OWN, PIT))
    assert got["transfer_share_change"] == (0.0, "available", source(H1, TRANSFERS, TOTAL), source(BEFORE, TRANSFERS, TOTAL))
    assert got["spending_1400"] == (9.0, "available", source(H1, "1400"), source(BEFORE, "1400")) and got["spending_0200"][0] == -17.0
    assert got["production_TOTAL"] == (3.0, "available", source(H1, "TOTAL"), []) and got["production_C"] == (None, "unavailable", source(H1, "C"), [])
    assert got["fuel_95_price"] == (66.0, "available", source("2026-06-01", "95"), []) and got["fuel_95_yoy"] == (10.0, "available", source("2026-06-01", "95"), source("2025-06-01", "95"))


def test_no_prior_row_no_prior_evidence(inputs):
    rows = claims.statements(*inputs, grades=("95",)).collect()
    got = said(rows, Q1)
    assert {k for k, v in got.items() if v[3]} == set()
    assert got["revenue_total_change"][:2] == (None, "unavailable") and got["fuel_95_yoy"][:2] == (None, "unavailable") and not any(k.startswith("spending_") for k in got)
    assert all(r.reason for r in rows if r.availability == "unavailable") and all(r.reason is None for r in rows if r.availability == "available")


def test_flows_rest_on_both_endpoints(inputs):
    rows = claims.statements(*inputs, basis="period_flow", grades=("95",)).collect()
    got = said(rows, H1, "Q2")
    both = sorted(source(H1, "revenue_total") + source(Q1, "revenue_total"))
    assert got["revenue_total"] == (100.0, "available", both, [])
    # The year before lacks its first quarter: no flow, so no row stands behind one.
    assert got["revenue_total_change"] == (None, "unavailable", both, [])
    assert got["production_TOTAL"] == (None, "unavailable", [], []) and {r.reason for r in rows if r.claim_code == "production_TOTAL" and r.window == "Q2"} == {claims.NO_OUTPUT_FLOW}


def test_tables_without_lineage(inputs):
    bare = [df.drop("source_file", "source_sha256", "source_member", "reporting_cutoff", *[f"{p}{c}" for p in ("previous_month_", "previous_year_") for c in ("source_file", "source_sha256", "source_member", "reporting_cutoff")]) for df in inputs]
    rows = claims.statements(*bare, grades=("95",)).collect()
    change = next(r for r in rows if r.claim_code == "revenue_total_change" and r.period == D(H1))
    assert change.value == 50.0 and [(x.period, x.source_file) for x in change.prior] == [(D(BEFORE), None)]


def test_empty_tables(inputs):
    assert claims.statements(*[df.limit(0) for df in inputs], grades=("95",)).collect() == []
