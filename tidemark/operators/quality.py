"""Checks as queries: each gives rows of quality events, and a gate reads them.

Counts of violations are aggregates, so a check costs one pass and sends one row. Checks of a schema alone need no pass.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import contracts
from ..functions import calendar as cal
from ..functions.numbers import TOLERANCE, is_finite, strict_violation

EVENT = "check_id string, table_name string, severity string, status string, observed long, expected long"


def _literal(spark: SparkSession, check: str, table: str, severity: str, failed: bool, observed: int, expected: int = 0) -> DataFrame:
    return spark.createDataFrame([(check, table, severity, "failed" if failed else "passed", observed, expected)], EVENT)


def counted(df: DataFrame, check: str, table: str, severity: str, violations: Column, failed: str = "failed", expected: int = 0) -> DataFrame:
    """One event from an aggregate that counts violations."""
    return df.agg(F.coalesce(violations, F.lit(0)).cast("long").alias("observed")).select(
        F.lit(check).alias("check_id"), F.lit(table).alias("table_name"), F.lit(severity).alias("severity"),
        F.when(F.col("observed") == expected, "passed").otherwise(failed).alias("status"), "observed", F.lit(expected).cast("long").alias("expected"),
    )


def violations(df: DataFrame, check: str, table: str, severity: str, condition: Column, failed: str = "failed") -> DataFrame:
    return counted(df, check, table, severity, F.count_if(F.coalesce(condition, F.lit(False))), failed)


def many_violations(df: DataFrame, table: str, checks: dict[str, tuple[str, Column]], failed: str = "failed") -> DataFrame:
    """Events of several row conditions in a single pass. checks: name to (severity, condition)."""
    n = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, (_, c) in checks.items()])
    long = n.unpivot([], list(checks), "check_id", "observed")
    severity = F.coalesce(*[F.when(F.col("check_id") == k, s) for k, (s, _) in checks.items()])
    return long.select("check_id", F.lit(table).alias("table_name"), severity.alias("severity"), F.when(F.col("observed") == 0, "passed").otherwise(failed).alias("status"), "observed", F.lit(0).cast("long").alias("expected"))


def check_columns(name: str, df: DataFrame) -> DataFrame:
    """Absent contract columns, from the schema alone."""
    absent = [c for c in contracts.CONTRACTS[name].names if c not in df.columns]
    return _literal(df.sparkSession, "contract_columns", name, "critical", bool(absent), len(absent))


def check_known(name: str, df: DataFrame) -> DataFrame:
    """How many rows lie in a table that no contract knows; an empty one fails like any other."""
    known = name in contracts.CONTRACTS
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    status = "passed" if known else "failed"
    return rows.select(F.lit("known_table").alias("check_id"), F.lit(name).alias("table_name"), F.lit("critical").alias("severity"), F.lit(status).alias("status"), (F.lit(0) if known else F.col("n")).cast("long").alias("observed"), F.lit(0).cast("long").alias("expected"))


def check_grain(name: str, df: DataFrame, grain: list[str]) -> DataFrame:
    groups = df.groupBy(*grain).agg(F.count(F.lit(1)).alias("n"))
    return counted(groups, "unique_grain", name, "critical", F.sum(F.when(F.col("n") > 1, F.col("n"))))


def check_not_null(name: str, df: DataFrame, columns: list[str]) -> DataFrame:
    return many_violations(df, name, {f"not_null:{c}": ("high", F.col(c).isNull()) for c in columns})


def check_domain(name: str, df: DataFrame, column: str, allowed, severity: str = "high") -> DataFrame:
    return violations(df, f"domain:{column}", name, severity, ~F.col(column).isin(*allowed))


def check_nonnegative(name: str, df: DataFrame, column: str) -> DataFrame:
    """A warning: the rows stay."""
    return violations(df, f"nonnegative:{column}", name, "medium", F.col(column).try_cast("double") < 0, "warning")


def check_scope(name: str, df: DataFrame, column: str = "okved_section", allowed=("TOTAL", *contracts.SECTIONS)) -> DataFrame:
    return violations(df, "industrial_scope", name, "medium", ~F.col(column).isin(*allowed), "warning")


def check_amounts(name: str, df: DataFrame, *columns: str) -> DataFrame:
    negative = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in columns])
    return violations(df, "negative_amounts", name, "medium", negative, "warning")


def blocking(events: DataFrame) -> DataFrame:
    return events.filter(F.col("severity").isin(*contracts.BLOCKING) & (F.col("status") == "failed"))


def is_valid(events: DataFrame) -> bool:
    return blocking(events).isEmpty()


def gate(events: DataFrame) -> None:
    """Raises with the failed checks' names. Events are one row a check."""
    failed = sorted({f"{r['table_name']}.{r['check_id']}" for r in blocking(events).select("table_name", "check_id").collect()})
    if failed:
        raise ValueError(f"blocking checks failed: {', '.join(failed)}")


def row_checks(name: str, columns: list[str]) -> dict[str, tuple[str, Column, str]]:
    """The generic checks of a contract's rows: name to (severity, condition of a violation, status then)."""
    outside = lambda c, allowed: ~F.col(c).isin(*allowed)
    out = {f"not_null:{c}": ("high", F.col(c).isNull(), "failed") for c in contracts.REQUIRED.get(name, ())}
    if "frequency" in columns:
        out["domain:frequency"] = ("high", outside("frequency", contracts.FREQUENCIES), "failed")
    if "quality_status" in columns:
        out["domain:quality_status"] = ("medium", outside("quality_status", contracts.QUALITY_STATUSES), "failed")
    if name == "pit_receipts":
        out["nonnegative:pit_ytd_rub"] = ("medium", F.col("pit_ytd_rub") < 0, "warning")
    if name == "industrial_production":
        out["industrial_scope"] = ("medium", outside("okved_section", ("TOTAL", *contracts.SECTIONS)), "warning")
    if name == "budget_execution":
        negative = [F.coalesce(F.col(c) < 0, F.lit(False)) for c in ("actual_ytd_rub", "approved_plan_rub", "revised_plan_rub")]
        out["negative_amounts"] = ("medium", reduce(lambda a, b: a | b, negative), "warning")
    return out


def validate(name: str, df: DataFrame) -> DataFrame:
    """All generic checks of a contract's table, those of rows in one pass; without its columns only that is reported.

    `observed` makes the same checks while the table is written."""
    if name not in contracts.CONTRACTS:
        return check_known(name, df)
    events = [check_columns(name, df)]
    if set(contracts.CONTRACTS[name].names) <= set(df.columns):
        if checks := row_checks(name, df.columns):
            found = many_violations(df, name, {k: (severity, c) for k, (severity, c, _) in checks.items()})
            notes = [k for k, (_, _, status) in checks.items() if status == "warning"]
            warned = F.when(F.col("check_id").isin(*notes) & (F.col("status") == "failed"), "warning").otherwise(F.col("status")) if notes else F.col("status")
            events.append(found.withColumn("status", warned))
        if name in contracts.GRAINS:
            events.append(check_grain(name, df, contracts.GRAINS[name]))
    return reduce(DataFrame.unionByName, events)


def observed(name: str, df: DataFrame, more: dict[str, Column] | None = None) -> tuple[DataFrame, Callable[[], tuple[list[tuple], dict]]]:
    """df, whose rows are counted and checked on their way to wherever an action takes them, and a function that gives, after that
    action, the events of `validate` (rows of EVENT) and the values of `more` (aggregates by name).

    Nothing is read twice: conditions are counted by observed metrics, and repeated grains by the row's number in its grain, which needs an exchange
    by the grain. The metrics lie behind it, in the action's own stage, whose tasks count once also when they run again."""
    known = name in contracts.CONTRACTS
    whole = known and set(contracts.CONTRACTS[name].names) <= set(df.columns)
    checks = row_checks(name, df.columns) if whole else {}
    grain = contracts.GRAINS.get(name, []) if whole else []
    aggregates = {f"check:{k}": F.count_if(F.coalesce(c, F.lit(False))) for k, (_, c, _) in checks.items()}
    columns = df.columns
    if grain:
        df = df.withColumn("_grain_row", F.row_number().over(Window.partitionBy(*grain).orderBy(grain[0])))
        # All rows of a repeated grain: those after the first, and one for each first that has a second.
        aggregates["grain"] = F.count_if(F.col("_grain_row") > 1) + F.count_if(F.col("_grain_row") == 2)
    aggregates |= {"rows": F.count(F.lit(1))} | {f"more:{k}": c for k, c in (more or {}).items()}
    seen = Observation()
    out = df.observe(seen, *[c.alias(k) for k, c in aggregates.items()]).select(*columns)

    def found() -> tuple[list[tuple], dict]:
        got = seen.get
        event = lambda check, severity, n, failed="failed": (check, name, severity, failed if n else "passed", n, 0)
        events = []
        if not known:
            events.append((*event("known_table", "critical", got["rows"])[:3], "failed", got["rows"], 0))
        else:
            events.append(event("contract_columns", "critical", len([c for c in contracts.CONTRACTS[name].names if c not in columns])))
        events += [event(k, severity, got[f"check:{k}"], status) for k, (severity, _, status) in checks.items()]
        events += [event("unique_grain", "critical", got["grain"])] if grain else []
        return events, {"rows": got["rows"]} | {k: got[f"more:{k}"] for k in more or {}}

    return out, found


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value_a: str, value_b: str, limit_pct: float = 5.0) -> DataFrame:
    """Totals of two sources on equal keys, their relative gap, and a warning beyond the limit."""
    left = a.groupBy(*keys).agg(F.sum(value_a).alias("total_a"))
    right = b.groupBy(*keys).agg(F.sum(value_b).alias("total_b"))
    both = left.join(right, keys)
    gap = F.when(F.col("total_b") != 0, (F.col("total_a") - F.col("total_b")) / F.col("total_b") * 100)
    return both.withColumn("gap_pct", gap).withColumn("status", F.when(F.abs("gap_pct") > limit_pct, "warning").when(F.col("gap_pct").isNull(), "not_assessable").otherwise("passed"))


def source_coverage(rejects: DataFrame, reason: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Skipped sources by reason (warnings), and empty core tables (critical)."""
    skipped = rejects.groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("observed"))
    skipped = skipped.select(F.concat(F.lit("skipped:"), "reason").alias("check_id"), F.lit("sources").alias("table_name"), F.lit("medium").alias("severity"), F.lit("warning").alias("status"), F.col("observed").cast("long"), F.lit(0).cast("long").alias("expected"))
    empty = [counted(df.limit(1), "core_table_not_empty", n, "critical", F.when(F.count(F.lit(1)) == 0, 1).otherwise(0)) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, [skipped, *empty])


def check_components(df: DataFrame, keys: list[str], code: str, value: str, total: str, parts: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Per key: total, sum of its parts, gap and status; not assessable where a part is missing."""
    sums = df.groupBy(*keys).agg(
        F.max(F.when(F.col(code) == total, F.col(value))).alias("total"),
        *[F.max(F.when(F.col(code) == p, F.col(value))).alias(f"_{i}") for i, p in enumerate(parts)],
    )
    of_parts = reduce(lambda a, b: a + b, [F.col(f"_{i}") for i in range(len(parts))])
    sums = sums.withColumn("parts", of_parts).withColumn("gap", F.col("total") - F.col("parts"))
    status = F.when(F.col("gap").isNull(), "not_assessable").when(F.abs("gap") <= tolerance, "passed").otherwise("failed")
    return sums.select(*keys, "total", "parts", "gap", status.alias("status"))


def accounting_checks(fiscal: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Identities of a budget report, a row for each region, period and identity."""
    pick = lambda kind, code: F.max(F.when((F.col("kind") == kind) & (F.col("metric_code") == code), F.col("actual_ytd_rub")))
    functions = F.when(F.col("kind") == "expenditure_function", F.col("actual_ytd_rub"))
    wide = fiscal.groupBy("region_id", "period").agg(
        pick("summary", "revenue_total").alias("revenue"), pick("summary", "expenditure_total").alias("spending"), pick("summary", "budget_balance").alias("balance"),
        pick("financing_component", "financing_total").alias("financing"), F.when(F.count(functions) == 14, F.sum(functions)).alias("functions"),
    )
    gaps = {
        "revenue_minus_spending_is_balance": F.col("revenue") - F.col("spending") - F.col("balance"),
        "balance_plus_financing_is_zero": F.col("balance") + F.col("financing"),
        "functions_sum_to_spending": F.col("functions") - F.col("spending"),
    }
    rows = wide.select("region_id", "period", F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), v.alias("gap")) for k, v in gaps.items()])).alias("c"))
    status = F.when(F.col("c.gap").isNull(), "not_assessable").when(F.abs("c.gap") <= tolerance, "passed").otherwise("failed")
    return rows.select("region_id", "period", "c.check_id", "c.gap", status.alias("status"))


def check_fiscal(fiscal: DataFrame) -> DataFrame:
    """Loading a fiscal table: its grain, finite values, and the identities."""
    identities = counted(accounting_checks(fiscal), "identities", "fiscal_observations", "critical", F.count_if(F.col("status") == "failed"))
    finite = violations(fiscal, "finite", "fiscal_observations", "critical", strict_violation("actual_ytd_rub"))
    return check_grain("fiscal_observations", fiscal, ["region_id", "period", "kind", "metric_code"]).unionByName(finite).unionByName(identities)


def check_revenue(revenue: DataFrame, core: list[str], total: str, own: str, other: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Per region and period: missing core codes, the actual's gap, and whether the plan flag is as recomputed."""
    pick = lambda c, v: F.max(F.when(F.col("revenue_code") == c, F.col(v)))
    wide = revenue.groupBy("region_id", "period").agg(
        F.sort_array(F.array_except(F.array(*map(F.lit, core)), F.collect_set("revenue_code"))).alias("_missing"),
        (pick(total, "actual_ytd_rub") - pick(own, "actual_ytd_rub") - pick(other, "actual_ytd_rub")).alias("gap"),
        (pick(total, "approved_plan_rub") - pick(own, "approved_plan_rub") - pick(other, "approved_plan_rub")).alias("plan_gap"),
        F.bool_and("plan_components_reconciled").alias("flag"),
    )
    recomputed = F.coalesce(F.abs("plan_gap") <= tolerance, F.lit(False))
    return wide.select("region_id", "period", F.array_join("_missing", ",").alias("missing_codes"), "gap", F.coalesce(F.abs("gap") <= tolerance, F.lit(False)).alias("actual_reconciles"), (F.col("flag") == recomputed).alias("plan_flag_agrees"))


def check_sources(facts: DataFrame, register: DataFrame, foreign: str = "source_id") -> DataFrame:
    """Orphan ids, malformed hashes in the register, and ids that occur twice."""
    known = register.select(F.col("source_id").alias(foreign)).distinct()
    orphan = facts.select(foreign).filter(F.col(foreign).isNotNull()).join(known, foreign, "left_anti")
    events = [
        counted(orphan, "orphan_source", "facts", "high", F.count(F.lit(1))),
        violations(register, "hash_format", "sources", "high", ~F.col("sha256").rlike("^[0-9a-f]{64}$")),
        check_grain("sources", register, ["source_id"]),
    ]
    return reduce(DataFrame.unionByName, events)


def check_windows(df: DataFrame, table: str = "production") -> DataFrame:
    return many_violations(df, table, {
        "month_end": ("high", ~cal.is_month_end("period")),
        "starts_on_1_january": ("high", F.col("window_start") != cal.year_start("period")),
        "window_months": ("high", F.col("window_months") != F.month("period")),
    })


def check_index_values(df: DataFrame, table: str = "production") -> DataFrame:
    v = F.col("index_value")
    return many_violations(df, table, {
        "finite": ("high", v.isNotNull() & ~is_finite(v)),
        "nonnegative": ("high", v < 0),
        "growth_is_index_less_100": ("high", F.abs(F.col("growth_yoy_pct") - (v - 100)) > 1e-9),
        "availability_says_value": ("high", (F.col("availability") == "reported") != v.isNotNull()),
    })


def check_provenance(df: DataFrame, manifest: DataFrame, table: str = "production") -> DataFrame:
    """Facts whose file is not in the manifest, or has another hash there."""
    known = manifest.select("source_file", F.col("sha256").alias("manifest_sha256"))
    joined = df.select("source_file", "source_sha256").distinct().join(known, "source_file", "left")
    return many_violations(joined, table, {"file_in_manifest": ("critical", F.col("manifest_sha256").isNull()), "hash_agrees": ("critical", F.col("source_sha256") != F.col("manifest_sha256"))})


def calendar_grid_gaps(df: DataFrame, entity: str, codes: dict[str, str] | list[str], code: str, period: str = "period") -> DataFrame:
    """Cells of the complete entity x month x code grid that have no row. Months come from the table's own range."""
    first, last = df.agg(F.min(period), F.max(period)).first()
    months = F.explode(cal.calendar(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(period)
    grid = df.select(entity).distinct().select(entity, months).withColumn(code, F.explode(F.array(*map(F.lit, codes))))
    return grid.join(df.select(entity, period, code), [entity, period, code], "left_anti")


def coverage_cells(df: DataFrame, entity: str, frequency: str = "quarterly", period: str = "period", status: str = "status", absent: str = "absent") -> DataFrame:
    """Every entity with every period of the table's own range, and its status; cells without a row are `absent`."""
    first, last = df.agg(F.min(period), F.max(period)).first()
    periods = F.explode(cal.calendar(F.lit(first).cast("date"), F.lit(last).cast("date"), frequency)).alias(period)
    grid = df.select(entity).distinct().select(entity, periods)
    return grid.join(df.select(entity, period, status), [entity, period], "left").withColumn(status, F.coalesce(status, F.lit(absent)))


def check_annual(df: DataFrame, table: str = "production_annual") -> DataFrame:
    return many_violations(df, table, {
        "year_end": ("high", (F.month("period") != 12) | (F.dayofmonth("period") != 31)),
        "growth_is_index_less_100": ("high", F.abs(F.col("growth_yoy_pct") - (F.col("index_value") - 100)) > 1e-9),
    })


def price_availability(df: DataFrame, raw: str = "source_price") -> DataFrame:
    """The raw price stays; a price only where it is a positive finite number, else the class of its absence."""
    v = F.col(raw).try_cast("double")
    good = v.isNotNull() & is_finite(v) & (v > 0)
    status = F.when(good, "reported").when(F.col(raw).isNull(), "missing_source_value").otherwise("invalid_source_value")
    return df.withColumns({"price": F.when(good, v), "availability": status, "period_end": F.last_day("period")})


def check_prices(df: DataFrame, grades, table: str = "prices") -> DataFrame:
    rows = many_violations(df, table, {
        "grain_not_null": ("critical", F.col("region_id").isNull() | F.col("period").isNull() | F.col("fuel_grade").isNull()),
        "month_start": ("critical", ~cal.is_month_start("period")),
        "known_grade": ("high", ~F.col("fuel_grade").isin(*grades)),
        "positive": ("high", F.col("price") <= 0),
    })
    return rows.unionByName(check_grain(table, df, ["region_id", "period", "fuel_grade"]))


def price_coverage(df: DataFrame, grades) -> DataFrame:
    """Per grade: reported, missing, and cells that the complete grid lacks."""
    have = df.groupBy("fuel_grade").agg(F.count("price").alias("n_reported"), F.count_if(F.col("price").isNull()).alias("n_missing"))
    gaps = calendar_grid_gaps(df.withColumn("period", F.last_day("period")), "region_id", list(grades), "fuel_grade").groupBy("fuel_grade").agg(F.count(F.lit(1)).alias("n_absent"))
    return have.join(gaps, "fuel_grade", "left").fillna(0, ["n_absent"])


def validate_dataset(name: str, df: DataFrame, grain: list[str], value: str, eligible: DataFrame | None = None, period_end: str = "month", nonnegative: bool = False) -> DataFrame:
    """The generic checks of a selected-vintage panel: grain, finite values, period ends, entities in the eligible set."""
    late = ~(cal.is_month_end("period") if period_end == "month" else cal.is_quarter_end("period"))
    rows = {"period_end": ("high", late), "finite": ("high", strict_violation(value))} | ({"nonnegative": ("high", F.col(value) < 0)} if nonnegative else {})
    out = many_violations(df, name, rows).unionByName(check_grain(name, df, grain))
    if eligible is not None:
        foreign = df.select("region_id").join(eligible.select("region_id").distinct(), "region_id", "left_anti")
        out = out.unionByName(counted(foreign, "eligible_region", name, "high", F.count(F.lit(1))))
    return out


def check_references(tables: dict[str, DataFrame], dimension: DataFrame, key: str = "region_id") -> DataFrame:
    """Per table: keys unknown to the dimension, and dimension keys it lacks."""
    known, out = dimension.select(key).distinct(), []
    for name, df in tables.items():
        mine = df.select(key).distinct()
        out.append(counted(mine.join(known, key, "left_anti"), "foreign_key", name, "high", F.count(F.lit(1))))
        out.append(counted(known.join(mine, key, "left_anti"), "whole_population", name, "medium", F.count(F.lit(1)), "warning"))
    return reduce(DataFrame.unionByName, out)


def parity(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """Counts of the verdicts of two builds' rows."""
    from .joins import parity_join

    return parity_join(a, b, keys, values, tolerance).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def compare_frames(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-9, atol: float = 0.0) -> DataFrame:
    """Rows of either frame that have no equal row in the other, by key, with numbers compared within rtol and atol."""
    from pyspark.sql.types import NumericType

    values = [c for c in a.columns if c not in keys]
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in values], F.lit(1).alias("_a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in values], F.lit(1).alias("_b"))
    numeric = {f.name for f in a.schema if isinstance(f.dataType, NumericType)}
    same = [F.col("_a").isNotNull() & F.col("_b").isNotNull()]
    for c in values:
        equal = F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        close = F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= atol + rtol * F.abs(F.col(f"b_{c}")), F.lit(False)) if c in numeric else F.lit(False)
        same.append(equal | close)
    return left.join(right, keys, "full_outer").filter(~reduce(lambda x, y: x & y, same)).drop("_a", "_b")


def mixed_provenance(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Groups whose rows disagree in a lineage field: equal totals don't make them one source. Nulls are a value."""
    kinds = [F.size(F.collect_set(F.coalesce(F.col(f).cast("string"), F.lit("\0")))).alias(f"n_{f}") for f in fields]
    return df.groupBy(*keys).agg(*kinds).filter(reduce(lambda a, b: a | b, [F.col(f"n_{f}") > 1 for f in fields]))
