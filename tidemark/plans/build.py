"""From ingested tables to a published snapshot: all checks, the gate, then the files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality
from ..operators.windows import keep_last
from ..sources.publish import promote

CORE = ("pit_receipts", "industrial_production", "budget_execution")


def build(tables: dict[str, DataFrame], sources: Sequence[DataFrame] = (), rejects: DataFrame | None = None, budget_pit: str | None = None, generic: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, events): what was ingested, under the contracts' names, and the events of all checks over it.

    sources: registers of several readers, of which the last row of an id stays. rejects: a column `reason` for each file
    that was left out. budget_pit: the revenue code whose budget amounts receipts are reconciled with. An empty core
    table is critical; other gaps are warnings. generic: whether each table's own checks, and whether core tables are empty, are among the
    events; they need not be where `promote` makes them while it writes.
    """
    tables = dict(tables)
    if sources:
        tables["sources"] = keep_last(list(sources), ["source_id"])
    events = [quality.validate(name, df) for name, df in tables.items()] if generic else []
    core = {name: tables[name] for name in CORE if name in tables}
    if rejects is None and core:
        rejects = next(iter(core.values())).select(F.lit("none").alias("reason")).limit(0)
    if rejects is not None:
        events.append(quality.source_coverage(rejects, "reason", core if generic else {}))
    if budget_pit and {"pit_receipts", "budget_execution"} <= set(tables):
        budget = tables["budget_execution"].filter(F.col("revenue_code") == budget_pit)
        gaps = quality.reconcile(tables["pit_receipts"], budget, ["region_id", "period"], "pit_ytd_rub", "actual_ytd_rub")
        events.append(quality.violations(gaps, "pit_reconciliation", "pit_receipts", "medium", F.col("status") == "warning", "warning"))
    return tables, reduce(DataFrame.unionByName, events) if events else next(iter(tables.values())).sparkSession.createDataFrame([], quality.EVENT)


def build_and_promote(tables: dict[str, DataFrame], folder: str, **more) -> DataFrame:
    """The manifest of the snapshot under `folder`; nothing is published where a check blocks."""
    tables, events = build(tables, generic=False, **more)
    return promote(tables, events, folder, CORE)
