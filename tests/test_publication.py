"""Publication: whole or not there, checked in the pass that writes."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.contracts import CONTRACTS
from tidemark.operators import quality
from tidemark.sources import publish


def receipts(spark, rows):
    """rows: (region, section, ytd, frequency)."""
    df = spark.createDataFrame([(r, s, v, f) for r, s, v, f in rows], "region_id string, okved_raw string, pit_ytd_rub double, frequency string")
    more = {"period": F.lit(date(2026, 3, 31)), "reporting_cutoff": F.lit(date(2026, 4, 1)), "source_id": F.lit("s"), "source_vintage": F.lit("2026"), "quality_status": F.lit("verified")}
    df = df.withColumns(more)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CONTRACTS["pit_receipts"]])


def regions(spark, n=3):
    df = spark.range(n).select(F.col("id").cast("string").alias("region_id"), F.lit("x").alias("region_name_en"), F.lit("x").alias("region_name_ru"))
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CONTRACTS["regions"]])


def left_over(tmp_path):
    return sorted(os.listdir(tmp_path))


ROWS = [("a", "B", 1.0, "quarterly"), ("a", "C", -1.0, "quarterly"), ("b", "B", None, "weekly"), ("b", "B", 2.0, None)] + [(None, "D", 1.0, "monthly")] * 3


def test_observed_checks_are_those_of_validate(spark, tmp_path):
    df = receipts(spark, ROWS).repartition(3)
    events, summary = publish.staged("pit_receipts", df, f"{tmp_path}/t")
    assert sorted(events) == sorted(tuple(r) for r in quality.validate("pit_receipts", df).collect())
    assert {(e[0], e[4]) for e in events if e[4]} == {("not_null:region_id", 3), ("not_null:pit_ytd_rub", 1), ("domain:frequency", 1), ("nonnegative:pit_ytd_rub", 1), ("unique_grain", 5)}
    assert summary == ("pit_receipts", 7, date(2026, 3, 31), date(2026, 3, 31), 2)
    for name, other in (("pit_receipts", df.drop("source_id")), ("unknown", df.select("period")), ("regions", regions(spark, 0))):
        events, _ = publish.staged(name, other, f"{tmp_path}/{name}")
        assert sorted(events) == sorted(tuple(r) for r in quality.validate(name, other).collect())


def test_a_table_is_scanned_once(spark, tmp_path):
    """Checks, grain and summary add no scan and no second exchange to the write."""
    receipts(spark, ROWS).write.parquet(f"{tmp_path}/in")
    df, found = quality.observed("pit_receipts", spark.read.parquet(f"{tmp_path}/in"), {"latest": F.max("period")})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and plan.count("CollectMetrics") == 1
    assert df.columns == CONTRACTS["pit_receipts"].names and df.count() == len(ROWS) and found()[1] == {"rows": len(ROWS), "latest": date(2026, 3, 31)}


def test_snapshot(spark, tmp_path):
    good = receipts(spark, [("a", "B", 1.0, "quarterly"), ("b", "B", -2.0, "quarterly")])
    before = quality.check_nonnegative("other", good, "pit_ytd_rub")
    manifest = publish.promote({"pit_receipts": good, "regions": regions(spark)}, before, f"{tmp_path}/out")
    tables, told, events = publish.snapshot(spark, f"{tmp_path}/out")
    want = [("pit_receipts", 2, date(2026, 3, 31), date(2026, 3, 31), 2), ("regions", 3, None, None, 3)]
    assert [tuple(r) for r in told.collect()] == [tuple(r) for r in manifest.collect()] == want
    assert {n: df.count() for n, df in tables.items()} == {"pit_receipts": 2, "regions": 3}
    seen = {(r.table_name, r.check_id): r.status for r in events.collect()}
    assert seen["other", "nonnegative:pit_ytd_rub"] == "warning" and seen["regions", "unique_grain"] == "passed" and seen["pit_receipts", "nonnegative:pit_ytd_rub"] == "warning"
    assert left_over(tmp_path) == ["out"]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    """The third table's task fails after the first two are written."""
    broken = regions(spark).withColumn("region_name_en", F.when(F.col("region_id") == "2", F.raise_error(F.lit("disk full"))).otherwise(F.col("region_name_en")))
    with pytest.raises(Exception, match="disk full"):
        publish.promote({"pit_receipts": receipts(spark, ROWS[:1]), "sources_of": regions(spark), "regions": broken}, None, f"{tmp_path}/out")
    assert left_over(tmp_path) == []
    with pytest.raises(FileNotFoundError, match="no published snapshot"):
        publish.snapshot(spark, f"{tmp_path}/out")


def test_a_blocking_check_leaves_nothing(spark, tmp_path):
    with pytest.raises(ValueError, match="pit_receipts.domain:frequency, pit_receipts.not_null:pit_ytd_rub, pit_receipts.not_null:region_id, pit_receipts.unique_grain"):
        publish.promote({"regions": regions(spark), "pit_receipts": receipts(spark, ROWS)}, None, f"{tmp_path}/out")
    with pytest.raises(ValueError, match="known_table"):
        publish.promote({"unheard_of": regions(spark)}, None, f"{tmp_path}/out")
    assert left_over(tmp_path) == []


def test_a_taken_name_stays_as_it_is(spark, tmp_path, monkeypatch):
    publish.promote({"regions": regions(spark)}, None, f"{tmp_path}/out")
    with pytest.raises(FileExistsError, match="already exists"):
        publish.promote({"regions": regions(spark, 9)}, None, f"{tmp_path}/out")
    # Somebody else publishes under the name while this one is being written.
    monkeypatch.setattr(publish.Store, "exists", lambda self, path: False)
    with pytest.raises(Exception, match="exists"):
        publish.promote({"regions": regions(spark, 9)}, None, f"{tmp_path}/out")
    monkeypatch.undo()
    assert left_over(tmp_path) == ["out"] and publish.snapshot(spark, f"{tmp_path}/out")[1].first().n_rows == 3
