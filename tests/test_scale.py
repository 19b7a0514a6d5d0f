"""Steps whose cost must not follow the size of one group, file or key."""

import tracemalloc
from datetime import date
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.contracts import CONTRACTS
from tidemark.functions import text
from tidemark.llm import simhash
from tidemark.llm.common import components
from tidemark.plans import build, overview
from tidemark.sources import csv_sink, files, publish


def test_source_rollup_meets_by_key_only_as_sources(spark):
    """No window over the facts of a key; null keys, sources and periods as before."""
    a, b = date(2024, 1, 31), date(2024, 2, 29)
    rows = [("x", "1", a), ("x", "1", b), ("x", "2", b), ("x", "2", b), ("x", "3", a), ("x", None, b), ("x", "9", b), (None, "1", a), (None, "3", None), ("y", "2", None)]
    facts = spark.createDataFrame(rows, "k string, sid string, period date")
    register = spark.createDataFrame([("1", "one"), ("2", "two"), ("3", "three")], "source_id string, name string")
    out = overview.source_rollup(facts, register, ["k"], "sid", "name")
    assert {tuple(r) for r in out.collect()} == {("x", b, 3, "one, two"), (None, a, 1, "one")}
    many = spark.range(1000).select(F.lit("x").alias("k"), F.col("id").cast("string").alias("sid"), F.lit(a).alias("period"))
    plan = overview.source_rollup(many, register, ["k"], "sid", "name")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_a_build_computes_its_tables_once(spark, tmp_path):
    """The gate asks whether core tables are empty from the rows that were written; events are those of before."""
    n = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(x):
        n.add(1)
        return True

    names = {"region_id", "period", "budget_level", "revenue_code", "source_id", "source_vintage", "actual_ytd_rub", "quality_status"}
    df = spark.range(40).select(F.col("id").cast("string").alias("region_id"), F.lit(date(2026, 3, 31)).alias("period"), F.lit("x").alias("budget_level"), F.lit("1").alias("revenue_code"), F.lit("s").alias("source_id"), F.lit("2026").alias("source_vintage"), F.lit(1.0).alias("actual_ytd_rub"), F.lit("verified").alias("quality_status"))
    df = df.select(*[(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in CONTRACTS["budget_execution"]])
    build.build_and_promote({"budget_execution": df.filter(seen("region_id"))}, f"{tmp_path}/out")
    assert n.value == 40
    _, told, events = publish.snapshot(spark, f"{tmp_path}/out")
    assert told.first()["n_rows"] == 40
    assert [tuple(r) for r in events.filter("check_id = 'core_table_not_empty'").collect()] == [("core_table_not_empty", "budget_execution", "critical", "passed", 0, 0)]


def test_a_partition_is_written_as_many_files(spark, tmp_path):
    """Readers that take files whole don't get a whole partition: rows go on in a next file."""
    df = spark.range(900_000).coalesce(1).select("id", F.repeat(F.lit("x"), 60).alias("text"))
    told = publish.write_csv(df, f"{tmp_path}/out").collect()
    assert len(told) > 1 and sum(r.rows for r in told) == 900_000 and max(r.bytes for r in told) < csv_sink.FILE_BYTES + (2 << 20)
    back = files.read_delimited(spark, f"{tmp_path}/out", "id long, text string")
    assert back.agg(F.count("*"), F.sum("id"), F.min("text"), F.max("text")).first() == (900_000, 900_000 * 899_999 // 2, "x" * 60, "x" * 60)
    packed = publish.write_csv(df, f"{tmp_path}/gz", compressed=True)
    found = {r.source_file: r.sha256 for r in publish.checksums(spark, f"{tmp_path}/gz", "*.csv.gz").collect()}
    assert len(found) > 1 and found == {r.source_file: r.sha256 for r in packed.collect()}


def test_a_file_is_parsed_as_a_stream():
    """What is held beside the payload doesn't follow the file's size."""
    line = "1;ä\r\n" + '"a\r\nb";\n'
    payload = pa.array([("\ufeffk;v\n" + line * 300_000).encode(), b"", b"k,v\r1,2\r", b"k,v\n\xff,2"], pa.binary())
    tracemalloc.start()
    n, seen = 0, []
    for b in files._records(2, "UTF-8")([pa.record_batch([payload], ["content"])]):
        n += len(b)
        seen = [*seen[:2], *zip(*(c.to_pylist() for c in b.columns))][:2] + [r for r in zip(*(c.to_pylist() for c in b.columns))][-1:]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 600_002 and seen == [("1", "ä"), ("a\r\nb", None), ("\ufffd", "2")] and peak < 20_000_000


def test_cells_are_those_of_each_value():
    columns = [[0.0, -0.0, None, float("nan"), 1e300, 0.1], ["a", None, "", "a"], [date(2024, 1, 2), None, date(2024, 1, 2)], [True, False, None], [Decimal("1.10"), None], [None, None], [5, None, -5]]
    assert [csv_sink.cells(pa.array(c)) for c in columns] == [[csv_sink.cell(x) for x in c] for c in columns]


def test_machine_paths_are_looked_for_by_fixed_characters(spark):
    """The same verdicts as by one expression over the whole text, which is not run on texts without a drive's mark."""
    shape = r"/(?:Users|home|private|tmp|var/folders)/|(?:^|[^A-Za-z0-9])[A-Za-z]:[\\/]"
    texts = ["/Users/a", "x /home/b c", "/homes/b", "/private", "/tmp/", "a/var/folders/b", "/var/b", "c:/x", "see D:\\x y", "ab:/x", "1c:/x", "éc:\\x", "https://a.b/c", "c:x", "C:\\", "\nc:/", "/users/a", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", text.sensitive("t")["machine_path"].alias("is"), F.coalesce(F.col("t").rlike(shape), F.lit(False)).alias("want"), text.sanitized("t").alias("clean")).collect()
    assert [r["is"] for r in got] == [r["want"] for r in got] and sum(r["is"] for r in got) == 9
    assert [r["clean"] for r in got][:4] == ["a", None, "/homes/b", "/private"] and [r["clean"] for r in got][7:10] == ["x", None, "ab:/x"]
    assert "(?:Users" not in str(text.sensitive("t")["machine_path"])


def test_links_of_a_dense_group_are_a_few_a_text(spark):
    """Near texts that meet under many keys, and two chains beside them: as few links as nodes ask for, the same components."""
    rng = np.random.default_rng(5)
    keyed = [(int(k), int(x)) for k in range(400) for x in rng.choice(400, 40, replace=False)]  # any two differ in 9 bits or less
    keyed += [(1_000 + i, x) for i in range(30) for x in (1 << 40 | (1 << i) - 1, 1 << 40 | (1 << i + 1) - 1)] + [(2_000, 1 << 60), (2_000, 1 << 60 | 1), (2_001, 3 << 50)]
    links = [tuple(r) for r in simhash.links_over(spark.createDataFrame(keyed, "key int, fp long").repartition(8), 2_000, 9).collect()]
    assert len(links) == len(set(links)) < 3 * 400 and all(a > b for a, b in links)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    chain = {1 << 40 | (1 << i) - 1: 1 << 40 for i in range(31)}
    assert found == {x: 0 for x in range(400)} | chain | {1 << 60: 1 << 60, 1 << 60 | 1: 1 << 60}
