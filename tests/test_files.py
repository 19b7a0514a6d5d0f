"""File jobs on generated workbooks, archives and delimited files; publishing; the streaming panel."""

import io
import zipfile
from datetime import date
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from tidemark.contracts import CONTRACTS, SCOPE
from tidemark.operators import quality
from tidemark.plans import build
from tidemark.sources import files, publish
from tidemark.streaming import vintages


def workbook(sheets: dict[str, dict[str, str]]) -> bytes:
    out = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        strings = sorted({v for s in sheets.values() for v in s.values()})
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{escape(v)}</t></si>" for v in strings) + "</sst>")
        for i, cells in enumerate(sheets.values(), 1):
            rows = {}
            for ref, v in cells.items():
                rows.setdefault(int("".join(c for c in ref if c.isdigit())), []).append((ref, v))
            body = "".join(f'<row r="{r}">' + "".join(f'<c r="{ref}" t="s"><v>{strings.index(v)}</v></c>' for ref, v in sorted(c, key=lambda x: (len(x[0]), x[0]))) + "</row>" for r, c in sorted(rows.items()))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    monthly = {"B4": "2025 год", "D4": "2026", "B5": "январь", "C5": "декабрь", "D5": "январь", "A6": "Регион 1", "B6": "101,5", "C6": "…", "D6": "99", "A7": "Регион 2", "D7": "98"}
    annual = {"B4": "20241,2", "C4": "2025", "A5": "Регион 1", "B5": "104,2", "C5": "-"}
    cumulative = {"B4": "2026 год2", "B5": "январь", "C5": "январь-февраль", "D5": "январь-март3", "A6": "Регион 1", "B6": "100", "D6": "0"}
    price = {"C1": "P92", "D1": "other", "A3": "45286552001", "B3": "г. Москва", "C3": "60.5", "A4": "643", "B4": "Российская Федерация"}
    (tmp_path / "a.xlsx").write_bytes(workbook({"m": monthly, "y": annual, "c": cumulative, "02(2026)": price}))
    (tmp_path / "bad.xlsx").write_bytes(b"not a workbook")
    good, bad = files.split_status(files.cells(files.payloads(spark, str(tmp_path), "*.xlsx")))
    assert [(r.source_file, r.status) for r in bad.collect()] == [("bad.xlsx", "failed")] and "BadZipFile" in bad.first().message
    of = lambda s: good.filter(F.col("sheet") == s)
    got = {(r.label, r.period): (r.raw, r.value) for r in files.monthly_sheet(of("m"), 4, 5, 6).collect()}
    assert got == {("Регион 1", date(2025, 1, 31)): ("101,5", 101.5), ("Регион 1", date(2025, 12, 31)): ("…", None), ("Регион 1", date(2026, 1, 31)): ("99", 99.0), ("Регион 2", date(2025, 1, 31)): (None, None), ("Регион 2", date(2025, 12, 31)): (None, None), ("Регион 2", date(2026, 1, 31)): ("98", 98.0)}
    got = {r.period.year: (r.value, r.availability) for r in files.annual_sheet(of("y"), 4, 5).collect()}
    assert got == {2024: (104.2, "reported"), 2025: (None, "unavailable_source_marker")}
    got = {r.window_months: (r.period, r.value, r.availability) for r in files.cumulative_sheet(of("c"), 4, 5, 6).collect()}
    assert got == {1: (date(2026, 1, 31), 100.0, "reported"), 2: (date(2026, 2, 28), None, "unavailable"), 3: (date(2026, 3, 31), 0.0, "reported")}
    got = {r.scope: (r.fuel_grade, r.source_price, r.period) for r in files.price_sheet(of("02(2026)"), 1, 3, {"P92": "AI-92"}).collect()}
    assert got == {"surveyed_city": ("AI-92", "60.5", date(2026, 2, 1)), "national": ("AI-92", None, date(2026, 2, 1))}


def test_archives(spark, tmp_path):
    report = "<table><tr><th>Наименование</th><th>План</th><th>Исполнено</th></tr><tr><td>Доходы</td><td>1 000,50</td><td>900,25</td></tr><tr><td>в том числе</td><td>1</td><td>2</td></tr></table>"
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("Mes_01.html", report.encode("cp1251"))
        z.writestr("TerrList.html", '<a href="Mes_01.html"> Регион  1 </a>')
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("inner.zip", inner.getvalue())
    (tmp_path / "report_01.04.2026.zip").write_bytes(outer.getvalue())
    (tmp_path / "report_01.05.2026.zip").write_bytes(b"broken")
    payload = files.payloads(spark, str(tmp_path), "*.zip")
    good, bad = files.split_status(files.archive_rows(payload))
    assert bad.count() == 1
    rows = files.report_rows(good, "План", "Исполнено").orderBy("ordinal").collect()
    assert [(r.name, float(r.plan_rub), float(r.actual_rub)) for r in rows] == [("Доходы", 1000.5, 900.25), ("в том числе", 1.0, 2.0)]
    top = files.report_rows(good, "План", "Исполнено", ~F.get("cells", F.lit(0)).startswith("в том"))
    assert top.count() == 1
    links = files.archive_catalogue(payload).filter("href IS NOT NULL").collect()
    assert [(r.label, r.href) for r in links] == [("Регион 1", "Mes_01.html")]
    assert {r.period for r in files.dated_names(payload.select("path")).collect()} == {date(2026, 3, 31), date(2026, 4, 30)}


def test_archives_nested_too_deep_are_errors():
    from tidemark.sources.decode import archive_members

    inner = b"text"
    for i in range(5):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a.txt" if i == 0 else f"{i}.zip", inner)
        inner = out.getvalue()
    assert [n for n, _ in archive_members(inner)] == ["4.zip!3.zip!2.zip!1.zip!a.txt"]
    with pytest.raises(ValueError, match="too deep"):
        list(archive_members(inner, depth=3))


def test_delimited_and_hashes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿code;v\n001;5\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("code,v\n002,6\n", encoding="utf-8")
    (tmp_path / "b (1).csv").write_text("code,v\n002,6\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("code,v\n003,p;q;r;s\n", encoding="utf-8")  # the first line alone decides
    got = sorted((r.code, r.v) for r in files.read_delimited(spark, str(tmp_path), "code string, v string").collect())
    assert got == [("001", "5"), ("002", "6"), ("002", "6"), ("003", "p;q;r;s")]
    (tmp_path / "c.csv").unlink()
    one = files.distinct_files(files.payloads(spark, str(tmp_path))).collect()
    assert {(r.name, r.n_copies) for r in one} == {("a.csv", 1), ("b.csv", 2)}
    inventory = files.inventory(files.payloads(spark, str(tmp_path))).collect()
    assert {r.family for r in inventory} == {"csv"} and sorted(r.n_equal for r in inventory) == [1, 2, 2]
    good, bad = files.admitted(spark.createDataFrame([("a", "1"), ("b", "2")], "file string, release string"), spark.createDataFrame([("1",)], "release string"), "release")
    assert [r.file for r in good.collect()] == ["a"] and [r.reason for r in bad.collect()] == ["missing_dictionary"]


def test_publish(spark, tmp_path):
    df = spark.createDataFrame([("r1", "R", "Р", "77", "45", "d", "p", date(2020, 1, 31), None)], CONTRACTS["regions"])
    events = quality.validate("regions", df)
    manifest = publish.promote({"regions": df}, events, f"{tmp_path}/out")
    assert manifest.first().n_rows == 1
    with pytest.raises(Exception, match="already exists"):
        publish.promote({"regions": df}, events, f"{tmp_path}/out")
    with pytest.raises(ValueError, match="unique_grain"):
        publish.promote({"regions": df.union(df)}, quality.validate("regions", df.union(df)), f"{tmp_path}/other")
    found, errors = files.load_tables(spark, f"{tmp_path}/out", CONTRACTS)
    assert set(found) == {"regions"} and found["regions"].count() == 1 and not errors
    publish.write_csv(df.withColumn("tags", F.array(F.lit("a"))).withColumn("none", F.lit(None).cast("string")), f"{tmp_path}/csv", compressed=True)
    back = files.read_gzip(spark, f"{tmp_path}/csv", "region_id string, a string, b string, fns_code string, c string, d string, e string, f string, g string, tags string, none string").first()
    assert back.fns_code == "77" and back.tags == '["a"]' and back.none is None
    sums = publish.checksums(spark, f"{tmp_path}/csv", "*.csv.gz")
    assert publish.verified(spark, f"{tmp_path}/csv", sums, df).count() == 1
    with pytest.raises(ValueError, match="differ"):
        publish.verified(spark, f"{tmp_path}/csv", sums.withColumn("sha256", F.lit("0")), df)


def test_build(spark, tmp_path):
    regions = spark.createDataFrame([("r1", "R", "Р", None, None, None, None, None, None)], CONTRACTS["regions"])
    budget = spark.createDataFrame([("r1", "R", "Р", date(2026, 3, 31), "quarterly", SCOPE, "101", "PIT", "НДФЛ", v, None, None, "s", "2026", "latest", "verified", True) for v in (100.0,)], CONTRACTS["budget_execution"])
    receipts = spark.createDataFrame([("r1", "R", "Р", date(2026, 4, 1), date(2026, 3, 31), "quarterly", "B", "B", "x", "x", 120.0, 120.0, None, "s", "2026", "latest", "verified", True)], CONTRACTS["pit_receipts"])
    register = [spark.createDataFrame([("s", p, "d", None, path, None, None, None, "RUB", "0" * 64, 1, True, None)], CONTRACTS["sources"]) for p, path in (("old", "a.csv"), ("new", "/home/me/raw/b.csv"))]
    tables, events = build.build({"regions": regions, "budget_execution": budget, "pit_receipts": receipts}, sources=register, budget_pit="101")
    assert [r.publisher for r in tables["sources"].collect()] == ["new"]
    seen = {(r.table_name, r.check_id): r.status for r in events.collect()}
    assert seen["pit_receipts", "pit_reconciliation"] == "warning" and seen["pit_receipts", "core_table_not_empty"] == "passed" and "failed" not in seen.values()
    manifest = build.build_and_promote({"regions": regions, "budget_execution": budget}, f"{tmp_path}/snapshot", sources=register)
    assert {r.table_name: r.n_rows for r in manifest.collect()} == {"regions": 1, "budget_execution": 1, "sources": 1}
    assert spark.read.parquet(f"{tmp_path}/snapshot/sources.parquet").first().local_path == "b.csv"
    with pytest.raises(ValueError, match="core_table_not_empty"):
        build.build_and_promote({"pit_receipts": receipts.limit(0)}, f"{tmp_path}/none")
    leak = regions.withColumn("economic_profile", F.lit("see https://me:secret@host/x"))
    with pytest.raises(Exception, match="credential"):
        publish.publishable("regions", leak).collect()


def test_streamed_vintages(spark, tmp_path):
    schema = "region_id string, vintage int, value double"
    landing = f"{tmp_path}/landing"
    for n, rows in enumerate(([("a", 2, 1.0), ("b", 1, 5.0)], [("a", 1, 9.0), ("b", 3, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{landing}/batch={n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(landing)
        query = vintages.maintain(stream, f"{tmp_path}/panel", f"{tmp_path}/check", ["region_id"], "vintage")
        query.processAllAvailable()
        query.stop()
    got = {r.region_id: (r.vintage, r.value) for r in vintages.current(spark, f"{tmp_path}/panel").collect()}
    assert got == {"a": (2, 1.0), "b": (3, None)}
