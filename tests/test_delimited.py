"""Delimited files: separators found by tasks, the CSV sink with its manifest, and shapes of files that many tasks read."""

import gzip
import hashlib
import json
import os
from collections import Counter
from datetime import date, datetime
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.queries.files import QUERIES
from tidemark.sources import csv_sink, files, publish


def test_quoted_fields_and_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('\ufeffcode;note;v\n001;"a;b ""c""\nd";1,5\n002;;x\n\n003;short\n004;long;2;3;4\n'.encode())
    (tmp_path / "b.csv").write_bytes('code,note,v\r\n005,"x,y",7\r\n'.encode())
    (tmp_path / "c.csv").write_bytes("code,note,v;w\n006,ü;,8\n".encode())
    for name, body in (("empty.csv", b""), ("header.csv", b"code,note,v\n"), ("d.txt", b"code\n9\n")):
        (tmp_path / name).write_bytes(body)
    got = {r.code: (r.note, r.v) for r in files.read_delimited(spark, str(tmp_path), "code string, note string, v double").collect()}
    assert got == {"001": ('a;b "c"\nd', None), "002": (None, None), "003": ("short", None), "004": ("long", 2.0), "005": ("x,y", 7.0), "006": ("ü;", 8.0)}
    (tmp_path / "f.csv").write_bytes("имя;v\nЯ;1\n".encode("cp1251"))
    assert files.read_delimited(spark, str(tmp_path), "name string, v int", "f.csv", "cp1251").collect() == [("Я", 1)]
    assert files.read_delimited(spark, str(tmp_path), "name string", "none*").collect() == []


def test_ten_thousand_files(spark, tmp_path):
    for i in range(10_000):
        sep = ";" if i % 3 else ","
        (tmp_path / f"{i}.csv").write_text(f'k{sep}v\n{i}{sep}"{i}{sep}x"\n')
    df = files.read_delimited(spark, str(tmp_path), "k long, v string")
    good = F.col("v") == F.concat("k", F.when(F.col("k") % 3 == 0, ",x").otherwise(";x"))
    assert df.agg(F.count("*"), F.count_distinct("k"), F.bool_and(good)).first()[:] == (10_000, 10_000, True)


ROWS = [(1, 0.1, "a,b", date(2026, 3, 31), True, ["x"]), (2, 1e300, 'q"\n', None, None, None), (3, None, "é", date(1, 1, 1), False, []), (4, 1 / 3, "", None, None, None)]
SCHEMA = "id long, v double, s string, d date, b boolean, tags array<string>"


def test_sink(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    told = publish.write_csv(df, f"{tmp_path}/out").collect()
    body = (tmp_path / "out" / told[0].source_file).read_bytes()
    want = '\ufeffid,v,s,d,b,tags\n1,0.10000000000000001,"a,b",2026-03-31,true,"[""x""]"\n2,1.0000000000000001e+300,"q""\n",,,\n3,,é,0001-01-01,false,[]\n4,0.33333333333333331,,,,\n'
    assert body.decode() == want and [(r.rows, r.bytes, r.sha256) for r in told] == [(4, len(body), hashlib.sha256(body).hexdigest())]
    back = files.read_delimited(spark, f"{tmp_path}/out", SCHEMA.replace("array<string>", "string")).drop("tags").orderBy("id").collect()
    assert [tuple(r) for r in back] == [(*r[:2], r[2] or None, *r[3:5]) for r in ROWS]
    packed = publish.write_csv(df, f"{tmp_path}/gz", compressed=True, sep=";").first()
    raw = (tmp_path / "gz" / packed.source_file).read_bytes()
    want = '\ufeffid;v;s;d;b;tags\n1;0.10000000000000001;a,b;2026-03-31;true;"[""x""]"\n2;1.0000000000000001e+300;"q""\n";;;\n3;;é;0001-01-01;false;[]\n4;0.33333333333333331;;;;\n'
    assert gzip.decompress(raw).decode() == want
    # Equal rows, equal bytes.
    assert publish.write_csv(df, f"{tmp_path}/again", compressed=True, sep=";").first().sha256 == packed.sha256 == hashlib.sha256(raw).hexdigest()
    assert publish.verified(spark, f"{tmp_path}/gz", packed_manifest := publish.csv_manifest(spark, f"{tmp_path}/gz").select("source_file", "sha256"), df).count() == 4
    (tmp_path / "gz" / packed.source_file).write_bytes(raw + b"x")
    with pytest.raises(ValueError, match="differ"):
        publish.verified(spark, f"{tmp_path}/gz", packed_manifest, df)


def test_sink_is_whole_or_not_there(spark, tmp_path):
    df = spark.range(100).repartition(4)
    assert publish.write_csv(df, f"{tmp_path}/out").agg(F.sum("rows")).first()[0] == 100
    with pytest.raises(Exception, match="already exists"):
        publish.write_csv(df, f"{tmp_path}/out")
    with pytest.raises(Exception, match="no space"):
        publish.write_csv(df.select(F.when(F.col("id") == 77, F.raise_error(F.lit("no space"))).otherwise(F.col("id")).alias("id")), f"{tmp_path}/bad")
    assert not os.path.exists(f"{tmp_path}/bad")
    assert publish.write_csv(df.limit(0), f"{tmp_path}/none").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] == 0
    # A task that ran twice has left a file that no message names.
    writer = csv_sink.CsvWriter({"path": f"{tmp_path}/out"}, df.schema)
    held = json.loads((tmp_path / "out" / csv_sink.MANIFEST).read_text())
    (tmp_path / "out" / "part-00000-other.csv").write_text("id\n1\n")
    writer.commit([csv_sink.Written(**m) for m in held] + [None])
    assert {f for f in os.listdir(tmp_path / "out") if f.startswith("part")} == {m["file"] for m in held}


def test_round_trip_is_whole(spark, tmp_path):
    """No order is left over, and files of all four kinds are written and read."""
    odd = [(None, "F"), (None, None), ("", None), ("F", ""), ("O", ' a;b,"c"\r\nd '), ("P", '""'), ("P", "1-URGENT"), ("F", "\ufeffé")]
    rows = [(i if i % 7 else None, odd[i % 8][0], i / 3 if i % 5 else None, datetime(1995, 1, 1 + i % 28) if i % 3 else None, odd[i % 8][1]) for i in range(64)]
    rows += [(None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    df.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    back = QUERIES["a02_delimited_round_trip"][0](spark, str(tmp_path))
    assert Counter(tuple(r) for r in back.collect()) == Counter((k, s, v, d and d.date(), p) for k, s, v, d, p in rows)
    kinds = Counter()
    for folder in {os.path.dirname(unquote(urlparse(f).path)) for f in back.inputFiles()}:
        for file, n in publish.csv_manifest(spark, folder).select("source_file", "rows").collect():
            with (gzip.open if file.endswith(".csv.gz") else open)(f"{folder}/{file}", "rt", encoding="utf-8-sig") as f:
                kinds[file.endswith(".csv.gz"), files.separator(f.readline())] += n
    assert len(kinds) == 4 and min(kinds.values()) > 0 and sum(kinds.values()) == len(rows)


def test_packed_files(spark, tmp_path):
    """Packing is found out by content; a packed file that is cut off fails, and isn't read in part."""
    body = "\ufeffcode;note\n" + "".join(f'{i};"a;{i}"\n' for i in range(5000))
    (tmp_path / "a.csv").write_bytes(gzip.compress(body[: len(body) // 2].encode()) + gzip.compress(body[len(body) // 2 :].encode()))
    (tmp_path / "b.csv").write_text("code,note\n5000,a;5000\n")
    good = F.col("note") == F.concat(F.lit("a;"), "code")
    assert files.read_delimited(spark, str(tmp_path), "code long, note string").agg(F.count("*"), F.count_distinct("code"), F.bool_and(good)).first()[:] == (5001, 5001, True)
    (tmp_path / "c.csv").write_bytes(gzip.compress(body.encode())[:-100])
    with pytest.raises(Exception, match="EOFError"):
        files.read_delimited(spark, str(tmp_path), "code long, note string").collect()


def test_long_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"k,text\n1,{'x' * 200_000}\n")
    assert files.read_delimited(spark, str(tmp_path), "k long, text string").select("k", F.length("text")).collect() == [(1, 200_000)]


def test_empty_texts_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "", None), (2, None, ""), (None, None, None)], "k long, a string, b string").coalesce(1)
    told = publish.write_csv(df, f"{tmp_path}/out", sep=";", quoted=True).first()
    assert (tmp_path / "out" / told.source_file).read_text(encoding="utf-8") == '\ufeff"k";"a";"b"\n"1";"";\n"2";;""\n;;\n'
    assert Counter(map(tuple, files.read_delimited(spark, f"{tmp_path}/out", "k long, a string, b string", quoted=True).collect())) == Counter(map(tuple, df.collect()))
    short = "k;a;b\n1\n2;\n3;;;4\n"
    (tmp_path / "short.csv").write_text(short)
    assert files.read_delimited(spark, str(tmp_path), "k long, a string, b string", "short.csv", quoted=True).collect() == [(1, None, None), (2, None, None), (3, None, None)]


def test_shapes_of_files_in_many_splits(spark, tmp_path):
    wide = "".join(f"{i};b;c\n" if i % 100 else f"{i};b\n" for i in range(1, 20_001))
    (tmp_path / "big.csv").write_text("k;a,b,c;v\n" + wide)  # three commas in a quoteless head: as many as it has
    (tmp_path / "semi.csv").write_text("k;a;v\n" + wide)
    (tmp_path / "quoted.csv").write_text('k,"a;;;b",v\n1,"x,y",2\n\n1,2\n')
    (tmp_path / "one.csv").write_text("k\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = files.text_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10
        got = {r.path.split("/")[-1]: tuple(r)[1:] for r in files.file_shapes(lines).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"big.csv": (",", 3, 20_000, 20_000, 0), "semi.csv": (";", 3, 20_000, 200, 0), "quoted.csv": (";", 1, 3, 0, 1), "one.csv": (",", 1, 0, 0, 0)}
    plan = files.file_shapes(files.text_lines(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2  # the same scan on both sides of one join, whose exchange is reused


BASIS = "В % к соответствующему периоду предыдущего года"


def cumulative(years, title="Индекс производства: добыча", basis=BASIS, holes=(), **extra):
    """Cells of a sheet whose year blocks are (header, windows)."""
    cells, col = {(2, 1): title, (3, 1): basis, (6, 1): "Регион"}, 2
    for head, windows in years:
        for i, w in enumerate(windows):
            cells |= ({(4, col): head} if i == 0 and head else {}) | ({(5, col): w} if w else {}) | {(6, col): str(100 + col)}
            col += 1
    return {k: v for k, v in cells.items() if k not in holes}


def months(n):
    from tidemark.functions.text import MONTHS_RU

    return ["Январь" if i == 0 else f"январь–{m}{i}" for i, m in enumerate(MONTHS_RU[:n])]


def test_headers_of_cumulative_sheets(spark):
    good = [("2024 год", months(12)), ("2025 год3", months(12)), ("2026  год", months(3))]
    cases = {
        "matched": cumulative(good), "unexpected_title": cumulative(good, title="Индекс"), "unexpected_basis": cumulative(good, basis="в %"), "invalid_year_header": cumulative([("2025 г.", months(2))]),
        "repeated_year": cumulative([("2025 год", months(12)), ("2025 год", months(12))]), "years_not_contiguous": cumulative([("2023 год", months(12)), ("2025 год", months(2))]),
        "windows_not_from_january": cumulative([("2025 год", ["январь-февраль", "январь-март"])]), "incomplete_year": cumulative([("2024 год", months(11)), ("2025 год", months(1))]),
        "missing_header": cumulative(good, holes=[(5, 4)]), "january again": cumulative([("2025 год", ["январь", "январь-январь"])]), "year in window": cumulative([("2025 год", ["2025 январь"])]), "no years": cumulative([(None, months(2))]),
    }
    df = spark.createDataFrame([("f", name, r, c, v) for name, cells in cases.items() for (r, c), v in cells.items()], "path string, sheet string, row int, col int, value string")
    got = {r.sheet: r.issues for r in files.cumulative_issues(df, 2, 3, 4, 5, "Добыча").collect()}
    for name in cases:
        if name in ("january again", "year in window"):
            assert got[name] == "windows_not_from_january"
        elif name == "no years":
            assert "missing_header" in got[name]
        else:
            assert name in got[name].split(";")
    assert got["matched"] == "matched" and got["incomplete_year"] == "incomplete_year" and got["repeated_year"] == "repeated_year"
    only = lambda name: files.checked_cumulative_sheet(df.filter(F.col("sheet") == name), 2, 3, 4, 5, 6, "добыча")
    assert only("matched").count() == 27
    with pytest.raises(Exception, match="incomplete_year"):
        only("incomplete_year").collect()
