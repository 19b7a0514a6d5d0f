"""Table functions over file payloads, called from SQL."""

import io
import zipfile

import pytest
from test_files import workbook

from tidemark.sources import files, table_functions
from tidemark.sources.decode import packed

PAGE = "<table><tr><th>Name</th><td> 1 000 </td></tr><tr><td>x</td></tr></table><a href='a.html'> A  b </a><a>none</a>"


@pytest.fixture(scope="module")
def sql(spark):
    table_functions.register(spark)
    table_functions.register(spark)
    return spark.sql


def test_workbook_cells(spark, sql, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook({"01(2026)": {"A1": "x", "C2": "ž"}, "02(2026)": {"B1": "y"}, "other": {"A1": "z"}}))
    (tmp_path / "bad.xlsx").write_bytes(b"not a workbook")
    held = files.payloads(spark, str(tmp_path), "*.xlsx")
    got = sql("SELECT reverse(split(path, '/'))[0] AS f, c.* FROM {held} f, LATERAL workbook_cells(f.content, sheets => '__(2026)') c", held=held).collect()
    assert sorted(tuple(r)[:5] for r in got if r.error is None) == [("a.xlsx", "01(2026)", 1, 1, "x"), ("a.xlsx", "01(2026)", 2, 3, "ž"), ("a.xlsx", "02(2026)", 1, 2, "y")]
    assert [(r.f, r.sheet) for r in got if r.error] == [("bad.xlsx", None)]
    # The same cells as by the DataFrame operator.
    every = sql("SELECT path, c.* FROM {held} f, LATERAL workbook_cells(f.content) c", held=held)
    assert every.exceptAll(files.cells(held)).isEmpty() and files.cells(held).exceptAll(every).isEmpty()


def test_archive_rows_and_links(spark, sql):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("one.html", PAGE)
        z.writestr("two.HTM", PAGE.replace("1 000", "2"))
        z.writestr("note.txt", PAGE)
        z.writestr("inner.zip", packed("three.html", "<tr><td>й</td></tr>".encode("cp1251")))
        z.writestr("last.zip", b"broken")
    held = spark.createDataFrame([("a", out.getvalue()), ("b", b""), ("c", None)], "path string, content binary")
    got = sql("SELECT path, r.* FROM {held} f, LATERAL archive_rows(content) r", held=held).collect()
    assert [(r.member, r.ordinal, r.cells) for r in got if r.path == "a" and not r.error] == [
        ("one.html", 0, ["Name", "1 000"]), ("one.html", 1, ["x"]), ("two.HTM", 0, ["Name", "2"]), ("two.HTM", 1, ["x"]), ("inner.zip!three.html", 0, ["й"]),
    ]
    assert sorted((r.path, r.member, r.error.split(":")[0]) for r in got if r.error) == [("a", None, "BadZipFile"), ("b", None, "BadZipFile")]
    links = sql("SELECT r.* FROM {held} f, LATERAL archive_links(content, members => 't%') r WHERE error IS NULL", held=held).collect()
    assert [(r.member, r.place, r.label, r.href) for r in links] == [("two.HTM", 0, "A b", "a.html"), ("two.HTM", 1, "none", "")]


def test_html_links(spark, sql):
    held = spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "<a href=x>open")], "id int, html string")
    got = sql("SELECT id, l.* FROM {held} h, LATERAL html_links(html) l", held=held).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "A b", "a.html"), (1, 1, "none", "")]
    assert sql("SELECT * FROM {held} h, LATERAL html_links(html) l", held=held.limit(0)).collect() == []


@pytest.mark.parametrize("call", ["html_links(1)", "workbook_cells('text')", "archive_rows(X'00', members => concat('a', string(id)))", "archive_rows(X'00', members => 5)", "html_links()", "html_links('a', 'b')"])
def test_wrong_calls_fail_when_analysed(sql, call):
    with pytest.raises(Exception, match="TABLE_VALUED_FUNCTION|ANALYZE|REQUIRED|too many|takes|argument"):
        sql(f"SELECT * FROM range(1), LATERAL {call}").schema  # noqa: B018
