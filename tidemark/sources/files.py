"""Irregular statistical files as DataFrames: delimited text, workbooks, archives of HTML reports.

Payloads are read by Spark (binaryFile, text, csv) and decoded in tasks into plain rows of cells; all meaning (headers,
codes, units, dates) is then given to the rows by ordinary DataFrame operations. A file that can't be decoded gives
a row with its error, and the others go on.
"""

from __future__ import annotations

import csv
import gzip
import io
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import calendar as cal
from ..functions import text
from ..functions.lineage import issue_list
from ..functions.numbers import number, parse_decimal
from ..operators.windows import forward_fill
from ..shipping import ship
from .decode import archive_members, decoded, html_rows_and_links, packed, workbook_cells

PAYLOADS = "path string, modificationTime timestamp, length long, content binary"


def payloads(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def _rows(payload_rows, names: list[str], types: list[pa.DataType]):
    """Decoder of (path, payload) batches; an exception becomes a row with the error alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[tuple] = []
                try:
                    held = [(path, *r, None) for r in payload_rows(payload.as_py())]
                except Exception as e:  # any decoder's failure is the file's status
                    held = [(path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}")]
                for i in range(0, len(held), 20_000):
                    part = list(zip(*held[i : i + 20_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types, strict=True)], names)

    return run


def cells(files: DataFrame) -> DataFrame:
    """path, sheet, row, col, value, error of every non-empty workbook cell."""
    s, i = pa.string(), pa.int32()
    return files.select("path", "content").mapInArrow(_rows(workbook_cells, ["path", "sheet", "row", "col", "value", "error"], [s, s, i, i, s, s]), "path string, sheet string, row int, col int, value string, error string")


def _archive_rows(payload: bytes):
    for name, raw in archive_members(payload):
        if name.lower().endswith((".html", ".htm")):
            rows, _ = html_rows_and_links(decoded(raw))
            for n, r in enumerate(rows):
                yield name, n, r


def archive_rows(files: DataFrame) -> DataFrame:
    """path, member, ordinal, cells, error: table rows of all HTML members of archives, nested ones too."""
    s = pa.string()
    return files.select("path", "content").mapInArrow(_rows(_archive_rows, ["path", "member", "ordinal", "cells", "error"], [s, s, pa.int32(), pa.list_(s), s]), "path string, member string, ordinal int, cells array<string>, error string")


def _archive_links(payload: bytes):
    for name, raw in archive_members(payload):
        if name.lower().endswith((".html", ".htm")):
            for label, href in html_rows_and_links(decoded(raw))[1]:
                yield name, label, href


def archive_catalogue(files: DataFrame) -> DataFrame:
    """path, member, label, href, error: which report an entry of a catalogue page points to."""
    s = pa.string()
    return files.select("path", "content").mapInArrow(_rows(_archive_links, ["path", "member", "label", "href", "error"], [s] * 5), "path string, member string, label string, href string, error string")


def archived(pages: DataFrame, path: str, html: str, nested: bool = False) -> DataFrame:
    """path, length, content: a ZIP archive for each page, which is its member page.html; nested: inside another archive, inner.zip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                raw, name = (batch.column(1)[i].as_py() or "").encode(), "page.html"
                for member in (name, "inner.zip") if nested else (name,):
                    raw = packed(member, raw)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(raw)], pa.int64()), pa.array([raw], pa.binary())], ["path", "length", "content"])

    return pages.select(F.col(path).cast("string"), F.col(html).cast("string")).mapInArrow(run, "path string, length long, content binary")


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, place, href of every link in text columns of HTML, by expressions alone."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("place", "href"))


def split_status(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, errors): errors are quality events of their files."""
    good = rows.filter("error IS NULL").drop("error")
    bad = rows.filter("error IS NOT NULL").select(F.lit("unreadable_file").alias("check_id"), text.basename("path").alias("source_file"), F.lit("high").alias("severity"), F.lit("failed").alias("status"), F.col("error").alias("message"))
    return good, bad


def separator(line: str) -> str:
    """The separator that a file's first line names: ";" if it has more of them than ","."""
    return ";" if line.count(";") > line.count(",") else ","


def _records(width: int, encoding: str, quoted: bool = False):
    """Records of delimited files, of which each task finds separators and packing itself; short ones are filled up, long ones are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"_{i}" for i in range(width)]
        csv.field_size_limit(1 << 30)  # holds for the process that parses
        for batch in batches:
            for payload in batch.column(0):
                raw = pa.BufferReader(payload.as_buffer())
                is_gzip = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                body = io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if is_gzip else raw, encoding=encoding, errors="replace", newline="")
                head = [body.readline().removeprefix("\ufeff")]
                while not head[-1].endswith("\n") and (more := body.readline()):
                    head.append(more)
                lines = csv.reader(chain(head, body), delimiter=separator("".join(head)), quoting=csv.QUOTE_NOTNULL if quoted else csv.QUOTE_MINIMAL)
                next(lines, None)
                while held := list(islice(lines, 20_000)):
                    rows = [[*r[:width], *[None] * (width - len(r))] for r in held if r]
                    columns = [pa.array(c if quoted else [x or None for x in c], pa.string()) for c in zip(*rows, strict=True)] if rows else []
                    if columns:
                        yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_delimited(spark: SparkSession, path: str | list[str], schema: str, pattern: str = "*.csv", encoding: str = "UTF-8", quoted: bool = False) -> DataFrame:
    """CSV files whose separator is ";" where each file's first line has more of them than ",", else ","; a byte-order mark is dropped.

    Files are read once: the task that has a file sniffs and parses it, gzip too, and the driver knows no file by name. Quoted fields may hold
    separators, quotes and line feeds. Columns are taken by position; empty is null (quoted: only where it stands without quotes), as is what
    is no value of its column's type. A file has to fit in a task; one that was packed is unpacked as a stream."""
    fields = StructType.fromDDL(schema)
    rows = payloads(spark, path, pattern).select("content").mapInArrow(_records(len(fields), encoding, quoted), ", ".join(f"_{i} string" for i in range(len(fields))))
    return rows.select(*[F.col(f"_{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def read_gzip(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Compressed CSV with declared string types: codes keep their leading zeros, empty is null; quotes are doubled inside quotes."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("escape", '"').csv(path)


def load_tables(spark: SparkSession, folder: str, contracts: dict) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Parquet tables of a folder by contract, and errors: an absent table is left out, an unreadable one is an error; types are coerced."""
    found, errors = {}, {}
    for name, schema in contracts.items():
        try:
            df = spark.read.parquet(f"{folder}/{name}.parquet")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                errors[name] = str(e)
            continue
        date = lambda c: F.try_to_timestamp(F.col(c).cast("string")).cast("date")
        found[name] = df.select(*[(date(f.name) if f.dataType.simpleString() == "date" else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in schema if f.name in df.columns])
    return found, errors


def melted(df: DataFrame, dictionary: DataFrame, ids: list[str], field: str = "field", section: str = "section", factor: float = 1000.0, residual: str = "UNMAPPED") -> DataFrame:
    """Wide measures to long by a field dictionary (field, section); fields without a section are summed to `residual`.

    The dictionary chooses the columns; it is as long as the table is wide.
    """
    known = [r[0] for r in dictionary.select(field).distinct().collect()]
    measures = [c for c in df.columns if c in set(known)]
    long = df.unpivot(ids, [number(F.col(f"`{c}`")).alias(c) for c in measures], field, "value")
    named = long.join(F.broadcast(dictionary.select(field, section)), field)  # a row a column of df
    return named.groupBy(*ids, F.coalesce(section, F.lit(residual)).alias(section)).agg((F.sum("value") * factor).alias("value"))


def admitted(data: DataFrame, dictionaries: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(files whose exact dictionary exists, the others with a reason)."""
    good = data.join(dictionaries.select(key).distinct(), key, "left_semi")
    bad = data.join(dictionaries.select(key).distinct(), key, "left_anti").withColumn("reason", F.lit("missing_dictionary"))
    return good, bad


def distinct_files(files: DataFrame) -> DataFrame:
    """One file for each content, the canonical name before numbered copies; duplicates counted."""
    name = text.basename("path")
    copy = name.rlike(r"\(\d+\)|[ _-]copy").cast("int")
    hashed = files.withColumns({"sha256": F.sha2("content", 256), "name": name, "is_copy": copy}).drop("content")
    order = Window.partitionBy("sha256").orderBy("is_copy", "name", "path")
    n = F.count(F.lit(1)).over(Window.partitionBy("sha256"))
    return hashed.withColumns({"n_copies": n, "_rank": F.row_number().over(order)}).filter("_rank = 1").drop("_rank")


def dated_names(files: DataFrame, path: str = "path") -> DataFrame:
    """files with cutoff (DD.MM.YYYY in the name) and period, the day before it."""
    cutoff = cal.parse_date(text.basename(path))
    return files.withColumns({"cutoff": cutoff, "period": cal.cutoff_period(cutoff)})


def monthly_sheet(sheet: DataFrame, year_row: int, month_row: int, first_row: int, label_col: int = 1) -> DataFrame:
    """Cells of a sheet with merged year headers over months to path, sheet, label, period (month end), raw, value."""
    keys = ["path", "sheet"]
    years = sheet.filter(F.col("row") == year_row).select(*keys, "col", F.regexp_extract("value", r"(20\d{2})", 1).try_cast("int").alias("year"))
    months = sheet.filter(F.col("row") == month_row).select(*keys, "col", F.coalesce(*[F.when(F.lower(F.trim("value")).startswith(m), F.lit(i + 1)) for i, m in enumerate(text.MONTHS_RU)]).alias("month"))
    headers = forward_fill(months.join(years, [*keys, "col"], "left"), "year", keys, "col").filter("year IS NOT NULL AND month IS NOT NULL")
    labels = sheet.filter((F.col("col") == label_col) & (F.col("row") >= first_row)).select(*keys, "row", F.trim("value").alias("label"))
    body = sheet.filter(F.col("row") >= first_row).select(*keys, "row", "col", F.col("value").alias("raw"))
    grid = labels.join(headers, keys).join(body, [*keys, "row", "col"], "left")  # every header for every label: missing cells stay
    return grid.select(*keys, "label", F.last_day(F.make_date("year", "month", F.lit(1))).alias("period"), "raw", number(F.replace("raw", F.lit(","), F.lit("."))).alias("value"))


def annual_sheet(sheet: DataFrame, header_row: int, first_row: int, label_col: int = 1) -> DataFrame:
    """As monthly_sheet, for one header row of years that may carry footnote digits ("20241,2")."""
    keys = ["path", "sheet"]
    headers = sheet.filter((F.col("row") == header_row) & (F.col("col") > label_col)).select(*keys, "col", F.regexp_extract("value", r"^\s*(20\d{2})", 1).try_cast("int").alias("year")).filter("year IS NOT NULL")
    labels = sheet.filter((F.col("col") == label_col) & (F.col("row") >= first_row)).select(*keys, "row", F.trim("value").alias("label"))
    body = sheet.filter(F.col("row") >= first_row).select(*keys, "row", "col", F.col("value").alias("raw"))
    grid = labels.join(headers, keys).join(body, [*keys, "row", "col"], "left")
    value = number(F.replace("raw", F.lit(","), F.lit(".")))
    status = F.when(value.isNotNull(), "reported").when(F.col("raw").isNull(), "unavailable").otherwise("unavailable_source_marker")
    return grid.select(*keys, "label", F.make_date("year", F.lit(12), F.lit(31)).alias("period"), "raw", value.alias("value"), status.alias("availability"))


def cumulative_sheet(sheet: DataFrame, year_row: int, window_row: int, first_row: int, label_col: int = 1) -> DataFrame:
    """As monthly_sheet, for windows from January ("январь-март3"); every missing cell is a row."""
    keys = ["path", "sheet"]
    years = sheet.filter(F.col("row") == year_row).select(*keys, "col", F.regexp_extract("value", r"(20\d{2})", 1).try_cast("int").alias("year"))
    windows = sheet.filter(F.col("row") == window_row).select(*keys, "col", text.window_month("value").alias("window_months"))
    headers = forward_fill(windows.join(years, [*keys, "col"], "left"), "year", keys, "col").filter("year IS NOT NULL AND window_months IS NOT NULL")
    labels = sheet.filter((F.col("col") == label_col) & (F.col("row") >= first_row)).select(*keys, "row", F.trim("value").alias("label"))
    body = sheet.filter(F.col("row") >= first_row).select(*keys, "row", "col", F.col("value").alias("raw"))
    grid = labels.join(headers, keys).join(body, [*keys, "row", "col"], "left")
    value = number(F.replace("raw", F.lit(","), F.lit(".")))
    end = F.last_day(F.make_date("year", "window_months", F.lit(1)))
    status = F.when(value.isNotNull(), "reported").when(F.col("raw").isNull(), "unavailable").otherwise("unavailable_source_marker")
    return grid.select(*keys, "label", end.alias("period"), F.make_date("year", F.lit(1), F.lit(1)).alias("window_start"), "window_months", "raw", value.alias("value"), status.alias("availability"))


#: Fixed value: what a cumulative index is a share of.
CUMULATIVE_BASIS = "в % к соответствующему периоду предыдущего года"


def cumulative_issues(sheet: DataFrame, title_row: int, basis_row: int, year_row: int, window_row: int, phrase: str, label_col: int = 1) -> DataFrame:
    """path, sheet, issues: what is wrong with the headers of each cumulative sheet, or "matched".

    Title and basis are those expected; years are "20xx год" with footnote digits, ascending, without gaps and each once; below each year stand the
    windows January, January-February and so on, all twelve in every year but the last; no column lacks one."""
    keys = ["path", "sheet"]
    said = lambda row: F.max(F.when((F.col("row") == row) & (F.col("col") == label_col), F.lower(F.trim("value"))))
    heads = sheet.filter(F.col("row").isin(title_row, basis_row, year_row, window_row))
    frame = heads.groupBy(*keys).agg(said(title_row).alias("title"), said(basis_row).alias("basis"), F.max(F.when(F.col("row").isin(year_row, window_row), F.col("col"))).alias("last"))
    columns = frame.select(*keys, F.explode(F.when(F.col("last") > label_col, F.sequence(F.lit(label_col + 1), "last"))).alias("col"))
    at = lambda row, name: heads.filter(F.col("row") == row).select(*keys, "col", F.trim("value").alias(name))
    columns = columns.join(at(year_row, "head"), [*keys, "col"], "left").join(at(window_row, "window"), [*keys, "col"], "left")
    order = Window.partitionBy(*keys).orderBy("col")
    year = F.regexp_extract("head", r"^(20\d{2})\s+год\d*$", 1)
    columns = columns.withColumns({"block": F.count("head").over(order), "bad_year": F.col("head").isNotNull() & (year == ""), "year": F.nullif(year, F.lit("")).cast("int"), "month": text.window_month("window")})
    bad = F.bool_or("bad_year")
    blocks = columns.groupBy(*keys, "block").agg(F.max("year").alias("year"), bad.alias("bad_year"), F.transform(F.array_sort(F.collect_list(F.struct("col", "month"))), lambda x: x["month"]).alias("months"), F.count(F.lit(1)).alias("n"), F.count("window").alias("n_windows"))
    in_order = F.col("months") == F.sequence(F.lit(1), F.col("n").cast("int"))
    blocks = blocks.withColumn("latest", F.max("year").over(Window.partitionBy(*keys)))
    sheets = blocks.groupBy(*keys).agg(
        F.bool_or("bad_year").alias("bad_year"), F.bool_or((F.col("block") == 0) | (F.col("n_windows") < F.col("n"))).alias("missing"), F.bool_or(F.coalesce(~in_order, F.lit(True))).alias("gaps"),
        F.bool_or((F.col("n") != 12) & (F.col("year") != F.col("latest"))).alias("short"), F.transform(F.array_sort(F.collect_list(F.struct("block", "year"))), lambda x: x["year"]).alias("years"),
    )
    out = frame.join(sheets, keys, "left")
    years = F.coalesce(F.col("years") == F.sequence(F.array_min("years"), F.array_max("years")), F.lit(False))
    repeated = F.size(F.array_distinct("years")) < F.size("years")
    issues = issue_list(
        (~F.coalesce(F.contains("title", F.lit(phrase.lower())), F.lit(False)), "unexpected_title"), (~F.coalesce(F.col("basis") == CUMULATIVE_BASIS, F.lit(False)), "unexpected_basis"), (F.col("bad_year"), "invalid_year_header"),
        (F.col("missing"), "missing_header"), (repeated, "repeated_year"), (F.col("years").isNull() | (~years & ~repeated), "years_not_contiguous"), (F.col("gaps"), "windows_not_from_january"), (F.col("short"), "incomplete_year"),
    )
    return out.select(*keys, issues.alias("issues"))


def checked_cumulative_sheet(sheet: DataFrame, title_row: int, basis_row: int, year_row: int, window_row: int, first_row: int, phrase: str, label_col: int = 1) -> DataFrame:
    """cumulative_sheet, failing when read if a sheet's headers have issues."""
    issues = cumulative_issues(sheet, title_row, basis_row, year_row, window_row, phrase, label_col)
    known = sheet.join(issues, ["path", "sheet"])
    wrong = F.raise_error(F.concat_ws(" ", F.col("path"), F.col("sheet"), F.col("issues"))).isNull()
    return cumulative_sheet(known.filter(F.when(F.col("issues") != "matched", wrong).otherwise(F.lit(True))).drop("issues"), year_row, window_row, first_row, label_col)


def report_rows(rows: DataFrame, plan: str, actual: str, top: Column | None = None) -> DataFrame:
    """Table rows of reports with plan and actual, whose columns are found by name in the nearest header row above.

    top: keeps only parent rows (a condition over cells), so that no child is added to its parent.
    """
    header = F.when(F.exists("cells", lambda c: F.lower(c).contains(actual.lower())), F.col("cells"))
    seen = Window.partitionBy("path", "member").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    located = rows.withColumn("_header", F.last(header, ignorenulls=True).over(seen)).filter(F.col("_header").isNotNull() & header.isNull())
    at = lambda name: F.array_position(F.transform("_header", lambda c: F.lower(c).contains(name.lower())), True)
    value = lambda name: F.when(at(name) > 0, parse_decimal(F.get("cells", (at(name) - 1).cast("int"))))
    out = located.select("path", "member", "ordinal", "cells", F.get("cells", F.lit(0)).alias("name"), value(plan).alias("plan_rub"), value(actual).alias("actual_rub"))
    return out.filter(top) if top is not None else out


def price_sheet(sheet: DataFrame, code_row: int, first_row: int, grades: dict[str, str], code_col: int = 1, name_col: int = 2) -> DataFrame:
    """Product columns located by code; long prices over geographies with their scope and availability."""
    keys = ["path", "sheet"]
    codes = sheet.filter(F.col("row") == code_row).select(*keys, "col", F.trim("value").alias("product_code"))
    grade = F.coalesce(*[F.when(F.col("product_code") == c, g) for c, g in grades.items()])
    columns = codes.withColumn("fuel_grade", grade).filter("fuel_grade IS NOT NULL")
    side = lambda c, n: sheet.filter((F.col("col") == c) & (F.col("row") >= first_row)).select(*keys, "row", F.trim("value").alias(n))
    places = side(code_col, "geography_code").join(side(name_col, "geography_name"), [*keys, "row"])
    body = sheet.filter(F.col("row") >= first_row).select(*keys, "row", "col", F.col("value").alias("raw"))
    grid = places.join(columns, keys).join(body, [*keys, "row", "col"], "left")
    month = F.to_date(F.concat(F.lit("01."), F.regexp_replace("sheet", r"^(\d{2})\((\d{4})\)$", "$1.$2")), "dd.MM.yyyy")
    return grid.select(*keys, month.alias("period"), "geography_code", "geography_name", text.territory_scope("geography_code", "geography_name").alias("scope"), "product_code", "fuel_grade", F.col("raw").alias("source_price"))


def inventory(files: DataFrame) -> DataFrame:
    """Each file's family, size, hash, and how many files share its content."""
    name = text.basename("path")
    family = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    hashed = files.select("path", name.alias("name"), family.alias("family"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return hashed.withColumn("n_equal", F.count(F.lit(1)).over(Window.partitionBy("sha256")))


def text_lines(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """path, place, value of the lines of text files. place orders a file's lines; a file of any size is read by many tasks."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("place"), "value")


def file_shapes(lines: DataFrame, file: str = "path", place: str = "place", line: str = "value") -> DataFrame:
    """Per delimited file: its separator and columns as the first line has them, rows below it, rows of another width, and blank lines.

    A line's width is known for both separators before the file's own is, so tasks count their lines by both, and what parts of a
    file have counted is added up; only these counts and the first lines meet. Separators in quotes don't count."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    width = lambda sep: F.length(bare) - F.length(F.replace(bare, F.lit(sep))) + 1
    head = F.struct(F.col(place).alias("place"), F.col(line).alias("line"))
    counted = lines.groupBy(file, width(",").alias("_comma"), width(";").alias("_semicolon"), (F.trim(line) == "").alias("_blank")).agg(F.count(F.lit(1)).alias("_n"), F.min(head).alias("_head"))
    heads = counted.groupBy(file).agg(F.min("_head")["line"].alias("_line"))
    many = lambda sep: F.length("_line") - F.length(F.replace("_line", F.lit(sep)))
    own = F.regexp_replace("_line", '"[^"]*"', "")
    heads = heads.select(file, F.when(many(";") > many(","), ";").otherwise(",").alias("sep"), own.alias("_own"))
    heads = heads.select(file, "sep", (F.length("_own") - F.length(F.replace(F.col("_own"), F.col("sep"))) + 1).alias("n_columns"))
    of = F.when(F.col("sep") == ";", F.col("_semicolon")).otherwise(F.col("_comma"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    rows = counted.join(heads, file).groupBy(file, "sep", "n_columns")
    # The first line is a header: it is no row, and never of another width than itself.
    return rows.agg((F.sum("_n") - 1).alias("n_rows"), total(~F.col("_blank") & (of != F.col("n_columns"))).alias("n_irregular"), total(F.col("_blank")).alias("n_blank"))


def text_profile(lines: DataFrame, sep: str, key_cells: int = 1, line: str = "value", group: str | None = None) -> DataFrame:
    """Per file: lines, the commonest width, lines of other widths, repeated keys, and numbers with grouping blanks."""
    keys = [group] if group else []
    parts = lines.withColumn("_cells", F.split(line, F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E"))))
    parts = parts.select(*keys, F.size("_cells").alias("width"), F.array_join(F.slice("_cells", 1, key_cells), sep).alias("k"), F.size(F.filter("_cells", lambda c: c.rlike("^\\d{1,3}([ \\u00a0\\u202f]\\d{3})+$"))).alias("grouped"))
    by_width = parts.groupBy(*keys, "width").agg(F.count(F.lit(1)).alias("n"), F.sum("grouped").alias("grouped"))
    widths = by_width.groupBy(*keys).agg(F.sum("n").alias("n_lines"), F.max_by("width", F.struct("n", "width")).alias("width"), F.max("n").alias("_most"), F.sum("grouped").alias("n_grouped_numbers"))
    repeats = parts.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_repeated_keys"))
    out = widths.join(repeats, keys) if keys else widths.withColumn("_1", F.lit(1)).join(repeats.withColumn("_1", F.lit(1)), "_1").drop("_1")
    return out.withColumn("n_other_widths", F.col("n_lines") - F.col("_most")).drop("_most")
