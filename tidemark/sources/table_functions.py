"""File payloads as tables inside SQL: cells of workbooks, table rows and links of HTML in archives, links of pages.

    register(spark)
    SELECT f.path, c.* FROM files f, LATERAL workbook_cells(f.content, sheets => '0_(____)') c
    SELECT f.path, r.* FROM files f, LATERAL archive_rows(f.content) r WHERE r.error IS NULL
    SELECT p.page_id, l.* FROM pages p, LATERAL html_links(p.html) l

Each function looks at its arguments when a query is analysed: a payload of another type, a pattern that is no constant or an
argument too many is an error before any task runs. Rows are given as they are decoded, so a payload's rows are never held together. A payload that
can't be decoded gives one row with its error, after the rows that could be read; a null payload gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StringType, StructField, StructType

from ..shipping import ship
from .decode import archive_members, decoded, html_rows_and_links, workbook_cells


_TYPES = {"string": StringType(), "int": IntegerType(), "strings": ArrayType(StringType())}


def _analyzed(name: str, payload: AnalyzeArgument, kind: DataType, columns: str, pattern: AnalyzeArgument | None = None) -> AnalyzeResult:
    if payload.isTable or payload.dataType != kind:
        raise ValueError(f"{name} takes {kind.simpleString()}, not {'a table' if payload.isTable else payload.dataType.simpleString()}")
    if pattern is not None and not (isinstance(pattern.value, str) and pattern.isConstantExpression):
        raise ValueError(f"the pattern of {name} has to be a constant string")
    return AnalyzeResult(StructType([StructField(c, _TYPES[t]) for c, t in (x.split() for x in columns.split(", "))]))


def _told(rows: Iterator[tuple], width: int) -> Iterator[tuple]:
    """The rows, and what ended them early as a last row of its own."""
    try:
        for row in rows:
            yield (*row, None)
    except Exception as e:  # any decoder's failure is the file's status
        yield (*[None] * width, f"{type(e).__name__}: {e}")


def _like(pattern: str | None) -> str:
    """A SQL pattern as one of file names."""
    return "*" if pattern is None else pattern.replace("[", "[[]").replace("*", "[*]").replace("?", "[?]").replace("%", "*").replace("_", "?")


class WorkbookCells:
    """(sheet, row, col, value, error) of every non-empty cell, of sheets whose name is like `sheets`."""

    @staticmethod
    def analyze(content: AnalyzeArgument, sheets: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed("workbook_cells", content, BinaryType(), "sheet string, row int, col int, value string, error string", sheets)

    def eval(self, content: bytes, sheets: str | None = None):
        if content is not None:
            wanted = _like(sheets)
            yield from _told((c for c in workbook_cells(bytes(content)) if fnmatchcase(c[0], wanted)), 4)


def _pages(content: bytes, members: str | None) -> Iterator[tuple[str, str]]:
    wanted = _like(members)
    for name, raw in archive_members(bytes(content)):
        if name.lower().endswith((".html", ".htm")) and fnmatchcase(name, wanted):
            yield name, decoded(raw)


class ArchiveRows:
    """(member, ordinal, cells, error) of table rows of HTML members, nested archives included, of names like `members`."""

    @staticmethod
    def analyze(content: AnalyzeArgument, members: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed("archive_rows", content, BinaryType(), "member string, ordinal int, cells strings, error string", members)

    def eval(self, content: bytes, members: str | None = None):
        if content is not None:
            yield from _told(((name, n, r) for name, page in _pages(content, members) for n, r in enumerate(html_rows_and_links(page)[0])), 3)


class ArchiveLinks:
    """(member, place, label, href, error) of links of HTML members: which report an entry of a catalogue page points to."""

    @staticmethod
    def analyze(content: AnalyzeArgument, members: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analyzed("archive_links", content, BinaryType(), "member string, place int, label string, href string, error string", members)

    def eval(self, content: bytes, members: str | None = None):
        if content is not None:
            yield from _told(((name, n, *link) for name, page in _pages(content, members) for n, link in enumerate(html_rows_and_links(page)[1])), 4)


class HtmlLinks:
    """(place, label, href) of the links of a page, in order."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed("html_links", html, StringType(), "place int, label string, href string")

    def eval(self, html: str):
        if html is not None:
            yield from ((n, *link) for n, link in enumerate(html_rows_and_links(html)[1]))


FUNCTIONS = {"workbook_cells": WorkbookCells, "archive_rows": ArchiveRows, "archive_links": ArchiveLinks, "html_links": HtmlLinks}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL; doing so again is harmless."""
    from pyspark.sql.functions import udtf

    ship(spark)
    for name, kind in FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind))
