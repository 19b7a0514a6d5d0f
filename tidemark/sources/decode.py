"""Small decoders of file payloads, run inside tasks: workbook cells, table rows and links of HTML, archive members."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(reference: str) -> int:
    """1 for A, 27 for AA."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def workbook_cells(payload: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of all non-empty cells, one sheet's XML at a time."""
    with zipfile.ZipFile(io.BytesIO(payload)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if e.tag == f"{_MAIN}si":
                    shared.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
                    e.clear()
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        for sheet in ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_REL)].lstrip("/")
            for _, e in ElementTree.iterparse(z.open(target if target.startswith("xl/") else f"xl/{target}")):
                if e.tag != f"{_MAIN}row":
                    continue
                for c in e.iter(f"{_MAIN}c"):
                    kind, value = c.get("t"), c.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        text = shared[int(value.text)] if kind == "s" else value.text
                    if text.strip():
                        yield sheet.get("name"), int(e.get("r")), column_number(c.get("r")), text
                e.clear()


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.links: list[tuple[str, str]] = []
        self._cell: list[str] | None = None
        self._link: tuple[str, list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self._close_cell()
            self._cell = []
        elif tag == "a":
            self._link = (dict(attrs).get("href") or "", [])

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self._close_cell()
        elif tag == "a" and self._link:
            self.links.append((" ".join("".join(self._link[1]).split()), self._link[0]))
            self._link = None

    def _close_cell(self):
        if self._cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self._cell).split()))
        self._cell = None

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)
        if self._link:
            self._link[1].append(data)


def html_rows_and_links(text: str) -> tuple[list[list[str]], list[tuple[str, str]]]:
    parser = _Tables()
    parser.feed(text)
    parser.close()
    return [r for r in parser.rows if r], parser.links


def decoded(raw: bytes) -> str:
    for encoding in ("utf-8-sig", "cp1251"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def archive_members(payload: bytes, depth: int = 8) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of all files in an archive and the archives in it; one that lies deeper is an error, as a broken one is."""
    with zipfile.ZipFile(io.BytesIO(payload)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            raw = z.read(info)
            if info.filename.lower().endswith(".zip"):
                if depth == 1:
                    raise ValueError(f"archives are nested too deep: {info.filename}")
                yield from ((f"{info.filename}!{n}", b) for n, b in archive_members(raw, depth - 1))
            else:
                yield info.filename, raw


def packed(name: str, raw: bytes) -> bytes:
    """An archive with one member; equal contents give equal archives."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo(name), raw)
    return out.getvalue()
