"""Rows of the first sheet of workbooks, read as streams over their zipped parts."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd

#: Rows that are handed on at a time.
ROWS = 5_000
# Numbers of the formats that stand for dates, and the day that a date counts from.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
EPOCH = datetime.datetime(1899, 12, 30)


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _column(name: str) -> int:
    """A is 0, Z 25, AA 26."""
    n = 0
    for c in re.match("[A-Z]+", name)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _texts(book: zipfile.ZipFile) -> list[str]:
    """The texts that cells share, each the sum of its runs."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
        if _tag(e) == "si":
            out.append("".join(t.text or "" for t in e.iter() if _tag(t) == "t"))
            e.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Styles of cells that hold dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.parse(book.open("xl/styles.xml")).getroot()
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter() if _tag(f) == "numFmt"}
    dated = DATE_FORMATS | {n for n, code in own.items() if re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower()))}
    styles = next((e for e in root if _tag(e) == "cellXfs"), ())
    return {i for i, x in enumerate(styles) if int(x.get("numFmtId", 0)) in dated}


def _first_sheet(book: zipfile.ZipFile) -> str:
    names = [n for n in book.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]
    return min(names, key=lambda n: (len(n), n))


def _value(cell: ElementTree.Element, texts: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _tag(t) == "t")
    raw = next((e.text for e in cell if _tag(e) == "v"), None)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return texts[int(raw)]
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        at = EPOCH + datetime.timedelta(days=round(float(raw) * 86_400) / 86_400)
        return at.date().isoformat() if float(raw).is_integer() else at.isoformat(sep=" ", timespec="seconds")
    return raw


def cells(content: bytes) -> Iterator[tuple[int, dict[int, str]]]:
    """(row, {column: text}) of the rows of the first sheet, in order; what is no workbook has none."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        sheet = _first_sheet(book)
    except (zipfile.BadZipFile, ValueError):
        return
    texts, dates, last = _texts(book), _date_styles(book), -1
    for _, e in ElementTree.iterparse(book.open(sheet)):
        if _tag(e) == "row":
            last = int(e.get("r", last + 2)) - 1
            found, at = {}, -1
            for c in e:
                at = _column(c.get("r")) if c.get("r") else at + 1
                if (value := _value(c, texts, dates)) is not None and value != "":
                    found[at] = value
            yield last, found
            e.clear()


def sheet_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """content of workbooks -> head (whether a row is its workbook's first that has a cell) and cells of
    that row and all after it, some rows at a time."""
    for pdf in parts:
        for content in pdf["content"]:
            out, head = [], True
            for _, found in cells(bytes(content)):
                if head and not found:
                    continue
                out.append((head, found))
                head = False
                if len(out) == ROWS:
                    yield pd.DataFrame(out, columns=["head", "cells"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["head", "cells"])
