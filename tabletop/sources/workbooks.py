"""Spreadsheet files (``.xlsx``), many at once: Spark lists and spreads the files, each task reads its own."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletop.functions.text import clean_names

CELL_SCHEMA = "file string, row_no int, cells array<string>"
_BATCH_ROWS = 5000

# Namespaces, and the built-in number formats that show a date or time.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _column_number(reference: str) -> int:
    number = 0
    for letter in reference:
        if not letter.isalpha():
            break
        number = number * 26 + ord(letter.upper()) - ord("A") + 1
    return number


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _texts(node: ElementTree.Element) -> str:
    """Text of a string item: its own and that of its runs, not that of phonetic hints."""
    parts = [t.text or "" for t in node.findall(f"{_MAIN}t")]
    parts += [t.text or "" for t in node.findall(f"{_MAIN}r/{_MAIN}t")]
    return "".join(parts)


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    root = _xml(archive, "xl/styles.xml")
    if root is None:
        return set()
    dated = set(_DATE_FORMATS)
    for fmt in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[(?!h|m|s)[^\]]*\]|\\.', "", fmt.get("formatCode", ""), flags=re.I)
        if re.search(r"[ymdhs]", code, flags=re.I):
            dated.add(int(fmt.get("numFmtId")))
    formats = root.findall(f"{_MAIN}cellXfs/{_MAIN}xf")
    return {i for i, xf in enumerate(formats) if int(xf.get("numFmtId", 0)) in dated}


def _moment(serial: float, date_1904: bool) -> str:
    if 0 <= serial < 1:
        return str((datetime.min + timedelta(seconds=round(serial * 86400, 3))).time())
    start = datetime(1904, 1, 1) if date_1904 else datetime(1899, 12, 30 if serial >= 60 else 31)
    return str(start + timedelta(milliseconds=round(serial * 86400000)))


def _number(text: str) -> str:
    return str(float(text)) if re.search(r"[.eE]", text) else str(int(text))


def _active_sheet(archive: zipfile.ZipFile) -> tuple[str, bool]:
    """Path of the sheet that was open when the file was saved, and the date base."""
    book = _xml(archive, "xl/workbook.xml")
    view = book.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
    active = int(view.get("activeTab", 0)) if view is not None else 0
    sheets = book.findall(f"{_MAIN}sheets/{_MAIN}sheet")
    relation = sheets[min(active, len(sheets) - 1)].get(_REL)
    for link in _xml(archive, "xl/_rels/workbook.xml.rels"):
        if link.get("Id") == relation:
            target = link.get("Target")
            base = book.find(f"{_MAIN}workbookPr")
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            return path, base is not None and base.get("date1904") in ("1", "true")
    raise ValueError("the workbook names no active sheet")


def _sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Stored values of the active sheet row by row, as text; never formulas. Gaps become empty rows and cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        path, date_1904 = _active_sheet(archive)
        shared = _xml(archive, "xl/sharedStrings.xml")
        strings = [] if shared is None else [_texts(item) for item in shared.findall(f"{_MAIN}si")]
        dated = _date_styles(archive)
        next_row = 1
        with archive.open(path) as sheet:
            for _, node in ElementTree.iterparse(sheet):
                if node.tag != f"{_MAIN}row":
                    continue
                row_no = int(node.get("r", next_row))
                for _ in range(next_row, row_no):
                    yield []
                cells: list[str | None] = []
                for cell in node.findall(f"{_MAIN}c"):
                    at = _column_number(cell.get("r", "")) or len(cells) + 1
                    cells += [None] * (at - 1 - len(cells))
                    cells.append(_cell_text(cell, strings, dated, date_1904))
                node.clear()
                yield cells
                next_row = row_no + 1


def _cell_text(cell: ElementTree.Element, strings: list[str], dated: set[int], date_1904: bool) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = cell.find(f"{_MAIN}is")
        return None if inline is None else _texts(inline)
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return strings[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    if kind == "n":
        return _moment(float(value.text), date_1904) if int(cell.get("s", 0)) in dated else _number(value.text)
    return value.text


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            found: list[tuple] = []
            for row_no, cells in enumerate(_sheet_rows(content), start=1):
                found.append((path, row_no, cells))
                if len(found) == _BATCH_ROWS:
                    yield pd.DataFrame(found, columns=["file", "row_no", "cells"])
                    found = []
            yield pd.DataFrame(found, columns=["file", "row_no", "cells"])


def parse_workbooks(files: DataFrame) -> DataFrame:
    """Files given as ``path``, ``content`` → one row per sheet row: ``file``, ``row_no`` (1 = header), ``cells``.

    A task holds one file at a time; the format itself ends at 1,048,576 rows per sheet.
    """
    return files.select("path", "content").mapInPandas(_parse_batches, CELL_SCHEMA)


def named_rows(cells: DataFrame, names: list[str]) -> DataFrame:
    """Parsed sheet rows below the header as text columns ``names``, by position.

    Short rows are filled with nulls; a value beyond the last column is an error, never dropped.
    """
    width = len(names)
    beyond = F.exists(F.slice("cells", width + 1, 1 << 30), lambda cell: cell.isNotNull())
    checked = F.when(
        beyond, F.raise_error(F.format_string("row %d of %s has more than %d cells", "row_no", "file", F.lit(width)))
    ).otherwise(F.col("cells"))
    rows = cells.where(F.col("row_no") > 1).select(checked.cast("array<string>").alias("cells"))
    return rows.select([F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)])


def read_workbooks(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """All workbooks that ``path`` (a folder or glob) names, as one table of text columns.

    The first row of each file is its header. Without ``names`` all files must share one header, which names the
    columns; with ``names`` columns are taken by position.
    """
    files = spark.read.format("binaryFile").load(path)
    cells = parse_workbooks(files)
    if names is None:
        heads = cells.where("row_no = 1").select("cells").distinct().limit(2).collect()
        if len(heads) != 1:
            raise ValueError("the workbooks differ in their headers; pass the column names")
        names = clean_names(heads[0]["cells"])
    return named_rows(cells, names)
