"""Workbooks in the zipped XML format (S-04, F-05, F-07, P-08).

A file is read by one task, its rows one after the other; only its shared
strings are held. A file that cannot be read to its end gives no rows but one
with the error, so that a bad file neither stops the others nor counts in part.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

# Fixed values of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

#: Rows of an Arrow batch.
ROWS = 2000
SCHEMA = "path string, ordinal long, cells array<string>, error string"


def _strings(book: zipfile.ZipFile) -> list[str]:
    """The table of shared strings; runs of a string are joined, its phonetic hints are not part of it."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, item in ElementTree.iterparse(stream):
            if item.tag == MAIN + "si":
                found.append(_spoken(item))
                item.clear()
    return found


def _spoken(item: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in [*item.findall(MAIN + "t"), *item.findall(f"{MAIN}r/{MAIN}t")])


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets/{MAIN}sheet")
    if sheet is None:
        raise ValueError("a workbook without sheets")
    for one in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if one.get("Id") == sheet.get(RELATION):
            return posixpath.normpath(posixpath.join("/xl", one.get("Target"))).lstrip("/")
    raise ValueError("the first sheet has no part in the file")


def _column(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for letter in reference.rstrip("0123456789"):
        n = 26 * n + ord(letter) - 64
    return n - 1


def _value(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind, raw = cell.get("t", "n"), cell.findtext(MAIN + "v")
    if kind == "inlineStr":
        inline = cell.find(MAIN + "is")
        return None if inline is None else _spoken(inline)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(raw)]
    return {"1": "true", "0": "false"}.get(raw, raw) if kind == "b" else raw


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of each row that has one, in the first sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _strings(book)
        with book.open(_first_sheet(book)) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != MAIN + "row":
                    continue
                cells: list[str | None] = []
                for cell in row.findall(MAIN + "c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _value(cell, strings)
                row.clear()
                if any(c is not None for c in cells):
                    yield cells


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(path, first, cells, error=None):
        n = len(cells)
        columns = [pa.array([path] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(cells, pa.list_(pa.string())), pa.array([error] * n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["path", "ordinal", "cells", "error"])

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = content.as_py()
            try:
                for _ in sheet_rows(raw):  # to its end, before any row is given
                    pass
            except (OSError, ValueError, KeyError, IndexError, TypeError, NotImplementedError, RuntimeError, zipfile.BadZipFile, ElementTree.ParseError, EOFError) as error:
                yield batch_of(path, 0, [None], f"{type(error).__name__}: {error}")
                continue
            held, first = [], 0
            for cells in sheet_rows(raw):
                held.append(cells)
                if len(held) == ROWS:
                    yield batch_of(path, first, held)
                    held, first = [], first + ROWS
            if held:
                yield batch_of(path, first, held)


def workbook_rows(spark: SparkSession, folder: str, pattern: str = "*.xlsx") -> DataFrame:
    """S-04: path, ordinal (0 is the header), cells as text and error of the first sheet of each workbook.

    Numbers and dates are as the file holds them, true and false are words,
    error values are null. An unreadable file is one row with its error. A
    sheet without cells gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(_read, SCHEMA)


def url_workbooks(rows: DataFrame) -> DataFrame:
    """F-05, F-07, P-08: channel_id, url, video_id, ordinal of workbook_rows, the url in column 1, as readers.url_sheets gives them."""
    url = F.get("cells", F.lit(1))
    valid = rows.where(F.col("error").isNull() & (F.col("ordinal") > 0) & text.valid_url(url))
    return valid.select(text.channel_id(text.stem(text.file_name(F.col("path")))).alias("channel_id"), url.alias("url"), "ordinal", text.id_from_url(url).alias("video_id"))


def rejected(rows: DataFrame) -> DataFrame:
    """path and error of the workbooks that could not be read."""
    return rows.where(F.col("error").isNotNull()).select("path", "error")
