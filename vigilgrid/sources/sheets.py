"""Cell grids from CSV files and workbooks."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import large_csv
from .snapshots import key_below


# What a decoder gives: a row of a sheet, or why the sheet cannot be read (its cells are null then).
DECODED = "sheet_id string, row_idx long, cells array<string>, error string"


def _grid(sheet_id: str, rows: Iterator[list[str]], batch: int = 4096) -> Iterator[pd.DataFrame]:
    """Rows of one sheet as pandas batches of fixed size; an error while they are read becomes the last row."""
    index, cells, error = [], [], None
    try:
        for i, row in enumerate(rows):
            index.append(i)
            cells.append(row)
            if len(index) == batch:
                yield pd.DataFrame({"sheet_id": sheet_id, "row_idx": index, "cells": cells, "error": None})
                index, cells = [], []
    except Exception as reason:
        error = _said(reason)
    if index:
        yield pd.DataFrame({"sheet_id": sheet_id, "row_idx": index, "cells": cells, "error": None})
    if error:
        yield _failed(sheet_id, error)


def _said(reason: Exception) -> str:
    if isinstance(reason, UnicodeDecodeError):
        return f"not UTF-8: {reason.reason}"
    return f"{type(reason).__name__}: {reason}"


def _failed(sheet_id: str, error: str) -> pd.DataFrame:
    return pd.DataFrame({"sheet_id": [sheet_id], "row_idx": [-1], "cells": [None], "error": [error]})


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select(key_below(F.col("path"), path).alias("file"), "content")


def readable_rows(decoded: DataFrame) -> DataFrame:
    """Rows of the sheets that could be read as a whole."""
    rows = decoded.filter(F.col("error").isNull()).drop("error")
    return rows.join(sheet_errors(decoded), "sheet_id", "left_anti").select("sheet_id", "row_idx", "cells")


def sheet_errors(decoded: DataFrame) -> DataFrame:
    """``sheet_id, error``: one row per sheet that could not be read; a job goes on without it."""
    failed = decoded.filter(F.col("error").isNotNull())
    return failed.groupBy("sheet_id").agg(F.min("error").alias("error"))


def decode_sheets_csv(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Many small CSV files, one sheet per file; every cell is text and blank lines count as rows."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files_ in batches:
            for sheet_id, content in zip(files_["file"], files_["content"]):
                try:
                    text = io.StringIO(content.decode("utf-8"), newline="")
                except UnicodeDecodeError as reason:
                    yield _failed(sheet_id, _said(reason))
                    continue
                yield from _grid(sheet_id, csv.reader(text))

    return _files(spark, path, pattern).mapInPandas(decode, DECODED)


def scan_sheets_csv(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Rows of ``decode_sheets_csv`` without the sheets that cannot be read."""
    return readable_rows(decode_sheets_csv(spark, path, pattern))


def scan_large_csv(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """CSV files of any size, split between tasks, also inside quoted line breaks; see ``large_csv``."""
    return readable_rows(large_csv.decode(spark, path, pattern))


# Names of the parts and tags of an Office Open XML workbook.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_STYLES = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47])
_EPOCH = datetime(1899, 12, 30)


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group(0):
        number = number * 26 + ord(letter) - 64
    return number - 1


def _date_formats(book: zipfile.ZipFile) -> set[int]:
    """Cell style numbers that show a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(fmt.get("numFmtId"))
        for fmt in root.iter(f"{_MAIN}numFmt")
        if re.search(r"[dmyh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", fmt.get("formatCode", "").lower()))
    }
    formats = root.find(f"{_MAIN}cellXfs")
    styles = [] if formats is None else [int(xf.get("numFmtId", 0)) for xf in formats]
    return {i for i, number in enumerate(styles) if number in _DATE_STYLES or number in custom}


def _cell_text(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.findtext(f"{_MAIN}v")
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        return (_EPOCH + timedelta(days=float(value))).isoformat(sep=" ", timespec="seconds")
    return value


def _workbook_rows(content: bytes, sheet: str | None) -> Iterator[tuple[str, Iterator[list[str]]]]:
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in root.iter(f"{_MAIN}si")]
    targets = {
        rel.get("Id"): rel.get("Target").lstrip("/")
        for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    listed = [
        (s.get("name"), targets[s.get(f"{_REL}id")])
        for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    ]
    chosen = listed[:1] if sheet is None else [s for s in listed if sheet in ("*", s[0])]
    dates = _date_formats(book)
    for name, target in chosen:
        part = target if target.startswith("xl/") else f"xl/{target}"
        yield name, _sheet_rows(book, part, shared, dates)


def _sheet_rows(book: zipfile.ZipFile, part: str, shared: list[str], dates: set[int]) -> Iterator[list[str]]:
    """Rows in order, read as a stream; rows the file leaves out are empty."""
    expected = 1
    with book.open(part) as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag != f"{_MAIN}row":
                continue
            number = int(row.get("r", expected))
            while expected < number:
                yield []
                expected += 1
            cells: list[str] = []
            for cell in row.iter(f"{_MAIN}c"):
                position = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                cells.extend([""] * (position - len(cells)))
                cells.append(_cell_text(cell, shared, dates))
            yield cells
            expected += 1
            row.clear()


def workbook_rows(contents: DataFrame, sheet: str | None = None) -> DataFrame:
    """Cell grids of workbooks (``file, content``) keyed ``<file>#<sheet>``, decoded by tasks, one file at a time.

    ``sheet``: a sheet name, ``*`` for all, or None for the first one. A file that is no workbook has an
    error under its own name, a broken sheet under the name of the sheet.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files_ in batches:
            for file, content in zip(files_["file"], files_["content"]):
                try:
                    for name, rows in _workbook_rows(content, sheet):
                        yield from _grid(f"{file}#{name}", rows)
                except Exception as reason:  # whatever is wrong with a file, the others are read
                    yield _failed(file, _said(reason))

    return contents.select("file", "content").mapInPandas(decode, DECODED)


def decode_workbooks(spark: SparkSession, path: str, sheet: str | None = None, pattern: str = "*.xlsx") -> DataFrame:
    """``workbook_rows`` of the workbooks in a folder."""
    return workbook_rows(_files(spark, path, pattern), sheet)


def scan_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Rows of ``decode_workbooks`` without the sheets that cannot be read."""
    return readable_rows(decode_workbooks(spark, path, sheet))


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of the bytes of every file below a folder."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select(key_below(F.col("path"), path).alias("path"), F.sha2("content", 256).alias("file_hash"))
    )
