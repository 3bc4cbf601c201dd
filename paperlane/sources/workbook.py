"""Workbooks as a Spark data source: one partition for each file, cached values only, formulas are never evaluated.

A cell is (raw, native, unreadable): a formula without a cached value can't be
read.  Numbers appear as Python prints them; a number with a date style is a
date.  Rows are numbered as in the sheet.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from paperlane.config import TabularOptions
from paperlane.errors import SourceUnreadable
from paperlane.sources.selection import require_relative, resolve_source

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_DATES = {14, 15, 16, 17, 22, 27, 30, 36, 50, 57}
SCHEMA = "relative_path string, content_hash string, sheet string, row_no int, cells array<struct<raw:string,native:string,unreadable:string>>, reason string"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_M}t"))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{_M}numFmt")}
    formats = root.find(f"{_M}cellXfs")
    is_date = lambda i: i in _DATES or bool(re.search(r"[dy]|m(?!.*[0#])", custom.get(i, ""), re.I) and not re.search(r"[0#]", custom.get(i, "")))
    return {k for k, x in enumerate(formats if formats is not None else ()) if is_date(int(x.get("numFmtId", 0)))}


def read_sheet(path: str, sheet: str) -> Iterator[tuple[str, int, list[tuple[str | None, str | None, str | None]]]]:
    """(sheet name, row number, cells) of each row that is written, in order."""
    with zipfile.ZipFile(path) as book:
        root = ET.fromstring(book.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{_P}Relationship")}
        sheets = [(s.get("name"), targets[s.get(f"{_R}id")]) for s in root.iter(f"{_M}sheet")]
        view = next(root.iter(f"{_M}workbookView"), None)
        active = int(view.get("activeTab", 0)) if view is not None else 0
        props = root.find(f"{_M}workbookPr")
        epoch = dt.date(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else dt.date(1899, 12, 30)
        found = [s for s in sheets if s[0] == sheet] if sheet else sheets[active : active + 1]
        if not found:
            raise SourceUnreadable(f"no such sheet; there are {[s[0] for s in sheets]}")
        name, target = found[0]
        shared = [_text(si) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_M}si")] if "xl/sharedStrings.xml" in book.namelist() else []
        dates = _date_styles(book)
        member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        row_no = 0
        with book.open(member) as stream:
            for _, row in ET.iterparse(stream):
                if row.tag != f"{_M}row":
                    continue
                row_no = int(row.get("r", row_no + 1))
                cells: list[tuple[str | None, str | None, str | None]] = []
                for c in row.iter(f"{_M}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells.extend([(None, None, None)] * (at - len(cells)))
                    cells.append(_cell(c, shared, dates, epoch))
                row.clear()
                yield name, row_no, cells


def _cell(c: ET.Element, shared: list[str], dates: set[int], epoch: dt.date) -> tuple[str | None, str | None, str | None]:
    kind, v = c.get("t", "n"), c.find(f"{_M}v")
    if kind == "inlineStr":
        return _text(c), None, None
    value = v.text if v is not None else None
    if value is None:
        return (None, None, "formula_without_cached_value") if c.find(f"{_M}f") is not None else (None, None, None)
    if kind == "s":
        return shared[int(value)], None, None
    if kind == "b":
        return str(value == "1"), "boolean", None
    if kind == "e":
        return value, None, f"error_value {value}"
    if kind == "d":
        return value[:10], "date", None
    if kind == "str":
        return value, None, None
    if int(c.get("s", 0)) in dates:
        return (epoch + dt.timedelta(days=int(float(value)))).isoformat(), "date", None
    return (value if re.fullmatch(r"-?\d+", value) else repr(float(value))), "number", None


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.sheet = options["root"], options.get("sheet", "")
        self.paths = [p for p in options.get("paths", "").split("\n") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = require_relative(partition.value)
        found = resolve_source(self.root, path)
        digest = hashlib.sha256()
        with open(found, "rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        name = f"sha256:{digest.hexdigest()}"
        try:
            for sheet, row_no, cells in read_sheet(found, self.sheet):
                yield path, name, sheet, row_no, cells, None
        except (SourceUnreadable, zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, IndexError) as why:
            yield path, name, None, None, None, f"workbook_unreadable: {type(why).__name__}: {why}"[:300]


class WorkbookSource(DataSource):
    """``spark.read.format("paperlane_workbook")`` with options root, paths (one in a line) and sheet."""

    @classmethod
    def name(cls) -> str:
        return "paperlane_workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options)


def workbook(spark: SparkSession, root: str, paths: list[str], options: TabularOptions, run_active_content: bool = False) -> tuple[DataFrame, DataFrame]:
    """(grid, refused) in the form of delimited files, with ``sheet``; data cells are structs."""
    spark.dataSource.register(WorkbookSource)
    read = spark.read.format("paperlane_workbook").options(root=root, paths="\n".join(paths), sheet=options.sheet_name).load()
    refused = read.filter("reason is not null").select("relative_path", F.lit(SourceUnreadable.__name__).alias("error_class"), "reason")
    skip = options.header_row + options.data_starts_after_header
    header = F.max(F.when(F.col("row_no") == options.header_row, F.transform("cells", lambda c: c["raw"])))
    rows = F.array_sort(F.collect_list(F.when(F.col("row_no") > skip, F.struct("row_no", "cells"))))
    notes = F.array(F.lit("active_content_is_not_run")) if run_active_content else F.array().cast("array<string>")
    grid = read.filter("reason is null").groupBy("relative_path", "content_hash", "sheet").agg(header.alias("headers"), rows.alias("data")).withColumn("notes", notes)
    short = grid.filter("headers is null").select("relative_path", F.lit(SourceUnreadable.__name__).alias("error_class"), F.lit("header_beyond_file").alias("reason"))
    return grid.filter("headers is not null"), refused.unionByName(short)
