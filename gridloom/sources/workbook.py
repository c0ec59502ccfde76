"""Workbooks (.xlsx) as a Spark data source, and tables from their sheets.

``spark.read.format("workbook")`` yields ``(file, sheet, position, row_no, cells)``.
A sheet is cut by the bytes of its XML, so several tasks read a large one.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.functions.names import NUMBERED, canonical_headers, unique_headers
from gridloom.operators.union import UnionSchema, union_schema
from gridloom.sinks.workbook import WorkbookSinkWriter
from gridloom.sources.csv_files import NA_TOKENS, ORD, null_tokens
from gridloom.sources.files import InputFile, list_files, open_input, read_if_there
from gridloom.sources.xlsx_cells import Workbook

SCHEMA = "file string, sheet string, position int, row_no long, cells array<string>"
_ROWS = pa.schema([
    ("file", pa.string()), ("sheet", pa.string()), ("position", pa.int32()), ("row_no", pa.int64()), ("cells", pa.list_(pa.string())),
])
_BATCH_ROWS = 5_000
#: Bytes of a sheet's XML that one task parses.
PART = 32 << 20

# Words that choose every sheet.
ALL_SHEETS = ("all", "всі", "все", "*")


class SheetPartition(InputPartition):
    """Rows of a sheet that start at bytes ``low`` to ``high`` of its XML."""

    def __init__(self, file: str, sheet: str, position: int, low: int, high: int | None):
        super().__init__((file, sheet, position, low))
        self.file, self.sheet, self.position, self.low, self.high = file, sheet, position, low, high


@dataclass(frozen=True)
class Sheet:
    """A sheet, its place in its workbook, and the bytes of its XML."""

    file: str
    sheet: str
    position: int
    bytes: int

    def parts(self, size: int) -> list[SheetPartition]:
        lows = range(0, max(1, self.bytes), size)
        return [SheetPartition(self.file, self.sheet, self.position, low, high) for low, high in zip(lows, [*lows[1:], None])]


def _sheets_of(file: str) -> list[Sheet]:
    return [s for s, _ in _headed_sheets(file, False)]


def _headed_sheets(file: str, heads: bool = True) -> list[tuple[Sheet, list[str | None] | None]]:
    """The sheets of a workbook, each with the cells of its first row."""
    with open_input(file) as stream:
        book = Workbook(stream)
        sheets = [Sheet(file, sheet, i, book.size(sheet)) for i, sheet in enumerate(book.sheets)]
        return [(s, next((cells for n, cells in book.rows(s.sheet) if n == 1), None) if heads else None) for s in sheets]


def _part_rows(part: SheetPartition, first_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    def batch(numbers: list[int], cells: list[list]) -> pa.RecordBatch:
        n = len(numbers)
        columns = [[part.file] * n, [part.sheet] * n, [part.position] * n, numbers, cells]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)

    numbers, cells = [], []
    # Parsing makes millions of short-lived objects and no cycles; scanning for cycles
    # would take longer than the parsing.
    gc.disable()
    try:
        with open_input(part.file) as stream:
            for number, row in Workbook(stream).rows(part.sheet, part.low, part.high):
                if first_rows is not None and number > first_rows:
                    break
                numbers.append(number)
                cells.append(row)
                if len(numbers) == _BATCH_ROWS:
                    yield batch(numbers, cells)
                    numbers, cells = [], []
        if numbers:
            yield batch(numbers, cells)
    finally:
        gc.enable()


class WorkbookReader(DataSourceReader):
    """Reads the parts that option ``parts`` lists, or all sheets of ``files``, which are then opened here."""

    def __init__(self, options: dict):
        self._first_rows = int(options["rows"]) if "rows" in options else None
        if "parts" in options:
            self._parts = [SheetPartition(*p) for p in json.loads(options["parts"])]
            return
        files = options["files"].split("\n")
        wanted = options["sheets"].split("\n") if "sheets" in options else None
        with ThreadPoolExecutor(min(32, len(files))) as pool:
            sheets = [s for found in pool.map(_sheets_of, files) for s in found if wanted is None or s.sheet in wanted]
        self._parts = [p for s in sheets for p in s.parts(PART)]

    def partitions(self) -> Sequence[InputPartition]:
        return self._parts

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        yield from _part_rows(partition, self._first_rows)


class WorkbookSource(DataSource):
    """Read sheets; write one workbook per task."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options)

    def writer(self, schema, overwrite):
        return WorkbookSinkWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def _catalog(spark: SparkSession, files: Sequence[tuple[int, str]]) -> DataFrame:
    """``(src, file, sheet, position, bytes)`` of every sheet; workbooks are opened in tasks."""
    def sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(s, x.file, x.sheet, x.position, x.bytes) for s, p in zip(b["src"], b["file"]) for x in _sheets_of(p)]
            yield pd.DataFrame(found, columns=["src", "file", "sheet", "position", "bytes"])

    listed = spark.createDataFrame(list(files), "src int, file string")
    slots = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    return listed.repartition(slots, "file").mapInPandas(sheets, "src int, file string, sheet string, position int, bytes long")


def _workbooks(spark: SparkSession, paths: str | Sequence[str]) -> list[InputFile]:
    return [f for f in list_files(spark, paths) if f.path.lower().endswith(".xlsx")]


def sheet_catalog(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(src, file, sheet, position)`` of every sheet."""
    return _catalog(spark, [(f.src, f.path) for f in _workbooks(spark, paths)]).drop("bytes")


def sheet_parts(names: Sequence[str], base: str) -> list[str]:
    """``base`` and the sheets it goes on in where it is full: ``base (2)``, ``base (3)`` …"""
    found = [n for n in names if n == base or n.startswith(base) and re.fullmatch(NUMBERED, n[len(base):])]
    return sorted(found, key=lambda n: [int(x) for x in re.findall("[0-9]+", n[len(base):])])


def choose_sheets(
    names: Sequence[str], selection: str | Sequence[str] | None, on_missing: str = "error", parts: bool = False
) -> list[str]:
    """Sheets by ``all``, position from 0, exact name, or a comma list of those.

    With ``parts`` a sheet is chosen with those it goes on in, each of them once. These may be
    here without it: the sheets of a split table lie in several workbooks.
    """
    if selection is None or (isinstance(selection, str) and selection.strip().lower() in ALL_SHEETS):
        return list(names)
    tokens = selection.split(",") if isinstance(selection, str) else selection
    chosen = []
    for token in (t.strip() for t in tokens):
        if not token:
            continue
        by_place = token.isdigit() and int(token) < len(names)
        base = names[int(token)] if by_place else token
        found = sheet_parts(names, base) if parts else [base] if base in names else []
        if found and (by_place or not token.isdigit()):
            chosen += found
        elif on_missing == "error":
            raise KeyError(f"no sheet {token!r} among {list(names)}")
    return list(dict.fromkeys(chosen)) if parts else chosen


def input_sheets(names: Sequence[str], base: str) -> list[str]:
    """Without the sheets an earlier run wrote: ``base`` and ``base (…``."""
    own = base.lower()
    return [n for n in names if n.lower() != own and not n.lower().startswith(f"{own} (")]


def read_cells(
    spark: SparkSession, files: Sequence[str], sheets: Sequence[str] | None = None, rows: int | None = None, part: int = PART
) -> DataFrame:
    """Raw rows of sheets (all, or those named), the first ``rows`` of each where given. Tasks look up the sheets, too."""
    listed = _catalog(spark, list(enumerate(files)))
    if sheets is not None:
        listed = listed.where(F.col("sheet").isin(list(sheets)))
    found = listed.orderBy("src", "position").collect()
    return read_parts(spark, [Sheet(r.file, r.sheet, r.position, r.bytes) for r in found], rows, part)


def read_parts(spark: SparkSession, sheets: Sequence[Sheet], rows: int | None = None, part: int = PART) -> DataFrame:
    """One input partition for about ``part`` bytes of XML; first rows alone are read from a sheet's start."""
    register(spark)
    parts = [p for s in sheets for p in (s.parts(part) if rows is None else s.parts(part)[:1])]
    listed = json.dumps([(p.file, p.sheet, p.position, p.low, None if rows is not None else p.high) for p in parts])
    reader = spark.read.format("workbook").option("parts", listed)
    return (reader if rows is None else reader.option("rows", rows)).load()


def headed_catalog(spark: SparkSession, files: Sequence[InputFile], manifest: str | None = None) -> DataFrame:
    """``(src, file, sheet, position, bytes, head)`` of every sheet, ``head`` being the cells of its first row.

    ``manifest`` is a folder that remembers this for every file by path, size and time of
    change. Only files it does not know are opened, and added to it; a file that has
    changed is a new one. Any number of runs may add at once.
    """
    def sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for file, size, modified in zip(b["file"], b["size"], b["modified"]):
                headed = _headed_sheets(file)
                found += [(file, size, modified, s.sheet, s.position, s.bytes, h) for s, h in headed]
                # A book of charts only is known, too.
                found += [] if headed else [(file, size, modified, None, None, None, None)]
            yield pd.DataFrame(found, columns=["file", "size", "modified", "sheet", "position", "bytes", "head"]).astype({"position": "Int32", "bytes": "Int64"})

    schema = "file string, size long, modified long, sheet string, position int, bytes long, head array<string>"
    keys = ["file", "size", "modified"]
    listed = spark.createDataFrame([(f.src, f.path, f.bytes, f.modified) for f in files], "src int, file string, size long, modified long")
    slots = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    if manifest is None:
        found = listed.repartition(slots, "file").drop("src").mapInPandas(sheets, schema)
    else:
        known = read_if_there(spark, manifest, schema)
        new = listed.drop("src").join(known.select(*keys).distinct(), keys, "left_anti") if known is not None else listed.drop("src")
        fresh = new.repartition(slots, "file").mapInPandas(sheets, schema)
        if known is None or not new.isEmpty():
            fresh.write.mode("append").parquet(manifest)
        found = spark.read.schema(schema).parquet(manifest).dropDuplicates([*keys, "position"])
    return listed.join(found, keys).where(F.col("sheet").isNotNull()).select("src", "file", "sheet", "position", "bytes", "head")


def sheet_headers(
    spark: SparkSession, paths: str | Sequence[str], sheets: str | Sequence[str] | None = None,
    base: str | None = None, on_missing: str = "error", manifest: str | None = None, parts: bool = False,
) -> list[tuple[Sheet, list[str]]]:
    """Chosen sheets and their header cells, in order; only first rows are read. ``base`` leaves own outputs out."""
    files = _workbooks(spark, paths)
    by_file: dict[str, list[tuple[Sheet, list[str]]]] = {f.path: [] for f in files}
    for r in headed_catalog(spark, files, manifest).orderBy("src", "position").collect():
        by_file[r.file].append((Sheet(r.file, r.sheet, r.position, r.bytes), canonical_headers(r.head or [])))
    wanted = []
    for found in by_file.values():
        chosen = choose_sheets([s.sheet for s, _ in found], sheets, on_missing, parts)
        named = {s.sheet: (s, h) for s, h in found}
        wanted += [named[s] for s in (input_sheets(chosen, base) if base else chosen)]
    return wanted


def read_sheet(
    spark: SparkSession, paths: str | Sequence[str], sheet: str | None = None,
    na_tokens: Sequence[str] | None = NA_TOKENS, with_order: bool = False, manifest: str | None = None,
) -> DataFrame:
    """One sheet of each workbook (the first by default) as an all-text table, columns by exact name."""
    found = sheet_headers(spark, paths, "0" if sheet is None else [sheet], manifest=manifest)
    return _table(spark, found, union_schema([unique_headers(h) for _, h in found], exact=True), na_tokens, with_order)


def read_sheets(
    spark: SparkSession, paths: str | Sequence[str], sheets: str | Sequence[str] | None = None,
    na_tokens: Sequence[str] | None = NA_TOKENS, with_order: bool = False,
) -> dict[str, DataFrame]:
    """Each chosen sheet of one workbook as its own table."""
    return {
        s.sheet: _table(spark, [(s, h)], union_schema([unique_headers(h)], exact=True), na_tokens, with_order)
        for s, h in sheet_headers(spark, paths, sheets)
    }


def unite_sheets(
    spark: SparkSession, paths: str | Sequence[str], sheets: str | Sequence[str] | None = None, norm: str = "safe",
    base: str | None = None, on_missing: str = "error", with_order: bool = False, with_sheet: bool = False,
    manifest: str | None = None, parts: bool = False,
) -> DataFrame:
    """All chosen sheets as one table, columns matched by normalised header. ``parts``: with the sheets they go on in."""
    found = sheet_headers(spark, paths, sheets, base, on_missing, manifest, parts)
    if not found:
        raise ValueError("no sheets to unite")
    return _table(spark, found, union_schema([h for _, h in found], norm), None, with_order, with_sheet)


def _table(
    spark: SparkSession, found: Sequence[tuple[Sheet, list[str]]], plan: UnionSchema,
    na_tokens: Sequence[str] | None, with_order: bool, with_sheet: bool = False,
) -> DataFrame:
    """One scan for any number of sheets: where each column sits in a sheet comes from a table of one row per sheet."""
    cells = read_parts(spark, list(dict.fromkeys(s for s, _ in found))).where(F.col("row_no") > 1)
    places = spark.createDataFrame(
        [(s.file, s.sheet, i, [-1 if p is None else p for p in pos]) for i, ((s, _), pos) in enumerate(zip(found, plan.positions))],
        "file string, sheet string, src int, places array<int>",
    )
    placed = cells.join(F.broadcast(places), ["file", "sheet"])
    columns = []
    for k in range(len(plan.keys)):
        at = F.get("places", F.lit(k))
        columns.append(null_tokens(F.when(at >= 0, F.get("cells", at)), na_tokens).alias(f"c{k}"))
    # A sheet holds a million rows at most, so it is one block.
    order = F.struct("src", F.lit(0).cast("long").alias("block"), F.col("row_no").alias("seq")).alias(ORD)
    extra = [order] * with_order + [F.col("sheet").alias("_sheet")] * with_sheet
    names = [ORD] * with_order + ["_sheet"] * with_sheet
    return placed.select(*columns, *extra).toDF(*plan.display, *names)
