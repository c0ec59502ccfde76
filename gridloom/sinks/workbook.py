"""Workbook sink: one .xlsx per task, made visible only when the whole job is done."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from gridloom.functions.names import col
from gridloom.sinks.xlsx_writer import MAX_ROWS, WorkbookWriter, check_sheet_name
from gridloom.sources.files import _store, open_output, qualified

#: Workbooks moved into place at once.
MOVES = 16


@dataclass
class WrittenWorkbook(WriterCommitMessage):
    staged: str
    final: str
    rows: int


class WorkbookSinkWriter(DataSourceArrowWriter):
    """Option ``sheet`` names the sheet, or ``sheet_column`` the column that does; ``path`` is the folder."""

    def __init__(self, schema: StructType, options: dict):
        self._folder = options["path"].rstrip("/")
        self._sheet = options.get("sheet", "Data")
        self._sheet_column = options.get("sheet_column")
        self._max_rows = int(options.get("max_rows", MAX_ROWS))
        self._job = uuid.uuid4().hex[:8]
        self._names = [f.name for f in schema.fields]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        part = TaskContext.get().partitionId()
        staged = f"{self._folder}/_staged-{self._job}/{uuid.uuid4().hex}.xlsx"
        total, book, stream, sheet = 0, None, None, None
        at = self._names.index(self._sheet_column) if self._sheet_column else None
        header = [n for i, n in enumerate(self._names) if i != at]
        for batch in iterator:
            columns = [_values(c) for c in batch.columns]
            names = columns.pop(at) if at is not None else None
            rows = list(zip(*columns))
            if not rows:
                continue
            if book is None:
                stream = open_output(staged)
                book = WorkbookWriter(stream, self._max_rows)
            start = 0
            while start < len(rows):
                name = self._sheet if names is None else str(names[start])
                end = len(rows) if names is None else next((i for i in range(start, len(rows)) if str(names[i]) != name), len(rows))
                if name != sheet:
                    book.start_sheet(name, header)
                    sheet = name
                book.write_rows(rows[start:end])
                start = end
            total += len(rows)
        if book is None:
            if part:
                return WrittenWorkbook("", "", 0)
            stream = open_output(staged)
            book = WorkbookWriter(stream, self._max_rows)
            book.start_sheet(self._sheet, header)
        book.close()
        stream.close()
        return WrittenWorkbook(staged, f"{self._folder}/part-{part:05d}-{self._job}.xlsx", total)

    def commit(self, messages) -> None:
        def publish(m: WrittenWorkbook) -> None:
            store, staged = _store(m.staged)
            store.move(staged, _store(m.final)[1])

        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(publish, [m for m in messages if m is not None and m.staged]))
        self._drop_staged()

    def abort(self, messages) -> None:
        self._drop_staged()

    def _drop_staged(self) -> None:
        """Remove this job's staging folder, with what failed attempts left in it."""
        store, folder = _store(f"{self._folder}/_staged-{self._job}")
        if store.get_file_info(folder).type.name == "Directory":
            store.delete_dir(folder)


def _values(column: pa.Array) -> list:
    """Python values; a typed cell ``STRUCT<txt, num>`` gives whichever side is filled."""
    if pa.types.is_struct(column.type) and {f.name for f in column.type} == {"txt", "num"}:
        return [
            None if v is None else v["txt"] if v["num"] is None else int(v["num"]) if v["num"].is_integer() else v["num"]
            for v in column.to_pylist()
        ]
    return column.to_pylist()


def write_workbooks(df: DataFrame, folder: str, sheet: str = "Data", force_text: list[str] | None = None) -> None:
    """One workbook per task under ``folder``; a full sheet rolls over to ``Data (2)`` and so on.

    ``force_text`` columns are written as text whatever their type.
    """
    from gridloom.sources.workbook import register

    check_sheet_name(sheet)
    register(df.sparkSession)
    text = set(force_text or ())
    shown = df.select(*[_as_text_cell(df, c).alias(c) if c in text else col(c) for c in df.columns])
    shown.write.format("workbook").mode("append").option("sheet", sheet).option("path", qualified(df.sparkSession, folder)).save()


def _as_text_cell(df: DataFrame, name: str):
    dtype = df.schema[name].dataType
    if isinstance(dtype, StructType) and set(dtype.names) == {"txt", "num"}:
        return F.coalesce(col(name)["txt"], col(name)["num"].cast("string"))
    return col(name).cast("string")


def csv_to_workbook(spark: SparkSession, paths, folder: str, force_text: list[str] | None = None, **options) -> None:
    """CSV files to workbooks, all cells text."""
    from gridloom.sources.csv_files import read_csv

    write_workbooks(read_csv(spark, paths, **options), folder, "Data", force_text)


def workbook_to_csv(spark: SparkSession, paths, folder: str, sheet: str | None = None, encoding: str = "utf-8", sep: str = ",") -> None:
    """One sheet of workbooks to CSV."""
    from gridloom.sinks.csv_files import write_csv
    from gridloom.sources.workbook import read_sheet

    write_csv(read_sheet(spark, paths, sheet), folder, sep=sep, encoding=encoding)
