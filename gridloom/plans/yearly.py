"""Many files by year: filter every file, then fill capped sheets per year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.names import col
from gridloom.operators.ordering import SHEET_ROWS, split_sheets
from gridloom.operators.predicates import Filter, apply_filters
from gridloom.operators.union import union_exact
from gridloom.sources.csv_files import ORD, YEAR, CsvPart, read_csv_parts


def yearly_rows(
    spark: SparkSession, paths: str | Sequence[str], filters: Sequence[Filter | Mapping] | None = None,
    years: Mapping[str, int] | None = None, columns: str = "all", dialect: str = "worker", **csv_options,
) -> DataFrame:
    """Kept rows of all files with ``_ord`` and ``_year``.

    ``columns='first'`` gives each year the columns of its first file: others of
    that year lose their extra columns. ``all`` loses nothing.
    """
    parts = read_csv_parts(spark, paths, with_year=True, years=years, **csv_options)
    frames = [apply_filters(p.frame, filters, dialect) for p in parts]
    if columns == "first":
        frames = _first_columns(parts, frames)
    return frames[0] if len(frames) == 1 else union_exact(frames, [ORD, YEAR])


def _first_columns(parts: Sequence[CsvPart], frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Each frame without the cells its year's first file has no column for."""
    first_file: dict[int, tuple[int, set[str]]] = {}
    for p, f in zip(parts, frames):
        for src, year in p.years.items():
            if year not in first_file or src < first_file[year][0]:
                first_file[year] = (src, set(f.columns))
    out = []
    for p, f in zip(parts, frames):
        cells = []
        for c in f.columns:
            having = sorted({y for y in p.years.values() if c in first_file[y][1]})
            if c in (ORD, YEAR) or len(having) == len(set(p.years.values())):
                cells.append(col(c))
            elif having:
                cells.append(F.when(col(YEAR).isin(having), col(c)).alias(c))
        out.append(f.select(*cells))
    return out


def yearly_sheets(
    spark: SparkSession, paths: str | Sequence[str], filters: Sequence[Filter | Mapping] | None = None,
    years: Mapping[str, int] | None = None, cap: int = SHEET_ROWS, columns: str = "all", **options,
) -> DataFrame:
    """:func:`yearly_rows` with ``sheet_no``, ``sheet`` and ``sheet_row``, ready for the sheet export."""
    return split_sheets(yearly_rows(spark, paths, filters, years, columns, **options), YEAR, cap)
