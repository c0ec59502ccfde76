"""Group summaries over the sheets of workbooks, in one plan for any number of sheets.

What a sheet asks for — where its values, its filters' cells and its keys lie — is a
row of a table. One scan of all sheets is joined with that table, so the plan has as
many steps for a thousand sheets as for one.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.names import unique_headers
from gridloom.functions.text import norm_text
from gridloom.operators.columns import ColumnNotFound, resolve_column, resolve_columns
from gridloom.operators.predicates import Filter, filters_for, letters_of, predicate, read_spec
from gridloom.plans.group_summary import OVERALL_FREQUENCY, OVERALL_UNIQUE
from gridloom.sources.workbook import read_parts, sheet_headers

#: Places that are none: the filter does not hold for the sheet, or lets nothing through.
_LEFT_OUT, _NOTHING = -1, -2


def workbook_summary(
    spark: SparkSession, paths: str | Sequence[str], column: str | Sequence[str], kind: str = "frequency", case: str = "upper",
    strip_ws: bool = True, filters: Sequence[Filter | Mapping] | Mapping[str, Sequence[Filter | Mapping]] | None = None,
    dedup_keys: str | Sequence[str] | None = None, several: bool = False, overall_kind: str = "presence", dialect: str = "summary",
    sheets: str | Sequence[str] | None = None, manifest: str | None = None,
) -> DataFrame:
    """``(block_no, block, value, cnt)`` as :func:`gridloom.plans.group_summary.group_summary` gives it for the sheets read one by one.

    A dict names the filters of each sheet. ``dedup_keys`` keep the first row of each
    key, within each sheet. A sheet that lacks the column is left out with a warning.
    """
    found, letters = sheet_headers(spark, paths, sheets, manifest=manifest), letters_of(dialect)
    specs: dict[Filter, int] = {}
    titles: list[str] = []
    table = []
    for sheet, header in found:
        names = unique_headers(header)
        try:
            chosen = resolve_columns(names, column, on_missing="skip", letters=letters) if several else [resolve_column(names, column, letters=letters)]
        except KeyError as unknown:
            warnings.warn(f"sheet {sheet.sheet!r} left out: {unknown}", stacklevel=2)
            continue
        values = [(len(titles) + i, names.index(c)) for i, c in enumerate(chosen)]
        titles += [f"{sheet.sheet} — {c if several else column}" for c in chosen]
        checks = []
        for spec in filters_for(filters, sheet.sheet):
            f = read_spec(spec, dialect)
            if f.kind != "none":
                checks.append((specs.setdefault(replace(f, column=""), len(specs)), _place(names, f)))
        table.append((sheet.file, sheet.sheet, len(table), values, checks, _keys(names, dedup_keys, letters, sheet.sheet)))
    if not table:
        raise ValueError("no sheet has the column")

    asked = spark.createDataFrame(
        table, "file string, sheet string, sheet_no int, vals array<struct<block_no int, at int>>, checks array<struct<spec int, at int>>, keys array<int>")
    cells = read_parts(spark, [s for s, _ in found]).where(F.col("row_no") > 1)
    # One row for each sheet of the scan.
    rows = cells.join(F.broadcast(asked), ["file", "sheet"])
    for slot in range(max(len(row[4]) for row in table)):
        rows = _meeting(rows, slot, specs)
    if dedup_keys:
        # Rows of a sheet without such columns are keys of their own.
        key = F.coalesce(F.transform("keys", lambda at: F.get("cells", at)), F.array(F.col("row_no").cast("string")))
        first = Window.partitionBy("sheet_no", key).orderBy("row_no")
        rows = rows.withColumn("rank", F.row_number().over(first)).where("rank = 1")
    cell = F.transform("vals", lambda v: F.struct(v["block_no"].alias("block_no"), F.get("cells", v["at"]).alias("cell")))
    stacked = rows.select(F.inline(cell)).select("block_no", norm_text(F.col("cell"), case, strip_ws, blank_nulls=False).alias("value"))
    counts = stacked.where(F.col("value") != "").groupBy("block_no", "value").agg(F.count(F.lit(1)).alias("cnt"))
    out = counts
    if not several:
        # Both measures read cnt, so this is the very aggregation above and its shuffle is reused.
        blocks = F.count_if(F.col("cnt") > 0) if overall_kind == "presence" or kind == "unique" else F.sum("cnt")
        out = counts.union(counts.groupBy("value").agg(blocks.alias("cnt")).select(F.lit(len(titles)), "value", "cnt"))
        titles.append(OVERALL_FREQUENCY if kind == "frequency" else OVERALL_UNIQUE)
    named = spark.createDataFrame(list(enumerate(titles)), "block_no int, block string")
    cnt = F.col("cnt") if kind == "frequency" else F.lit(None).cast("long")
    return out.join(F.broadcast(named), "block_no").select("block_no", "block", "value", cnt.alias("cnt"))


def _place(names: Sequence[str], f: Filter) -> int:
    try:
        return names.index(resolve_column(names, f.column, f.level, f.letters))
    except ColumnNotFound as missing:
        if f.on_missing == "error":
            raise
        if f.on_missing == "empty":
            return _NOTHING
        warnings.warn(f"filter left out: {missing}", stacklevel=3)
        return _LEFT_OUT


def _keys(names: Sequence[str], keys: str | Sequence[str] | None, letters: str, sheet: str) -> list[int] | None:
    if not keys:
        return None
    try:
        return [names.index(n) for n in resolve_columns(names, keys, letters=letters)]
    except KeyError as unknown:
        warnings.warn(f"sheet {sheet!r} not de-duplicated: {unknown}", stacklevel=3)
        return None


def _meeting(rows: DataFrame, slot: int, specs: Mapping[Filter, int]) -> DataFrame:
    """Rows that meet the condition their sheet has in ``slot``, if it has one. One case for each different condition, not for each sheet."""
    check = F.get("checks", F.lit(slot))
    tested = rows.withColumn("tested", F.get("cells", check["at"]))
    holds = F.when(check.isNull() | (check["at"] == _LEFT_OUT), True).when(check["at"] == _NOTHING, False)
    for spec, number in specs.items():
        condition = predicate(tested, replace(spec, column="tested"))
        if condition is not None:
            holds = holds.when(check["spec"] == number, condition)
    return tested.where(holds.otherwise(True)).drop("tested")
