"""Value frequencies and unique values: per column, per sheet, and over all sheets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.names import col
from gridloom.functions.text import is_filled, norm_text
from gridloom.operators.columns import resolve_column, resolve_columns


#: Values a sketch of :func:`top_frequency` keeps, round by round. Eight bytes each; the last is the most that Spark's sketch takes.
TRACKED = (1 << 14, 1 << 17, 1_000_000)
#: A value that a sketch of n values does not name has this many n-ths of all rows at most: 3.5 is its error for each of
#: the two bounds that a named value has to tell apart.
UNNAMED = 7

#: Types of which different values never print alike once normalised.
_DISTINCT_TYPES = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _is_text(df: DataFrame, name: str) -> bool:
    return not isinstance(df.schema[name].dataType, _DISTINCT_TYPES)


def _grouping_cell(df: DataFrame, name: str, case: str, strip_ws: bool, drop_empty: bool) -> tuple[Column, Column]:
    """What to group a column by, and which rows to keep.

    Text, and what prints as text (arrays, binaries), is grouped by its normal form. Numbers, dates and the like are grouped as they are, which is
    cheaper, and turned into text once per group (:func:`_as_value`).
    """
    cell = col(name)
    if not _is_text(df, name):
        return cell, cell.isNotNull() if drop_empty else F.lit(True)
    cell = cell.cast("string")
    keep = is_filled(cell, strip_ws) if drop_empty else F.lit(True)
    return norm_text(cell, case, strip_ws, blank_nulls=not drop_empty), keep


def _as_value(df: DataFrame, name: str, value: Column, case: str, strip_ws: bool) -> Column:
    return value if _is_text(df, name) else norm_text(value, case, strip_ws)


def frequency(
    df: DataFrame, column: str, case: str = "upper", strip_ws: bool = True, drop_empty: bool = True,
    count_name: str = "cnt", top: int | None = None, ordered: bool = True,
) -> DataFrame:
    """How often each value occurs, most frequent first, ties by value. ``top`` keeps the first ``k``."""
    name = resolve_column(df.columns, column)
    group, keep = _grouping_cell(df, name, case, strip_ws, drop_empty)
    counts = df.where(keep).groupBy(group.alias("__g")).agg(F.count(F.lit(1)).alias(count_name))
    out = counts.select(_as_value(df, name, F.col("__g"), case, strip_ws).alias(name), col(count_name))
    if ordered or top is not None:
        out = out.orderBy(col(count_name).desc(), col(name).asc())
    return out if top is None else out.limit(top)


def top_frequency(
    df: DataFrame, column: str, top: int, case: str = "upper", strip_ws: bool = True, drop_empty: bool = True, count_name: str = "cnt",
) -> DataFrame:
    """:func:`frequency` with ``top``, exact, for columns of very many values: what is shuffled does not grow with them.

    A sketch of each task's value hashes names candidates, and a second scan counts only these. If the last of the first
    ``top`` is not more frequent than a value that the sketch leaves out can be, and the candidates are not all there is, a
    larger sketch is made; where none tells (all values about as rare) all are counted. Runs jobs; no rows give none.
    """
    plain = frequency(df, column, case, strip_ws, drop_empty, count_name, top)
    name = resolve_column(df.columns, column)
    group, keep = _grouping_cell(df, name, case, strip_ws, drop_empty)
    cells = df.where(keep).select(group.alias("__g")).withColumn("__h", F.xxhash64("__g"))
    for tracked in TRACKED:
        if top > tracked:
            continue
        named = F.transform(F.expr(f"approx_top_k(__h, {tracked}, {tracked})"), lambda x: x["item"])
        rows, hashes = cells.agg(F.count(F.lit(1)), named).first()
        candidates = df.sparkSession.createDataFrame(pd.DataFrame({"__h": np.array(hashes, dtype=np.int64)}), "__h long")
        # At most ``tracked`` numbers, so the broadcast is bounded.
        counts = cells.join(F.broadcast(candidates), "__h", "left_semi").groupBy("__g").agg(F.count(F.lit(1)).alias(count_name))
        values = counts.select(_as_value(df, name, F.col("__g"), case, strip_ws).alias(name), col(count_name))
        first = values.orderBy(col(count_name).desc(), col(name).asc()).limit(top).collect()
        certain = len(first) == top and (top == 0 or first[-1][1] > UNNAMED * rows / tracked)
        if certain or counts.agg(F.coalesce(F.sum(count_name), F.lit(0))).first()[0] == rows:
            return df.sparkSession.createDataFrame(first, plain.schema)
    return plain


def unique_values(
    df: DataFrame, column: str, case: str = "upper", strip_ws: bool = True, drop_empty: bool = True,
    count_name: str | None = None, ordered: bool = True,
) -> DataFrame:
    """Distinct values in order. ``count_name`` adds the empty count column of the summary layout."""
    name = resolve_column(df.columns, column)
    group, keep = _grouping_cell(df, name, case, strip_ws, drop_empty)
    distinct = df.where(keep).select(group.alias("__g")).distinct()
    out = distinct.select(_as_value(df, name, F.col("__g"), case, strip_ws).alias(name))
    if ordered:
        out = out.orderBy(col(name).asc_nulls_last())
    return out if count_name is None else out.withColumn(count_name, F.lit(None).cast("long"))


def stack_columns(
    df: DataFrame, columns: str | Sequence[str], case: str = "upper", strip_ws: bool = True,
    drop_empty: bool = True, block: str = "block", value: str = "value", keep: Sequence[str] = (),
) -> DataFrame:
    """Several columns as rows ``(keep…, block, value)``, so one aggregation serves them all."""
    names = resolve_columns(df.columns, columns, on_missing="skip")
    cells = df.select(
        *[col(k) for k in keep],
        *[norm_text(col(n), case, strip_ws, blank_nulls=not drop_empty).alias(f"__v{i}") for i, n in enumerate(names)],
    )
    stacked = cells.unpivot(
        [col(k) for k in keep], [F.col(f"__v{i}").alias(n) for i, n in enumerate(names)], block, value
    )
    return stacked.where(F.col(value) != "") if drop_empty else stacked


def frequency_by_column(
    df: DataFrame, columns: str | Sequence[str], case: str = "upper", strip_ws: bool = True,
    drop_empty: bool = True, count_name: str = "cnt",
) -> DataFrame:
    """Frequency of each column on its own: ``(block, value, cnt)``, one pass over the input."""
    stacked = stack_columns(df, columns, case, strip_ws, drop_empty)
    return stacked.groupBy("block", "value").agg(F.count(F.lit(1)).alias(count_name))


def unique_by_column(
    df: DataFrame, columns: str | Sequence[str], case: str = "upper", strip_ws: bool = True, drop_empty: bool = True
) -> DataFrame:
    """Unique values of each column on its own: ``(block, value)``."""
    return stack_columns(df, columns, case, strip_ws, drop_empty).distinct()


def frequency_by_sheet(
    df: DataFrame, sheet: str, column: str, case: str = "upper", strip_ws: bool = True,
    drop_empty: bool = True, count_name: str = "cnt",
) -> DataFrame:
    """Frequency within each sheet: ``(sheet, value, cnt)``."""
    name = resolve_column(df.columns, column)
    group, keep = _grouping_cell(df, name, case, strip_ws, drop_empty)
    counts = (
        df.where(keep).groupBy(col(sheet).alias("sheet"), group.alias("__g")).agg(F.count(F.lit(1)).alias(count_name))
    )
    return counts.select("sheet", _as_value(df, name, F.col("__g"), case, strip_ws).alias("value"), col(count_name))


def overall(per_sheet: DataFrame, kind: str = "presence", count_name: str = "cnt") -> DataFrame:
    """Roll ``(sheet, value, cnt)`` up over sheets.

    ``presence`` counts the sheets a value occurs in (what the original summary
    printed), ``total`` its rows, ``both`` gives both, ``unique`` only the values.
    """
    by_value = per_sheet.groupBy("value")
    if kind == "presence":
        # One row per sheet and value already, so counting rows counts sheets.
        return by_value.agg(F.count(F.lit(1)).alias(count_name))
    if kind == "total":
        return by_value.agg(F.sum(count_name).alias(count_name))
    if kind == "both":
        return by_value.agg(F.count(F.lit(1)).alias("sheets"), F.sum(count_name).alias(count_name))
    if kind == "unique":
        return per_sheet.select("value").distinct()
    raise ValueError(f"kind must be presence, total, both or unique, not {kind!r}")


def sheet_presence(df: DataFrame, sheet: str, column: str, **options) -> DataFrame:
    return overall(frequency_by_sheet(df, sheet, column, **options), "presence")


def sheet_total(df: DataFrame, sheet: str, column: str, count_name: str = "cnt", **options) -> DataFrame:
    """Rows per value over all sheets. The sheet does not matter for a total, so it is not grouped by."""
    counts = frequency(df, column, count_name=count_name, ordered=False, **options)
    return counts.toDF("value", count_name)


def head(df: DataFrame, n: int = 20, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows, by ``order_by`` where given (a table has no order of its own)."""
    return (df.orderBy(*[col(c) for c in order_by]) if order_by else df).limit(n)
