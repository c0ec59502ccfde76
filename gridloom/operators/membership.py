"""Membership in a list too long for literals: semi and anti join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.names import col
from gridloom.functions.text import norm_text
from gridloom.operators.columns import resolve_column

_VALUE = "__member"


def _join(
    df: DataFrame, column: str, values: DataFrame, value_column: str | None, case: str, strip_ws: bool, raw: bool, how: str
) -> DataFrame:
    name = resolve_column(df.columns, column)
    source = col(value_column or values.columns[0])
    # Distinct first: map-side combining takes the heat out of a value that
    # repeats in the list, and the join reuses its partitioning. No broadcast
    # hint: Spark broadcasts by measured size and shuffles beyond it, where
    # adaptive execution splits a hot key on the probing side.
    listed = values.select((source if raw else F.coalesce(source.cast("string"), F.lit(""))).alias(_VALUE)).distinct()
    probe = col(name) if raw else norm_text(col(name), case, strip_ws)
    return df.join(listed, probe == F.col(_VALUE), how)


def keep_members(
    df: DataFrame, column: str, values: DataFrame, value_column: str | None = None,
    case: str = "upper", strip_ws: bool = True, raw: bool = False,
) -> DataFrame:
    """Rows whose normalised cell is in ``values`` (already in that case). ``raw`` compares the columns as they are."""
    return _join(df, column, values, value_column, case, strip_ws, raw, "left_semi")


def drop_members(
    df: DataFrame, column: str, values: DataFrame, value_column: str | None = None,
    case: str = "upper", strip_ws: bool = True, raw: bool = False,
) -> DataFrame:
    """Rows whose normalised cell is not in ``values``."""
    return _join(df, column, values, value_column, case, strip_ws, raw, "left_anti")
