"""One row per key: first, last, or only keys that occur once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.names import col
from gridloom.functions.text import norm_key, norm_text
from gridloom.operators.columns import resolve_column, resolve_columns

ORD = "_ord"
_RANK = "__rank"
_COUNT = "__copies"
_KEY = "__key"


def _order(df: DataFrame, order_by: Sequence[str] | str | None, keep: str) -> list[Column]:
    names = [order_by] if isinstance(order_by, str) else list(order_by or ())
    if not names:
        if ORD not in df.columns:
            raise ValueError(f"first and last need an order: give order_by, or scan with {ORD}")
        names = [ORD]
    return [col(n).desc() if keep == "last" else col(n).asc() for n in names]


def _pick(df: DataFrame, keys: list[Column], order_by: Sequence[str] | str | None, keep: str | bool) -> DataFrame:
    if keep in ("none", False):
        # Two rows per key settle whether it repeats, and a rank limit is applied
        # before the shuffle: a hot key leaves each task as at most two rows.
        names = [f"{_KEY}{i}" for i in range(len(keys))]
        keyed = df.select("*", *[k.alias(n) for k, n in zip(keys, names)])
        by_key = Window.partitionBy(*names)
        few = keyed.withColumn(_RANK, F.row_number().over(by_key.orderBy(*names))).where(F.col(_RANK) <= 2)
        once = few.withColumn(_COUNT, F.count(F.lit(1)).over(by_key)).where(F.col(_COUNT) == 1)
        return once.drop(_RANK, _COUNT, *names)
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be first, last or none, not {keep!r}")
    # rank = 1 plans a WindowGroupLimit on both sides of the shuffle, so a key that
    # holds a third of all rows sends one row per task.
    ranked = Window.partitionBy(*keys).orderBy(*_order(df, order_by, keep))
    return df.withColumn(_RANK, F.row_number().over(ranked)).where(F.col(_RANK) == 1).drop(_RANK)


def dedup_raw(
    df: DataFrame, keys: str | Sequence[str], keep: str | bool = "first", order_by: Sequence[str] | str | None = None
) -> DataFrame:
    """By the cells as they are; missing equals missing."""
    names = resolve_columns(df.columns, keys)
    return _pick(df, [col(n) for n in names], order_by, keep)


def dedup_normalized(
    df: DataFrame, keys: Sequence[str], keep: str | bool = "first", order_by: Sequence[str] | str | None = None
) -> DataFrame:
    """By stripped upper-case cells; the key columns of the result hold those normalised values."""
    names = [resolve_column(df.columns, k) for k in keys]
    normalized = df.select(*[norm_text(col(c)).alias(c) if c in names else col(c) for c in df.columns])
    return _pick(normalized, [col(n) for n in names], order_by, keep)


def dedup_by_key(
    df: DataFrame, keys: Sequence[str], keep: str | bool = "first", order_by: Sequence[str] | str | None = None,
    upper: bool = True, drop_spaces: bool = False, drop_dashes: bool = False, level: str = "ci",
) -> DataFrame:
    """By a configurable key; key cells keep their spelling and become text, missing ones ``''``."""
    names = [resolve_column(df.columns, k, level) for k in keys]
    as_text = df.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(c) if c in names else col(c) for c in df.columns])
    computed = [norm_key(col(n), upper, True, drop_spaces, drop_dashes) for n in names]
    return _pick(as_text, computed, order_by, keep)


def deduplicate(
    df: DataFrame, keys: Sequence[str], normalize_keys: bool = True, keep: str | bool = "first",
    order_by: Sequence[str] | str | None = None,
) -> DataFrame:
    return (dedup_normalized if normalize_keys else dedup_raw)(df, keys, keep, order_by)
