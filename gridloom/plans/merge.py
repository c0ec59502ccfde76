"""Merging files, sheets and tables: filter each source, unite, keep one row per key."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.names import col
from gridloom.operators.dedup import ORD, dedup_by_key, deduplicate
from gridloom.operators.predicates import Filter, apply_filters
from gridloom.operators.union import union_exact, union_normalized
from gridloom.sources.csv_files import read_csv_parts
from gridloom.sources.files import list_files
from gridloom.sources.workbook import read_sheet, unite_sheets

Filters = Sequence[Filter | Mapping] | None


def with_order(df: DataFrame, order_by: str, src: int = 0) -> DataFrame:
    """``_ord`` for a table, from a column that orders it."""
    order = F.struct(F.lit(src).alias("src"), F.lit(0).cast("long").alias("block"), col(order_by).cast("long").alias("seq"))
    return df.withColumn(ORD, order)


def merge_tables(
    frames: Sequence[DataFrame], filters: Filters = None, dedup_keys: Sequence[str] | None = None,
    normalized: bool = False, norm: str = "safe", keep: str = "first", dialect: str = "default",
) -> DataFrame:
    """Filter each frame by its own columns, unite, then one row per key. Frames carry ``_ord`` when keys are given."""
    carry = [ORD] if all(ORD in f.columns for f in frames) else []
    kept = [apply_filters(f, filters, dialect) for f in frames]
    united = union_normalized(kept, norm, carry) if normalized else union_exact(kept, carry)
    return deduplicate(united, dedup_keys, keep=keep) if dedup_keys else united


def merge_files(
    spark: SparkSession, paths: Sequence[str], filters: Filters = None, dedup_keys: Sequence[str] | None = None,
    keep: str = "first", with_order: bool = False, **csv_options,
) -> DataFrame:
    """CSV files and first sheets of workbooks as one table, columns by exact name."""
    csvs = [i for i, p in enumerate(paths) if os.path.splitext(p)[1].lower() != ".xlsx"]
    books = [i for i, p in enumerate(paths) if i not in set(csvs)]
    ordered = with_order or bool(dedup_keys)
    parts = read_csv_parts(spark, [paths[i] for i in csvs], with_order=ordered, **csv_options) if csvs else []
    texts = [(csvs[f.arg], f.src) for part in parts for f in part.files]
    held = Counter(books[f.arg] for f in list_files(spark, [paths[i] for i in books])) if books else Counter()
    # Text files count on by the workbooks that come before them, from the first file behind each argument.
    behind = [(min((src for i, src in texts if i > b), default=None), held[b]) for b in books]
    steps = [(at, n) for at, n in behind if at is not None]
    frames = []
    for part in parts:
        first = min(f.src for f in part.files)
        frames.append((first + sum(n for at, n in steps if first >= at), _counted_on(part.frame, steps)))
    for b in books:
        before = max((src + 1 for i, src in texts if i < b), default=0) + sum(held[i] for i in books if i < b)
        frames.append((before, _counted_on(read_sheet(spark, paths[b], with_order=ordered), [(0, before)])))
    merged = merge_tables([f for _, f in sorted(frames, key=lambda x: x[0])], filters, dedup_keys, keep=keep)
    return merged if with_order else merged.drop(ORD)


def _counted_on(frame: DataFrame, steps: Sequence[tuple[int, int]]) -> DataFrame:
    """``_ord.src`` raised by ``n`` from ``at`` on, for each of ``steps``."""
    if not steps or ORD not in frame.columns:
        return frame
    order = col(ORD)
    src = order["src"]
    for at, n in steps:
        src = src + F.when(order["src"] >= at, n).otherwise(0)
    return frame.withColumn(ORD, F.struct(src.cast("int").alias("src"), order["block"].alias("block"), order["seq"].alias("seq")))


def merge_sheets(
    spark: SparkSession, paths: str | Sequence[str], sheets: Sequence[str] | None = None, filters: Filters = None,
    dedup_keys: Sequence[str] | None = None, norm: str = "safe", keep: str = "first", with_order: bool = False,
) -> DataFrame:
    """Sheets with different headers as one table, columns by normalised name; unknown sheet names are passed over."""
    united = unite_sheets(spark, paths, sheets, norm, on_missing="ignore", with_order=True)
    merged = apply_filters(united, filters)
    merged = deduplicate(merged, dedup_keys, keep=keep) if dedup_keys else merged
    return merged if with_order else merged.drop(ORD)


def unify_tables(
    frames: Sequence[DataFrame], keys: Sequence[str], filters: Filters = None, norm: str = "safe",
    upper: bool = True, drop_spaces: bool = False, drop_dashes: bool = False, dialect: str = "unify",
) -> DataFrame:
    """Unite by normalised name, filter the united row, keep the first row of each key."""
    if not keys:
        raise ValueError("give at least one key column")
    united = union_normalized(frames, norm, [ORD])
    kept = apply_filters(united, filters, dialect)
    return dedup_by_key(kept, keys, upper=upper, drop_spaces=drop_spaces, drop_dashes=drop_dashes)


def unify_unique(
    spark: SparkSession, paths: str | Sequence[str], keys: Sequence[str], filters: Filters = None, base: str = "UNIQUE",
    norm: str = "safe", upper: bool = True, drop_spaces: bool = False, drop_dashes: bool = False, with_order: bool = False,
) -> DataFrame:
    """The same over the sheets of workbooks; sheets an earlier run wrote (named ``base``) are not read."""
    if not keys:
        raise ValueError("give at least one key column")
    united = unite_sheets(spark, paths, norm=norm, base=base, with_order=True)
    kept = apply_filters(united, filters, "unify")
    unique = dedup_by_key(kept, keys, upper=upper, drop_spaces=drop_spaces, drop_dashes=drop_dashes)
    return unique if with_order else unique.drop(ORD)
