"""Frequencies or unique values per sheet and column, with a block over all sheets."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.columns import resolve_column, resolve_columns
from gridloom.operators.dedup import ORD, dedup_raw
from gridloom.operators.predicates import apply_filters, filters_for, letters_of
from gridloom.operators.profile import display_width
from gridloom.operators.summarize import stack_columns

# Titles of the block over all sheets, and the count column's header.
OVERALL_FREQUENCY = "ЗАГАЛОМ — підсумок"
OVERALL_UNIQUE = "ЗАГАЛОМ — унікальні"
COUNT_TITLE = "КІЛЬКІСТЬ"


def group_summary(
    sheets: Mapping[str, DataFrame], column: str | Sequence[str], kind: str = "frequency", case: str = "upper",
    strip_ws: bool = True, filters=None, dedup_keys: str | Sequence[str] | None = None,
    order_by: Sequence[str] | str | None = None, several: bool = False, overall_kind: str = "presence",
    dialect: str = "summary",
) -> DataFrame:
    """``(block_no, block, value, cnt)``: one block per sheet (and column, with ``several``).

    Per sheet: filter, keep the first row per key, count. All sheets and columns
    share one aggregation. With one column a last block covers all sheets:
    ``presence`` counts the sheets a value occurs in, ``total`` its rows.
    A sheet that lacks the column is left out with a warning.
    """
    parts, position = [], 0
    for name, df in sheets.items():
        kept = apply_filters(df, filters_for(filters, name), dialect)
        if dedup_keys:
            try:
                # Checked first, so that only an unknown key, not a missing order, is passed over.
                keys = resolve_columns(df.columns, dedup_keys, letters=letters_of(dialect))
            except KeyError as unknown:
                warnings.warn(f"sheet {name!r} not de-duplicated: {unknown}", stacklevel=2)
            else:
                order = [order_by] if isinstance(order_by, str) else order_by
                kept = dedup_raw(kept, keys, "first", order and [resolve_column(df.columns, o, letters=letters_of(dialect)) for o in order])
        data_columns = [c for c in df.columns if c != ORD]
        try:
            if several:
                columns = resolve_columns(data_columns, column, on_missing="skip", letters=letters_of(dialect))
                titles = [f"{name} — {c}" for c in columns]
            else:
                columns = [resolve_column(data_columns, column, letters=letters_of(dialect))]
                titles = [f"{name} — {column}"]
        except KeyError as unknown:
            warnings.warn(f"sheet {name!r} left out: {unknown}", stacklevel=2)
            continue
        stacked = stack_columns(kept, columns, case, strip_ws)
        place = reduce(
            lambda chain, i: chain.when(F.col("block") == columns[i], position + i),
            range(1, len(columns)), F.when(F.col("block") == columns[0], position),
        ).cast("int")
        parts.append((titles, stacked.select(place.alias("block_no"), "value")))
        position += len(columns)
    if not parts:
        raise ValueError("no sheet has the column")

    titles = [t for ts, _ in parts for t in ts]
    cells = reduce(DataFrame.union, [p for _, p in parts])
    counts = cells.groupBy("block_no", "value").agg(F.count(F.lit(1)).alias("cnt"))
    last = len(titles)
    out = counts
    if not several:
        # Both measures read cnt, so this is the very aggregation above and its shuffle is reused.
        blocks = F.count_if(F.col("cnt") > 0) if overall_kind == "presence" or kind == "unique" else F.sum("cnt")
        rolled = counts.groupBy("value").agg(blocks.alias("cnt"))
        out = counts.union(rolled.select(F.lit(last).alias("block_no"), "value", "cnt"))
        titles.append(OVERALL_FREQUENCY if kind == "frequency" else OVERALL_UNIQUE)
    named = F.get(F.array(*[F.lit(t) for t in titles]), F.col("block_no"))
    cnt = F.col("cnt") if kind == "frequency" else F.lit(None).cast("long")
    return out.select("block_no", named.alias("block"), "value", cnt.alias("cnt"))


def stack_blocks(summary: DataFrame, value_title: str, count_title: str = COUNT_TITLE) -> DataFrame:
    """A summary as sheet rows: per block a title, a header, the values, a blank row.

    ``(block_no, part, a, b, cnt)``; the sheet's row order is ``block_no, part, cnt desc, a``.
    """
    values = summary.select(
        "block_no", F.lit(2).alias("part"), F.col("value").alias("a"), F.col("cnt").cast("string").alias("b"), "cnt"
    )
    # One row per block: distinct combines before the shuffle.
    blocks = summary.select("block_no", "block").distinct()
    nothing = F.lit(None).cast("string")
    lines = [(0, F.col("block"), nothing), (1, F.lit(value_title), F.lit(count_title)), (3, nothing, nothing)]
    frame = blocks.select(
        "block_no", F.inline(F.array(*[F.struct(F.lit(n).alias("part"), a.alias("a"), b.alias("b")) for n, a, b in lines]))
    ).withColumn("cnt", F.lit(None).cast("long"))
    return values.unionByName(frame)


def block_widths(stacked: DataFrame) -> DataFrame:
    """One row ``(a, b)``: the widths of the summary sheet's two columns."""
    widths = [display_width(F.coalesce(F.max(F.length(c)), F.lit(0)), summary=True).cast("int").alias(c) for c in ("a", "b")]
    return stacked.agg(*widths)
