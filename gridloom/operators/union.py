"""Stacking sources whose headers differ."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.names import norm_header


@dataclass(frozen=True)
class UnionSchema:
    """Columns of a union and, per source, the position each one is read from (None: absent there)."""

    display: tuple[str, ...]
    keys: tuple[str, ...]
    positions: tuple[tuple[int | None, ...], ...]


def union_schema(headers: Sequence[Sequence[str]], norm: str = "safe", exact: bool = False) -> UnionSchema:
    """First-seen order and first-seen spelling; within a source the first of equal headers counts; blank ones drop."""
    display: dict[str, str] = {}
    firsts: list[dict[str, int]] = []
    for header in headers:
        first: dict[str, int] = {}
        for i, name in enumerate(header):
            key = name if exact else norm_header(name, norm)
            if key == "" and not exact:
                continue
            first.setdefault(key, i)
            display.setdefault(key, name)
        firsts.append(first)
    keys = tuple(display)
    return UnionSchema(tuple(display.values()), keys, tuple(tuple(f.get(k) for k in keys) for f in firsts))


def _common_type(types: list[T.DataType]) -> T.DataType:
    return types[0] if all(t == types[0] for t in types) else T.StringType()


def _stack(frames: Sequence[DataFrame], plan: UnionSchema, carry: Sequence[str] = ()) -> DataFrame:
    # Everything goes by position under internal names, so headers that differ in
    # case only, repeat, or hold dots need no session setting.
    types = []
    for k in range(len(plan.keys)):
        found = [f.schema.fields[p[k]].dataType for f, p in zip(frames, plan.positions) if p[k] is not None]
        types.append(_common_type(found))
    parts = []
    for frame, positions in zip(frames, plan.positions):
        inner = frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])
        cells = [
            (F.lit(None) if p is None else F.col(f"c{p}")).cast(t).alias(f"u{k}")
            for k, (p, t) in enumerate(zip(positions, types))
        ]
        extra = [F.col(f"c{frame.columns.index(c)}").alias(f"x{i}") for i, c in enumerate(carry)]
        parts.append(inner.select(*cells, *extra))
    return reduce(DataFrame.union, parts).toDF(*plan.display, *carry)


def union_exact(frames: Sequence[DataFrame], carry: Sequence[str] = ()) -> DataFrame:
    """All rows; columns match by exact name, in first-seen order, absent ones are NULL.

    ``carry`` names technical columns (such as ``_ord``) every frame has; they go last.
    """
    headers = [[None if c in carry else c for c in f.columns] for f in frames]
    return _stack(frames, _without_carried(headers, exact=True), carry)


def union_normalized(frames: Sequence[DataFrame], norm: str = "safe", carry: Sequence[str] = ()) -> DataFrame:
    """All rows; columns match by normalised name, shown as first spelled."""
    headers = [[None if c in carry else c for c in f.columns] for f in frames]
    return _stack(frames, _without_carried(headers, norm=norm), carry)


def _without_carried(headers: list[list[str | None]], norm: str = "safe", exact: bool = False) -> UnionSchema:
    slots = [[i for i, c in enumerate(h) if c is not None] for h in headers]
    plan = union_schema([[h[i] for i in s] for h, s in zip(headers, slots)], norm, exact)
    positions = tuple(tuple(None if p is None else s[p] for p in row) for row, s in zip(plan.positions, slots))
    return UnionSchema(plan.display, plan.keys, positions)


def tag_sheets(sheets: Mapping[str, DataFrame]) -> list[DataFrame]:
    """Each named frame with its name in a ``sheet`` column."""
    return [df.withColumn("sheet", F.lit(name)) for name, df in sheets.items()]
