"""Row filters: a small declarative spec turned into boolean columns.

A filter is a :class:`Filter`, or a dict in one of four dialects (the tools this
library replaces disagreed on key names, case rules and mode ``6``).
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.names import col
from gridloom.functions.numbers import parse_number, to_numeric
from gridloom.functions.text import fold_case_literal, norm_text
from gridloom.operators.columns import ColumnNotFound, resolve_column
from gridloom.operators.membership import keep_members

# Filter modes by number.
MODES = {"0": "none", "1": "eq", "2": "contains", "3": "in", "4": "num_eq", "5": "num_range", "6": "regex"}

# Beyond this many list values a filter becomes a semi join instead of literals.
MAX_LITERALS = 5_000


@dataclass(frozen=True)
class Filter:
    """One condition on one column. Conditions in a list are combined with AND."""

    kind: str
    column: str = ""
    value: str = ""
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    number: float | None = None
    case: str = "upper"
    strip_ws: bool = True
    contains: str = "literal"
    decimal_comma: bool = False
    on_missing: str = "skip"
    on_bad_pattern: str = "skip"
    level: str = "full"
    letters: str = "all"


@dataclass(frozen=True)
class Dialect:
    """How a dict spec is read: key names, defaults and the meaning of mode ``6``."""

    keys: Mapping[str, str]
    base: Filter
    default_mode: str
    regex_mode: bool = True
    regex_case: str | None = None
    fixed_case: Mapping[str, str] | None = None
    target_comma: bool = True
    bounds_together: bool = False


_PLAIN_KEYS = {"mode": "mode", "column": "column", "eq": "value", "contains": "value", "in": "values",
               "num_eq": "value", "low": "min", "high": "max", "regex": "pattern"}
_SUMMARY_KEYS = {"mode": "type", "column": "col_token", "eq": "eq_value", "contains": "substr", "in": "list_values",
                 "num_eq": "num_eq", "low": "num_min", "high": "num_max", "regex": "pattern"}
_ROW_CASE = {"eq": "keep", "contains": "lower", "in": "lower"}

DIALECTS = {
    "default": Dialect(_PLAIN_KEYS, Filter("none"), "0", regex_case="keep"),
    "summary": Dialect(_SUMMARY_KEYS, Filter("none", column="A", letters="summary"), "2", bounds_together=True),
    "worker": Dialect(
        _PLAIN_KEYS, Filter("none", strip_ws=False, contains="regex", on_missing="empty", level="ci"), "6",
        regex_mode=False, fixed_case=_ROW_CASE, target_comma=False, bounds_together=True,
    ),
    "unify": Dialect(
        _PLAIN_KEYS, Filter("none", strip_ws=False, decimal_comma=True, level="ci"), "6",
        regex_mode=False, fixed_case=_ROW_CASE,
    ),
}


def letters_of(dialect: str) -> str:
    """The summary report folds fewer look-alike letters than the other tools."""
    return "summary" if dialect == "summary" else "all"


def read_spec(spec: Filter | Mapping | None, dialect: str = "default") -> Filter:
    """A dict spec as a :class:`Filter`."""
    if isinstance(spec, Filter):
        return spec
    d = DIALECTS[dialect]
    if not spec:
        return d.base
    keys = d.keys
    mode = str(spec.get(keys["mode"], d.default_mode))
    kind = MODES.get(mode, "none")
    if kind == "regex" and not d.regex_mode:
        kind = "none"
    f = replace(d.base, kind=kind, column=str(spec.get(keys["column"], d.base.column)))
    if d.fixed_case is not None:
        f = replace(f, case=d.fixed_case.get(kind, "keep"))
    else:
        default_case = d.regex_case if kind == "regex" and d.regex_case else "upper"
        f = replace(f, case=spec.get("case", default_case), strip_ws=bool(spec.get("strip_ws", True)))
    for option in ("on_missing", "decimal_comma", "contains"):
        if option in spec:
            f = replace(f, **{option: spec[option]})

    if kind in ("eq", "contains"):
        return replace(f, value=str(spec.get(keys[kind], "")))
    if kind == "in":
        return replace(f, values=tuple(str(v) for v in spec.get(keys["in"], ())))
    if kind == "regex":
        return replace(f, value=str(spec.get(keys["regex"], ".*")))
    if kind == "num_eq":
        return replace(f, number=parse_number(spec.get(keys["num_eq"], ""), d.target_comma))
    if kind == "num_range":
        low, high = (parse_number(spec.get(keys[k], ""), d.target_comma) for k in ("low", "high"))
        if d.bounds_together and (low is None or high is None):
            low = high = None
        return replace(f, low=low, high=high)
    return f


# --- regular expressions ------------------------------------------------------

_NAMED = re.compile(r"\(\?P<([A-Za-z][A-Za-z0-9]*)>")
_BACKREF = re.compile(r"\(\?P=([A-Za-z][A-Za-z0-9]*)\)")
# Constructs that mean something else, or nothing, in a Java pattern.
_PYTHON_ONLY = re.compile(
    r"&&|\[[^\]]*\[|\[\^?\]|\[[^\]]*\\b|\(\?P|\(\?\(|\(\?[imsu]*[axL]|\(\?#|\\[0-9]{2,}|\\0|\\[UNv]|\\Z."
    r"|(?<!\\)\{(?![0-9]+(?:,[0-9]*)?\})"
)


def java_pattern(pattern: str) -> str | None:
    """The pattern for ``rlike``; None when it has no safe equivalent.

    ``(?Ud)``: Unicode classes, and only a line feed ends a line, as in Python.
    """
    text = _BACKREF.sub(r"\\k<\1>", _NAMED.sub(r"(?<\1>", pattern))
    if _PYTHON_ONLY.search(text):
        return None
    return "(?Ud)" + re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", text)


def regex_search(c: Column, pattern: str) -> Column:
    """``re.search`` on every cell: in the JVM where possible, else an Arrow-batched UDF."""
    translated = java_pattern(pattern)
    if translated is not None:
        return c.rlike(translated)

    @F.pandas_udf(T.BooleanType())
    def search(cells: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)
        return cells.map(lambda x: x is not None and compiled.search(x) is not None)

    return search(c)


# --- predicates ---------------------------------------------------------------


def _number_column(df: DataFrame, name: str, decimal_comma: bool) -> tuple[Column, T.DataType]:
    dtype = next(f.dataType for f in df.schema.fields if f.name == name)
    if isinstance(dtype, T.NumericType):
        return col(name), dtype
    return to_numeric(col(name), decimal_comma), T.DoubleType()


def _bound(value: float, dtype: T.DataType, side: str) -> Column:
    # Integer columns get integer bounds, so that the comparison needs no cast on
    # the column and reaches the file scan.
    if isinstance(dtype, T.IntegralType) and math.isfinite(value) and abs(value) < 2**53:
        return F.lit(math.ceil(value) if side == "low" else math.floor(value))
    return F.lit(float(value))


def _number_predicate(df: DataFrame, name: str, f: Filter) -> Column:
    c, dtype = _number_column(df, name, f.decimal_comma)
    if f.kind == "num_eq":
        if f.number is None or math.isnan(f.number):
            return F.lit(False)
        if isinstance(dtype, T.IntegralType) and f.number.is_integer() and abs(f.number) < 2**53:
            return c == F.lit(int(f.number))
        return c == F.lit(f.number)
    if any(b is not None and math.isnan(b) for b in (f.low, f.high)):
        return F.lit(False)
    low = None if f.low in (None, -math.inf) else c >= _bound(f.low, dtype, "low")
    if f.high in (None, math.inf):
        # Not-a-number sorts above infinity, so this bound also keeps it out.
        high = c <= F.lit(math.inf) if not isinstance(dtype, T.IntegralType) else c.isNotNull()
    else:
        high = c <= _bound(f.high, dtype, "high")
    return high if low is None else low & high


def _text_predicate(df: DataFrame, name: str, f: Filter) -> Column:
    def cell(blank_nulls: bool) -> Column:
        return norm_text(col(name), f.case, f.strip_ws, blank_nulls)

    if f.kind == "eq":
        wanted = fold_case_literal(f.value.strip() if f.strip_ws else f.value, f.case)
        return cell(wanted == "") == F.lit(wanted)
    if f.kind == "contains":
        needle = fold_case_literal(f.value, f.case)
        if f.contains == "regex":
            return regex_search(cell(True), needle)
        return F.contains(cell(needle == ""), F.lit(needle))
    if f.kind == "in":
        wanted = [fold_case_literal(v, f.case) for v in dict.fromkeys(f.values)]
        return cell("" in wanted).isin(wanted) if wanted else F.lit(False)
    return regex_search(cell(True), f.value)


def predicate(df: DataFrame, spec: Filter | Mapping, dialect: str = "default") -> Column | None:
    """The condition as a boolean column; None when it lets every row through."""
    f = read_spec(spec, dialect)
    if f.kind == "none":
        return None
    try:
        name = resolve_column(df.columns, f.column, f.level, f.letters)
    except ColumnNotFound as missing:
        if f.on_missing == "error":
            raise
        if f.on_missing == "empty":
            return F.lit(False)
        warnings.warn(f"filter left out: {missing}", stacklevel=2)
        return None
    pattern = f.value if f.kind == "regex" else None
    if f.kind == "contains" and f.contains == "regex":
        pattern = fold_case_literal(f.value, f.case)
    if pattern is not None:
        try:
            re.compile(pattern)
        except re.error as bad:
            if f.on_bad_pattern == "error":
                raise
            warnings.warn(f"filter left out: {bad}", stacklevel=2)
            return None
    return _number_predicate(df, name, f) if f.kind in ("num_eq", "num_range") else _text_predicate(df, name, f)


def apply_filters(df: DataFrame, specs: Iterable[Filter | Mapping] | None, dialect: str = "default") -> DataFrame:
    """Rows that meet every condition."""
    for spec in specs or ():
        f = read_spec(spec, dialect)
        if f.kind == "in" and len(f.values) > MAX_LITERALS:
            df = _filter_by_list(df, f)
            continue
        condition = predicate(df, f)
        if condition is not None:
            df = df.where(condition)
    return df


def _filter_by_list(df: DataFrame, f: Filter) -> DataFrame:
    try:
        name = resolve_column(df.columns, f.column, f.level, f.letters)
    except ColumnNotFound:
        condition = predicate(df, f)
        return df if condition is None else df.where(condition)
    wanted = [(fold_case_literal(v, f.case),) for v in dict.fromkeys(f.values)]
    listed = df.sparkSession.createDataFrame(wanted, "value string")
    return keep_members(df, name, listed, case=f.case, strip_ws=f.strip_ws)


def filters_for(
    filters: Sequence[Filter | Mapping] | Mapping[str, Sequence[Filter | Mapping]] | None, source: str
) -> Sequence[Filter | Mapping]:
    """The filters of one source: one list serves all sources, a dict gives each its own."""
    if not filters:
        return ()
    if isinstance(filters, Mapping):
        return filters.get(source, ())
    return filters
