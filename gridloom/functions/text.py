"""Text normalisation on columns; everything stays in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes; Spark's trim() alone removes U+0020 only.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

CASES = ("upper", "lower", "keep")


def as_text(c: Column) -> Column:
    """Cell as text; missing is the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Unicode blanks off both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def fold_case(c: Column, case: str = "upper") -> Column:
    if case not in CASES:
        raise ValueError(f"case must be one of {CASES}, not {case!r}")
    if case == "upper":
        return F.upper(c)
    if case == "lower":
        return F.lower(c)
    return c


def fold_case_literal(text: str, case: str) -> str:
    return text.upper() if case == "upper" else text.lower() if case == "lower" else text


def norm_text(c: Column, case: str = "upper", strip_ws: bool = True, blank_nulls: bool = True) -> Column:
    """Comparable form of a cell. ``blank_nulls=False`` leaves missing as NULL where the caller drops it anyway."""
    text = c.cast("string")
    if strip_ws:
        text = strip(text)
    text = fold_case(text, case)
    return F.coalesce(text, F.lit("")) if blank_nulls else text


def is_filled(c: Column, strip_ws: bool = True) -> Column:
    """Is the normalised text cell other than ``''``? Looks at the first character that counts, not at the whole cell."""
    return (F.ltrim(c, F.lit(WHITESPACE)) if strip_ws else c) != ""


def norm_key(
    c: Column, upper: bool = True, strip_ws: bool = True, drop_spaces: bool = False, drop_dashes: bool = False
) -> Column:
    """Comparable form of a key cell: strip, then drop blanks, then dashes, then upper."""
    key = as_text(c)
    if strip_ws:
        key = strip(key)
    if drop_spaces:
        key = F.replace(key, F.lit(" "), F.lit(""))
    if drop_dashes:
        key = F.replace(key, F.lit("-"), F.lit(""))
    return F.upper(key) if upper else key


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
