"""Numbers held in text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.text import strip

# What counts as a number in a text cell, and how long ids stay text.
NUMERIC_CELL = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
INFINITY_CELL = r"^(?i:[+-]?inf(?:inity)?)$"
LONG_ID = r"^[0-9]{11,}$"
PLAIN_NUMBER = r"^[+-]?[0-9]+(?:\.[0-9]+)?$"
MAX_DIGITS = 15


def decimal_point(c: Column) -> Column:
    """Decimal comma to decimal point."""
    return F.replace(c, F.lit(","), F.lit("."))


def to_numeric(c: Column, decimal_comma: bool = False) -> Column:
    """Text to DOUBLE; NULL for anything that is not a plain number.

    ``try_cast`` alone also takes ``1d``, ``1f``, hexadecimal floats and ``nan``
    and turns an overflow into infinity; those cells are not numbers here.
    """
    text = c.cast("string")
    if decimal_comma:
        text = decimal_point(text)
    number = text.try_cast("double")
    finite = number.isNotNull() & text.rlike(NUMERIC_CELL) & (F.abs(number) < F.lit(float("inf")))
    return F.when(finite, number).when(text.rlike(INFINITY_CELL), number)


def parse_number(text: object, decimal_comma: bool = True) -> float | None:
    """A filter bound given as text or number; None when it is not one."""
    try:
        raw = str(text).strip()
        return float(raw.replace(",", ".") if decimal_comma else raw)
    except ValueError:
        return None


def safe_number(c: Column) -> Column:
    """Cell typing for sheet export: ``STRUCT<txt STRING, num DOUBLE>`` with exactly one side filled.

    Ids of eleven digits or more stay text; numbers of at most fifteen digits
    become numbers (``007`` is 7); everything else stays text.
    """
    text = strip(F.coalesce(c.cast("string"), F.lit("")))
    pointed = decimal_point(text)
    digits = F.length(F.regexp_replace(pointed, "[^0-9]", ""))
    is_number = pointed.rlike(PLAIN_NUMBER) & (digits <= MAX_DIGITS) & ~text.rlike(LONG_ID)
    number = F.when(is_number, pointed.try_cast("double"))
    return F.struct(F.when(number.isNull(), text).alias("txt"), number.alias("num"))
