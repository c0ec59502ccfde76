"""Column addressing: names, spreadsheet letters, letter ranges. Works on names, returns names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.names import col, letters_to_index, norm_name

_LETTERS = re.compile(r"[A-Za-z]+")
_RANGE = re.compile(r"([A-Za-z]{1,3}):([A-Za-z]{1,3})")


class ColumnNotFound(KeyError):
    """No column answers to the token."""


def resolve_column(columns: Sequence[str], token: str, level: str = "full", letters: str = "all") -> str:
    """The one column a token means.

    ``full``: exact name, then letter, then loose name, then part of a loose name.
    ``ci``: exact name, then equal without case and outer blanks.
    """
    if token in columns:
        return token
    if level == "ci":
        wanted = token.strip().lower()
        hits = [c for c in columns if c.strip().lower() == wanted]
        if wanted and hits:
            return hits[-1]
        raise ColumnNotFound(f"no column {token!r} among {list(columns)}")

    bare = token.strip()
    if _LETTERS.fullmatch(bare) and len(bare) <= 3 and letters_to_index(bare) < len(columns):
        return columns[letters_to_index(bare)]
    wanted = norm_name(token, letters)
    if wanted:
        loose = [(c, norm_name(c, letters)) for c in columns]
        for c, n in loose:
            if n == wanted:
                return c
        for c, n in loose:
            if n and (wanted in n or n in wanted):
                return c
    raise ColumnNotFound(f"no column {token!r} among {list(columns)}")


def resolve_columns(
    columns: Sequence[str], token: str | Sequence[str], on_missing: str = "error", letters: str = "all"
) -> list[str]:
    """Several columns: ``B:D``, ``B,D,F``, ``Brand,Model`` or a list of tokens.

    A list of words is read as names when every word is one, else as letters.
    ``on_missing='skip'`` drops unknown words and fails only when none is left.
    """
    if isinstance(token, str):
        span = _RANGE.fullmatch(token.strip())
        if span:
            first, last = sorted(letters_to_index(x) for x in span.groups())
            return list(columns[first : last + 1])
        words = [w.strip() for w in token.split(",") if w.strip()]
    else:
        words = list(token)

    by_loose_name = {norm_name(c, letters): c for c in reversed(columns)}
    named = [w if w in columns else by_loose_name.get(norm_name(w, letters)) for w in words]
    if words and all(named):
        return named

    found = []
    for word in words:
        try:
            found.append(resolve_column(columns, word, letters=letters))
        except ColumnNotFound:
            if on_missing == "error":
                raise
    if not found:
        raise ColumnNotFound(f"no column answers to {token!r} among {list(columns)}")
    return found


def resolve_positions(columns: Sequence[str], token: str | Sequence[str]) -> list[int]:
    """As :func:`resolve_columns`, as positions; unknown names are left out."""
    return [list(columns).index(c) for c in resolve_columns(columns, token, on_missing="skip")]


def select_columns(df: DataFrame, token: str | Sequence[str]) -> DataFrame:
    return df.select(*[col(c) for c in resolve_columns(df.columns, token)])


def reindex(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order: extra ones go, absent ones are NULL text."""
    have = set(df.columns)
    return df.select(
        *[col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]
    )


def rename_column(df: DataFrame, token: str, display: str) -> DataFrame:
    name = resolve_column(df.columns, token)
    return df.select(*[col(c).alias(display) if c == name else col(c) for c in df.columns])
