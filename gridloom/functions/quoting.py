"""Quotes and separators inside raw lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic quotes and the ASCII quotes they stand for.
QUOTES = {
    "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"',
    "‚": "'", "‘": "'", "’": "'", "‹": "'", "›": "'", "´": "'", "`": "'",
}

# A noncharacter: cannot occur in valid text, so it can stand in for an active separator.
_MARK = "￿"


def norm_quotes(c: Column, apostrophe_as_quote: bool = False) -> Column:
    """Typographic quotes to ASCII, ``\\"`` to a doubled quote.

    With ``apostrophe_as_quote`` single quotes become double ones; off by default,
    because then the apostrophe in a Ukrainian word opens a quoted field.
    """
    # Byte-wise replacements beat a per-character map on text that holds few of them.
    text = c
    for typographic, ascii_quote in QUOTES.items():
        if apostrophe_as_quote or ascii_quote == '"':
            text = F.replace(text, F.lit(typographic), F.lit(ascii_quote))
    text = F.replace(text, F.lit('\\"'), F.lit('""'))
    return F.replace(text, F.lit("'"), F.lit('"')) if apostrophe_as_quote else text


def quote_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))


def is_complete(c: Column) -> Column:
    """True when no quote is left open."""
    return quote_count(c) % 2 == 0


def quoted_split(c: Column, sep: str = ";") -> Column:
    """Fields of a line: separators inside quotes do not split, quotes go, a doubled quote inside is one quote.

    Linear in the line: cutting at quotes leaves outside pieces at even and inside
    pieces at odd positions; only outside pieces may carry active separators, and
    an empty outside piece between two inside ones is a doubled quote.
    """
    plain = F.split(c, re.escape(sep), -1)
    pieces = F.split(c, '"', -1)

    def piece(p: Column, i: Column) -> Column:
        inner = (i > 0) & (i < F.size(pieces) - 1)
        return (
            F.when(i % 2 == 1, p)
            .when((p == "") & inner, F.lit('"'))
            .otherwise(F.replace(p, F.lit(sep), F.lit(_MARK)))
        )

    return F.when(F.contains(c, F.lit('"')), F.split(F.array_join(F.transform(pieces, piece), ""), _MARK, -1)).otherwise(
        plain
    )


# Doubled quotes never change which separators are active: a run of k quotes acts
# like k mod 2 of them. Dropping the pairs first keeps the patterns below linear.


def _unpaired(c: Column) -> Column:
    return F.replace(c, F.lit('""'), F.lit(""))


def _without_quoted_fields(c: Column, sep: str) -> Column:
    return F.regexp_replace(_unpaired(c), f'(^|{re.escape(sep)})"[^"]*+"', "$1")


def field_count(c: Column, sep: str) -> Column:
    """Number of fields in a complete CSV record."""
    bare = F.when(F.contains(c, F.lit('"')), _without_quoted_fields(c, sep)).otherwise(c)
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
