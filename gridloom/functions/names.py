"""Header names: normal forms, spreadsheet letters, free output names. Driver-side, on names only."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic letters read as the Latin letters they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ї": "I", "Й": "I", "Ґ": "G",
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "к": "k", "м": "m", "о": "o",
    "р": "p", "т": "t", "х": "x", "у": "y", "і": "i", "ї": "i", "й": "i", "ґ": "g",
}
# The letters the sheet-summary report folds, in its order (a subset of the above).
SUMMARY_LETTERS = "авсеноркхтім"
# Fixed value: what a free name, or a sheet that goes on where one is full, has behind its name.
NUMBERED = r"(?: \((?:[2-9]|[1-9][0-9]+)\))+"

#: What each header form keeps; white space, dashes and underscores part words, anything else goes.
_KEPT = {"safe": str.isalnum, "compat": frozenset("0123456789abcdefghijklmnopqrstuvwxyz").__contains__}
_FOLDED = {"all": LOOKALIKES, "summary": {c: LOOKALIKES[c] for c in SUMMARY_LETTERS}}


def _characters(name: object, letters: str) -> Iterator[tuple[str, bool]]:
    """Lower-case characters with look-alikes folded, each with whether it is a gap."""
    folded = _FOLDED[letters]
    for c in "" if name is None else str(name).lower():
        yield folded.get(c, c), c == "-" or c.isspace()


def norm_name(name: object, letters: str = "all") -> str:
    """Loose form for look-up: no case, no blanks or dashes, look-alikes folded."""
    return "".join(c for c, gap in _characters(name, letters) if not gap)


def norm_header(name: object, norm: str = "safe") -> str:
    """Matching form of a header when sources are united.

    ``safe`` keeps every letter and digit, so different Cyrillic headers stay
    different; ``compat`` keeps ASCII only, as the original tools did.
    """
    kept, out, parted = _KEPT[norm], [], False
    for c, gap in _characters(name, "all"):
        if gap or c == "_":
            parted = True
        elif kept(c):
            out.append(f"_{c}" if parted and out else c)
            parted = False
    return "".join(out)


def canonical_headers(cells: Sequence[object]) -> list[str]:
    """Header cells as text, blank where the cell is empty."""
    return ["" if c is None else str(c) for c in cells]


def unique_headers(cells: Sequence[object]) -> list[str]:
    """Usable column names: blanks become ``Unnamed: i`` placeholders, repeats get ``.1``, ``.2`` …"""
    names = [str(c) if c not in (None, "") else f"Unnamed: {i}" for i, c in enumerate(cells)]
    taken: set[str] = set()
    seen: dict[str, int] = {}
    out = []
    for name in names:
        candidate = name
        n = seen.get(name, 0)
        while candidate in taken:
            n += 1
            candidate = f"{name}.{n}"
        seen[name] = n
        taken.add(candidate)
        out.append(candidate)
    return out


def letters_to_index(letters: str) -> int:
    """``A`` → 0, ``Z`` → 25, ``AA`` → 26 … up to three letters."""
    text = letters.strip().upper()
    if not re.fullmatch(r"[A-Z]{1,3}", text):
        raise ValueError(f"not a column letter: {letters!r}")
    value = 0
    for ch in text:
        value = value * 26 + ord(ch) - 64
    return value - 1


def index_to_letters(index: int) -> str:
    """0 → ``A``, 26 → ``AA`` …"""
    out, n = "", index + 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def free_name(existing: Collection[str], base: str) -> str:
    """``base``, or the first free one of ``base (2)``, ``base (3)`` …"""
    if base not in existing:
        return base
    n = 2
    while f"{base} ({n})" in existing:
        n += 1
    return f"{base} ({n})"


def col(name: str) -> Column:
    """A column by its literal name: dots, blanks and backticks are not special."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold_lookalikes(c: Column) -> Column:
    """Look-alike letters to Latin, on values."""
    folded = F.translate(c, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))
    # The per-character map is slow; texts without Cyrillic letters need none.
    return F.when(c.rlike("[\u0400-\u04ff]"), folded).otherwise(c)


def norm_header_column(c: Column, norm: str = "safe") -> Column:
    """:func:`norm_header` on a text column (headers that arrive as data)."""
    text = fold_lookalikes(F.lower(F.coalesce(c.cast("string"), F.lit(""))))
    kept = {"safe": r"\p{L}\p{N}", "compat": "a-z0-9"}[norm]
    # What is neither kept nor parts words goes; what is left between the parting characters are the words.
    lean = F.regexp_replace(text, rf"(?U)[^{kept}_\-\s\x1c-\x1f]", "")
    return F.array_join(F.regexp_extract_all(lean, F.lit(rf"(?U)[{kept}]+"), F.lit(0)), "_")
