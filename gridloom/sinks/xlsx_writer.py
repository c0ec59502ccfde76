"""Writes the rows of one task as an .xlsx file: values only, streamed, rolling over full sheets."""

from __future__ import annotations

import math
import re
import zipfile
from collections.abc import Sequence
from typing import BinaryIO
from xml.sax.saxutils import escape, quoteattr

# Parts of a minimal workbook, and limits of the format.
MAX_ROWS = 1_048_576
MAX_CELL = 32_767
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NS = "http://schemas.openxmlformats.org"
_SHEET_NAME = re.compile(r"[^\[\]:*?/\\]{1,31}")
_SPECIAL = re.compile("[\x00-\x08\x0b\x0c\x0d\x0e-\x1f\ufffe\uffff&<>]|_x")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0d\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def cell_text(value: str) -> str:
    """Text for a sheet's XML: control characters (and texts that look like their escapes) become ``_xHHHH_``."""
    if not _SPECIAL.search(value):
        return value
    return escape(_CONTROL.sub(lambda m: f"_x{ord(m.group()):04X}_", value))


def check_sheet_name(name: str) -> str:
    if not _SHEET_NAME.fullmatch(name):
        raise ValueError(f"not a sheet name (31 characters at most, none of []:*?/\\): {name!r}")
    return name


def _cell(v: object) -> str:
    kind = type(v)
    if kind is str:
        if len(v) > MAX_CELL:
            raise ValueError(f"a cell holds at most {MAX_CELL} characters, this one has {len(v)}: {v[:40]!r}...")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{cell_text(v)}</t></is></c>'
    if v is None:
        return "<c/>"
    if kind is int or kind is float:
        return f"<c><v>{v!r}</v></c>" if kind is int or math.isfinite(v) else "<c/>"
    if kind is bool:
        return f'<c t="b"><v>{int(v)}</v></c>'
    return _cell(str(v))


class WorkbookWriter:
    """``write_rows`` may be called any number of times per sheet; ``close`` finishes the file."""

    def __init__(self, stream: BinaryIO, max_rows: int = MAX_ROWS):
        self._zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
        self._max_rows = max_rows
        self._sheets: list[str] = []
        self._part = None
        self._row = 0

    def start_sheet(self, base: str, header: Sequence[str]) -> None:
        self._end_sheet()
        self._base, self._header = base, header
        n = sum(1 for s in self._sheets if s == base or s.startswith(f"{base} (")) + 1
        self._sheets.append(check_sheet_name(base if n == 1 else f"{base} ({n})"))
        self._part = self._zip.open(f"xl/worksheets/sheet{len(self._sheets)}.xml", "w", force_zip64=True)
        self._part.write(f'{_HEAD}<worksheet xmlns="{_NS}/spreadsheetml/2006/main"><sheetData>'.encode())
        self._row = 0
        if header:
            self._emit([header])

    def write_rows(self, rows: Sequence[Sequence[object]]) -> None:
        """Numbers as numbers, booleans as booleans, None as an empty cell, all else as text."""
        at = 0
        while at < len(rows):
            room = self._max_rows - self._row
            if room == 0:
                self.start_sheet(self._base, self._header)
                continue
            self._emit(rows[at : at + room])
            at += room

    def _emit(self, rows: Sequence[Sequence[object]]) -> None:
        # Column by column: a column's cells are mostly of one kind. Cells follow one
        # another without addresses, so an empty one needs its element too.
        columns = [[_cell(v) for v in column] for column in zip(*rows)]
        first = self._row + 1
        lines = [f'<row r="{first + i}">{"".join(cells)}</row>' for i, cells in enumerate(zip(*columns))]
        self._row += len(rows)
        self._part.write("".join(lines).encode())

    def _end_sheet(self) -> None:
        if self._part is not None:
            self._part.write(b"</sheetData></worksheet>")
            self._part.close()
            self._part = None

    def close(self) -> None:
        self._end_sheet()
        numbered = list(enumerate(self._sheets, 1))
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(
            f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i, _ in numbered
        )
        self._zip.writestr(
            "[Content_Types].xml",
            f'{_HEAD}<Types xmlns="{_NS}/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>',
        )
        rel = f"{_NS}/officeDocument/2006/relationships"
        self._zip.writestr(
            "_rels/.rels",
            f'{_HEAD}<Relationships xmlns="{_NS}/package/2006/relationships">'
            f'<Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        )
        links = "".join(
            f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in numbered
        )
        self._zip.writestr(
            "xl/_rels/workbook.xml.rels",
            f'{_HEAD}<Relationships xmlns="{_NS}/package/2006/relationships">{links}</Relationships>',
        )
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in numbered)
        self._zip.writestr(
            "xl/workbook.xml",
            f'{_HEAD}<workbook xmlns="{_NS}/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>',
        )
        self._zip.close()
