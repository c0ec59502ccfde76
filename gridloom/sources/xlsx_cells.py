"""Cells of a sheet of an .xlsx file, or of a part of it, streamed as text rows. Runs inside tasks.

A sheet's XML can be unpacked from its start only, but unpacking is many times faster
than parsing: a task that reads a part of a sheet unpacks what lies before it and
parses its own rows.
"""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from posixpath import join, normpath
from typing import BinaryIO
from xml.etree import ElementTree as ET

from gridloom.functions.names import letters_to_index

# Namespaces and built-in date formats of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DOC_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}

_CHUNK = 1 << 20
_INLINE, _VALUE, _TEXT = f"{MAIN}is", f"{MAIN}v", f"{MAIN}t"
_PLAIN_ITEM = re.compile(rb"<si><t>([^<>&_\r]*)</t></si>\s*")
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_NOT_DATE = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.I)


def unescape(text: str) -> str:
    """``_x000D_`` and the like back to characters."""
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), text) if "_x" in text else text


def _number_text(raw: str) -> str:
    if len(raw) <= 15 and raw.isascii() and raw.isdigit():
        return raw if raw[0] != "0" else str(int(raw))
    value = float(raw)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _date_text(raw: str, epoch_1904: bool) -> str:
    serial = float(raw)
    micros = round(serial * 86_400_000) * 1000
    if 0 <= serial < 1:
        return str((dt.datetime.min + dt.timedelta(microseconds=micros)).time())
    if not epoch_1904 and serial < 60:
        # Day 60 of the 1900 system is a leap day that never was.
        micros += 86_400_000_000
    start = dt.datetime(1904, 1, 1) if epoch_1904 else dt.datetime(1899, 12, 30)
    return str(start + dt.timedelta(microseconds=micros))


class Workbook:
    """Sheet names and streamed rows of an open .xlsx file."""

    def __init__(self, stream: BinaryIO):
        self._zip = zipfile.ZipFile(stream)
        book = ET.fromstring(self._zip.read("xl/workbook.xml"))
        rels = ET.fromstring(self._zip.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): r.get("Target") for r in rels.iter(f"{RELS}Relationship")}
        self.sheets = {
            s.get("name"): self._part(targets[s.get(f"{DOC_REL}id")]) for s in book.iter(f"{MAIN}sheet")
            if "worksheet" in targets[s.get(f"{DOC_REL}id")]
        }
        props = book.find(f"{MAIN}workbookPr")
        self._epoch_1904 = props is not None and props.get("date1904") in ("1", "true")
        self._shared: tuple | None = None
        self._date_styles: set[int] | None = None
        self._columns: dict[str, int] = {}

    @staticmethod
    def _part(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else normpath(join("xl", target))

    def size(self, sheet: str) -> int:
        """Bytes of a sheet's XML, unpacked."""
        return self._zip.getinfo(self.sheets[sheet]).file_size

    def _shared_text(self, number: int) -> str:
        """A shared string. The part is kept as bytes with the places of its items; an item is parsed when it is asked for."""
        if self._shared is None:
            data = self._zip.read("xl/sharedStrings.xml")
            root = re.search(rb"<((?:\w+:)?)sst\b[^>]*>", data)
            prefix = root.group(1)
            starts = [m.start() for m in re.finditer(rb"<" + prefix + rb"si[\s/>]", data)]
            ends = [*starts[1:], data.rfind(b"</" + prefix + b"sst>")]
            self._shared = data, root.group(), b"</" + prefix + b"sst>", starts, ends, {}
        data, root, closing, starts, ends, known = self._shared
        text = known.get(number)
        if text is None:
            item = data[starts[number]:ends[number]]
            plain = _PLAIN_ITEM.fullmatch(item)
            # Entities and rich text are left to the parser.
            text = known[number] = plain.group(1).decode() if plain else _inline_text(ET.fromstring(root + item + closing)[0])
        return text

    def _is_date(self, style: int) -> bool:
        if self._date_styles is None:
            self._date_styles = set()
            if "xl/styles.xml" in self._zip.namelist():
                styles = ET.fromstring(self._zip.read("xl/styles.xml"))
                custom = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{MAIN}numFmt")}
                cells = styles.find(f"{MAIN}cellXfs")
                for i, xf in enumerate(cells if cells is not None else ()):
                    number = int(xf.get("numFmtId", 0))
                    code = _NOT_DATE.sub("", custom.get(number, "").split(";")[0])
                    if re.search("[dmyhs]", code, re.I) if number in custom else number in DATE_FORMATS:
                        self._date_styles.add(i)
        return style in self._date_styles

    def _text(self, cell: ET.Element) -> str | None:
        if not len(cell):
            return None
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            inline = cell.find(_INLINE)
            return None if inline is None else _inline_text(inline)
        value = cell.findtext(_VALUE)
        if value is None or kind == "e":
            return None
        if kind == "n":
            style = cell.get("s")
            if style is not None and self._is_date(int(style)):
                return _date_text(value, self._epoch_1904)
            return _number_text(value)
        if kind == "s":
            return self._shared_text(int(value))
        if kind == "str":
            return unescape(value)
        if kind == "b":
            return "True" if value == "1" else "False"
        return value.replace("T", " ") if kind == "d" else value

    def rows(self, sheet: str, low: int = 0, high: int | None = None) -> Iterator[tuple[int, list[str | None]]]:
        """``(row number from 1, cells)``; gaps are empty rows, blank rows at the end are left out.

        With ``low`` and ``high`` only rows that start at such bytes of the sheet's XML,
        and the gaps behind them up to the next row. All parts together are the sheet.
        """
        part = _SheetPart(self._zip, self.sheets[sheet], low, high)
        number = emitted = None if low else 0
        for row in part.rows():
            place = row.get("r")
            if place is None and number is None:
                number = part.rows_before()
            number = int(place) if place is not None else number + 1
            if emitted is None:
                emitted = number - 1
            cells = self._cells(row)
            if cells.count(None) < len(cells):
                for gap in range(emitted + 1, number):
                    yield gap, []
                yield number, cells
                emitted = number
        if number is None or part.rest is None:
            return
        # Rows left blank here are gaps if anything follows.
        upto = None
        for row in part.later_rows():
            number = int(row.get("r", number + 1))
            upto = number if upto is None else upto
            cells = self._cells(row)
            if cells.count(None) < len(cells):
                for gap in range(emitted + 1, upto):
                    yield gap, []
                return

    def _cells(self, row: ET.Element) -> list[str | None]:
        cells: list[str | None] = []
        for cell in row:
            place = cell.get("r")
            if place is not None:
                at = self._index(place.rstrip("0123456789"))
                while len(cells) < at:
                    cells.append(None)
            if not len(cell):
                cells.append(None)
            elif cell.get("t") == "inlineStr" and len(cell[0]) == 1 and cell[0][0].tag == _TEXT:
                text = cell[0][0].text or ""
                cells.append(unescape(text) if "_x" in text else text)
            else:
                cells.append(self._text(cell))
        return cells

    def _index(self, letters: str) -> int:
        at = self._columns.get(letters)
        if at is None:
            at = self._columns[letters] = letters_to_index(letters)
        return at


class _SheetPart:
    """Row elements of a sheet's XML that start at bytes ``low`` to ``high``, parsed a chunk of whole rows at a time."""

    def __init__(self, archive: zipfile.ZipFile, name: str, low: int, high: int | None):
        self._zip, self._name, self._low, self._high = archive, name, low, high
        #: What was read of the rows behind ``high``; None where the sheet's data ended before.
        self.rest: bytes | None = None

    def rows(self) -> Iterator[ET.Element]:
        self._part = self._zip.open(self._name)
        buffer, opening = b"", None
        while opening is None:
            more = self._part.read(_CHUNK)
            if not more:
                return
            buffer += more
            opening = re.search(rb"<(\w+:)?sheetData\s*>", buffer)
        prefix = opening.group(1) or b""
        root = re.search(rb"<(?:\w+:)?worksheet[^>]*>", buffer).group()
        self._around = root + opening.group(), b"</" + prefix + b"sheetData></" + prefix + b"worksheet>"
        self._row_end, data_end = b"</" + prefix + b"row>", b"</" + prefix + b"sheetData>"
        self._row_start, self._row_tag = re.compile(b"<" + prefix + rb"row[\s/>]"), re.compile(b"<" + prefix + rb"row(?:[\s/][^>]*)?>")
        self._data_start = base = opening.end()
        buffer = buffer[base:]
        if self._low > base:
            # Unpacks what lies before; nothing of it is kept.
            self._part.seek(self._low)
            base, buffer = self._low, self._part.read(_CHUNK)
            while True:
                first, end = self._row_start.search(buffer), buffer.find(data_end)
                if end >= 0 and (first is None or first.start() > end):
                    return
                if first:
                    break
                more = self._part.read(_CHUNK)
                if not more:
                    return
                base, buffer = base + max(0, len(buffer) - 32), buffer[-32:] + more
            base, buffer = base + first.start(), buffer[first.start():]
        self.first_row = base
        while True:
            end = buffer.find(data_end)
            beyond = self._high is not None and self._row_start.search(buffer, max(0, self._high - base), end if end >= 0 else len(buffer))
            if beyond:
                yield from self._parsed(buffer[:beyond.start()])
                self.rest = buffer[beyond.start():]
                return
            cut = end if end >= 0 else buffer.rfind(self._row_end) + len(self._row_end)
            if end >= 0 or cut >= len(self._row_end):
                yield from self._parsed(buffer[:cut])
                base, buffer = base + cut, buffer[cut:]
            if end >= 0:
                return
            more = self._part.read(_CHUNK)
            if not more:
                return
            buffer += more

    def _parsed(self, rows: bytes) -> list[ET.Element]:
        return list(ET.fromstring(self._around[0] + rows + self._around[1])[0]) if rows else []

    def later_rows(self) -> Iterator[ET.Element]:
        """The rows behind ``high``, one by one."""
        buffer, data_end = self.rest, self._around[1][: self._around[1].index(b">") + 1]
        while True:
            following = self._row_start.search(buffer, 1)
            end = buffer.find(data_end)
            if following and (end < 0 or following.start() < end):
                yield from self._parsed(buffer[:following.start()])
                buffer = buffer[following.start():]
            elif end >= 0:
                yield from self._parsed(buffer[:end])
                return
            else:
                more = self._part.read(_CHUNK)
                if not more:
                    return
                buffer += more

    def rows_before(self) -> int:
        """The number of the row before the first one here, where rows do not tell their numbers."""
        number, buffer, base = 0, b"", 0
        with self._zip.open(self._name) as part:
            while base < self.first_row:
                more = part.read(min(_CHUNK, self.first_row - base))
                base += len(more)
                buffer += more
                done = 0
                for row in self._row_tag.finditer(buffer):
                    told = re.search(rb'\sr="(\d+)"', row.group())
                    number = int(told.group(1)) if told else number + 1
                    done = row.end()
                buffer = buffer[max(done, len(buffer) - 4_096):]
        return number


def _inline_text(item: ET.Element) -> str:
    """Text of a string item: plain or rich runs, without phonetic hints."""
    if len(item) and item[0].tag == _TEXT:
        return unescape(item[0].text or "")
    return unescape("".join(t.text or "" for run in item.iter(f"{MAIN}r") for t in run.iter(f"{MAIN}t")))
