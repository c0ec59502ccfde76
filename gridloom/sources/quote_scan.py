"""Quoted fields and record borders in the raw bytes of one stretch of a text file.

A stretch begins at the start of a line and ends at the end of one. Whether its
first line lies inside a quoted field is not known when it is looked at alone, so
it is read under both assumptions. They differ only up to the first line on which
the two agree, mostly a line or two.

A quote that is never closed would take in the rest of its file. Where a field
stays open for longer than ``look`` bytes, the lines that follow are read as
records of their own: if nine of ten have the header's number of fields, the quote
was lost and counts as a plain character. So does one that stays open for more than
``longest`` bytes, whatever follows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import BinaryIO

import numpy as np

UTF8 = ("utf-8", "utf-8-sig", "utf8")
_BOM = b"\xef\xbb\xbf"
_MORE = 1 << 16


@dataclass(frozen=True)
class QuoteRule:
    """``anywhere``: any quote opens or closes a field; else a quote opens one only where a field starts."""

    sep: bytes
    newline: bytes = b"\n"
    fields: int = 0
    anywhere: bool = False
    look: int = 1 << 20
    longest: int = 1 << 26


Ahead = Callable[[int], bytes]


@lru_cache
def _patterns(sep: bytes, newline: bytes) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    at_start = b"[" + re.escape(sep) + newline + b"]"
    #: All up to a field that holds a line end or is not closed; possessive, so each byte is looked at once.
    plain = re.compile(b'(?:[^"]++|(?<!' + at_start + b')"|"(?:[^"' + newline + b']++|"")*+")*+')
    closing = re.compile(b'(?:[^"]++|"")*+"')
    quoted = re.compile(b"(?<=" + at_start + b')"(?:[^"]++|"")*+"?')
    return plain, closing, quoted


@dataclass
class Spans:
    """Quoted fields that hold a line end, as ``(quote, behind the closing quote)``; lost quotes; the state at the end."""

    found: list[tuple[int, int]]
    lost: list[int]
    inside: bool


def quoted_spans(data: bytes, inside: bool, rule: QuoteRule, ahead: Ahead, at: int = 1) -> Spans:
    """``data`` starts with the line end before its first line; ``ahead`` gives bytes that follow it in the file."""
    scan = _spans_anywhere if rule.anywhere else _spans_at_field_start
    return scan(data, inside, rule, ahead, at)


def _spans_at_field_start(data: bytes, inside: bool, rule: QuoteRule, ahead: Ahead, at: int) -> Spans:
    plain, closing, _ = _patterns(rule.sep, rule.newline)
    out = Spans([], [], False)
    if inside:
        closed = closing.match(data, at)
        out.found.append((at, closed.end() if closed else len(data)))
        if not closed:
            out.inside = True
            return out
        at = closed.end()
    while True:
        at = plain.match(data, at).end()
        if at == len(data):
            return out
        closed = closing.match(data, at + 1)
        end = closed.end() if closed else None
        if _is_lost(data, at, end, rule, ahead):
            out.lost.append(at)
            at += 1
            continue
        out.found.append((at, end or len(data)))
        if end is None:
            out.inside = True
            return out
        at = end


def _spans_anywhere(data: bytes, inside: bool, rule: QuoteRule, ahead: Ahead, at: int) -> Spans:
    array = np.frombuffer(data, dtype=np.uint8)
    quotes, ends = np.flatnonzero(array == 34), np.flatnonzero(array == rule.newline[0])
    quotes, out = quotes[quotes >= at], Spans([], [], False)
    if inside:
        out.found.append((at, int(quotes[0]) + 1 if len(quotes) else len(data)))
        if not len(quotes):
            out.inside = True
            return out
        quotes = quotes[1:]
    sure = 0
    while True:
        opens, closes = quotes[::2], quotes[1::2]
        odd = len(opens) > len(closes)
        doubtful = [*np.flatnonzero(closes[sure:] - opens[sure:len(closes)] > rule.look) + sure, *([len(closes)] if odd else [])]
        lost = next((i for i in doubtful if _is_lost(data, int(opens[i]), int(closes[i]) + 1 if i < len(closes) else None, rule, ahead)), None)
        upto = len(opens) if lost is None else lost
        pairs = list(zip(opens[:upto].tolist(), [*(closes[:upto] + 1).tolist(), *([len(data)] if odd and lost is None else [])]))
        first, last = np.searchsorted(ends, opens[:upto]), np.searchsorted(ends, [b for _, b in pairs])
        out.found += [pair for pair, a, b in zip(pairs, first, last) if b > a]
        if lost is None:
            out.inside = odd
            return out
        out.lost.append(int(opens[lost]))
        quotes, sure = quotes[2 * lost + 1:], 0


def _is_lost(data: bytes, at: int, end: int | None, rule: QuoteRule, ahead: Ahead) -> bool:
    """Is the quote ``at`` no opening one? Depends on the bytes that follow it only, so every pass comes to the same answer."""
    if end is not None and end - at <= rule.look:
        return False
    text = data[at:at + rule.look] if end is not None else data[at:]
    if end is None:
        text += ahead(max(0, rule.look - len(text)))
        close = _closing(text, rule)
        if close is not None and close <= rule.look:
            return False
        if len(text) < rule.look:
            # Nothing closes it up to the end of the file, which is near: the rest is its cell.
            return False
    lines = [line.removesuffix(b"\r") for line in text[: rule.look].split(rule.newline)[1:-1]]
    if rule.fields > 1 and len(lines) >= 8 and sum(map(rule_fits(rule), lines)) >= 0.9 * len(lines):
        return True
    if end is None:
        text = data[at:] + ahead(rule.longest)
        return (_closing(text, rule) or len(text)) > rule.longest
    return end - at > rule.longest


def _closing(text: bytes, rule: QuoteRule) -> int | None:
    if rule.anywhere:
        return text.find(b'"', 1) + 1 or None
    closed = _patterns(rule.sep, rule.newline)[1].match(text, 1)
    # A quote at the very end may be the first half of a doubled one; the bytes behind it tell.
    return closed.end() if closed else None


def rule_fits(rule: QuoteRule) -> Callable[[bytes], bool]:
    """Has a line the header's number of fields, and no quote left open?"""
    def fits(line: bytes) -> bool:
        return line.count(b'"') % 2 == 0 and re.sub(b'"[^"]*"', b"", line).count(rule.sep) + 1 == rule.fields

    return fits


# --- stretches of a file ----------------------------------------------------------


def read_stretch(file: BinaryIO, start: int, stop: int, newline: bytes, repair: Callable[[bytes], bytes] | None = None) -> tuple[bytes, Ahead]:
    """The lines that start at ``start`` to ``stop``, behind the line end before them; empty if there are none."""
    begin = max(start - 1, 0)
    file.seek(begin)
    data = file.read(stop - begin)
    if start:
        first = data.find(newline)
        if first < 0 or begin + first + 1 >= stop:
            return b"", lambda size: b""
        data = data[first:]
    else:
        data = newline + data.removeprefix(_BOM)
    pieces, position, size = [data], file.tell(), _MORE
    while not pieces[-1].endswith(newline):
        piece = file.read(size)
        if not piece:
            break
        piece = piece[: piece.find(newline) + 1 or len(piece)]
        pieces.append(piece)
        position += len(piece)
        size *= 2
    data = b"".join(pieces)

    def ahead(count: int) -> bytes:
        file.seek(position)
        found = file.read(count) if count else b""
        return repair(found) if repair else found

    return repair(data) if repair else data, ahead


@dataclass
class Summary:
    """What a stretch does to the quote state, and what its bytes are like; ``in`` is for a stretch that starts inside quotes."""

    lines: bool
    plain: bool
    ends_out: bool
    ends_in: bool
    other_out: int
    other_in: int
    invalid: int
    crlf: int
    lf: int
    cr: int
    nul: int


def sum_up(data: bytes, ahead: Ahead, rule: QuoteRule, encoding: str) -> Summary:
    if not data:
        return Summary(False, True, False, True, 0, 0, 0, 0, 0, 0, 0)
    # The line end in front belongs to the stretch before.
    cr, lf, crlf = data.count(b"\r", 1), data.count(b"\n", 1), data.count(b"\r\n", 1)
    others = cr - crlf if rule.newline == b"\n" else lf
    facts = _invalid_lines(data, rule.newline) if encoding.lower() in UTF8 else 0, crlf, lf, cr, data.count(b"\0")
    if b'"' not in data:
        return Summary(True, True, False, True, others, 0, *facts)
    out = quoted_spans(data, False, rule, ahead)
    other_out, other_in = (_others_outside(data, rule, start) for start in (False, True)) if others else (0, 0)
    return Summary(True, not out.found and not out.lost, out.inside, _ends_inside(data, rule, ahead, out), other_out, other_in, *facts)


def _invalid_lines(data: bytes, newline: bytes) -> int:
    try:
        data.decode("utf-8")
        return 0
    except UnicodeDecodeError:
        pass
    bad = 0
    for line in data.split(newline):
        try:
            line.decode("utf-8")
        except UnicodeDecodeError:
            bad += 1
    return bad


def _ends_inside(data: bytes, rule: QuoteRule, ahead: Ahead, out: Spans) -> bool:
    """The state at the end of a stretch that starts inside quotes, given how it reads from outside.

    From the first line end on which both readings are outside, they are the same.
    """
    first = _closing(data, rule)
    if first is None:
        return True
    if not rule.anywhere:
        plain = _patterns(rule.sep, rule.newline)[0]
        starts, at = [a for a, _ in out.found], first
        for _ in range(16):
            end = data.find(rule.newline, at)
            if end < 0:
                break
            if plain.match(data, first, end + 1).end() != end + 1:
                break
            held = int(np.searchsorted(starts, end, side="right")) - 1
            if held < 0 or out.found[held][1] <= end:
                return out.inside
            at = end + 1
    return quoted_spans(data, False, rule, ahead, first).inside


def _others_outside(data: bytes, rule: QuoteRule, inside: bool) -> int:
    """Line ends of another kind outside quotes."""
    at = (_closing(data, rule) or len(data)) if inside else 1
    quoted = re.compile(b'"[^"]*"?') if rule.anywhere else _patterns(rule.sep, rule.newline)[2]
    bare = quoted.sub(b"", data[at - 1:])[1:]
    return bare.count(b"\n") if rule.newline == b"\r" else bare.count(b"\r") - bare.count(b"\r\n")


def _record_ends(data: bytes, spans: Spans, rule: QuoteRule) -> np.ndarray:
    """Places of the line ends that are not quoted; the one in front is among them."""
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == rule.newline[0])
    if spans.found:
        opens, closes = np.array(spans.found).T
        held = np.searchsorted(opens, ends, side="right") - 1
        ends = ends[(held < 0) | (ends >= closes[np.maximum(held, 0)])]
    return ends


def records_of(data: bytes, inside: bool, ahead: Ahead, rule: QuoteRule) -> Iterator[tuple[np.ndarray, bytes, bool]]:
    """``(offsets, bytes, damaged)``: records that start in a stretch, one after another without their line ends.

    Damaged ones, in which a quote was lost, come alone; so does the last one where it
    goes on behind the stretch, which is read on until it ends.
    """
    spans = quoted_spans(data, inside, rule, ahead)
    ends = _record_ends(data, spans, rule)
    if inside:
        # Up to the first end the lines belong to a record that started before.
        ends = ends[1:]
    if not len(ends):
        return
    lows, highs, tail = ends[:-1] + 1, ends[1:], int(ends[-1]) + 1
    array = np.frombuffer(data, dtype=np.uint8)
    if rule.newline == b"\n":
        highs = highs - ((array[highs - 1] == 13) & (highs > lows))
    done = 0
    for i in sorted({int(np.searchsorted(ends[1:], at)) for at in spans.lost if at > ends[0]}):
        if i < len(lows):
            yield from _joined(array, lows[done:i], highs[done:i])
            lost = [at - int(lows[i]) for at in spans.lost if lows[i] <= at < highs[i]]
            yield _alone(_requoted(data[lows[i]:highs[i]], lost, rule), True)
            done = i + 1
    yield from _joined(array, lows[done:], highs[done:])
    if tail < len(data):
        yield _finish(data[tail - 1:], ahead, rule)


def _joined(array: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> Iterator[tuple[np.ndarray, bytes, bool]]:
    if len(lows):
        first = int(lows[0])
        keep = np.ones(int(highs[-1]) - first, dtype=bool)
        # One or two bytes lie between two records.
        keep[highs[:-1] - first] = False
        keep[lows[1:] - 1 - first] = False
        yield np.concatenate([[0], np.cumsum(highs - lows)]), array[first:highs[-1]][keep].tobytes(), False


def _alone(record: bytes, damaged: bool) -> tuple[np.ndarray, bytes, bool]:
    return np.array([0, len(record)]), record, damaged


def _finish(data: bytes, ahead: Ahead, rule: QuoteRule) -> tuple[np.ndarray, bytes, bool]:
    """The last record of a stretch, which no line end of the stretch ends."""
    size = _MORE
    while True:
        more = ahead(size)
        text = data + more
        spans = quoted_spans(text, False, rule, lambda count: ahead(len(more) + count)[len(more):])
        ends = _record_ends(text, spans, rule)[1:]
        if len(ends) or len(more) < size:
            # At the end of the file the last line end is no part of a cell, closed or not.
            record = text[1:ends[0]] if len(ends) else text[1:].removesuffix(rule.newline)
            record = record.removesuffix(b"\r") if rule.newline == b"\n" else record
            lost = [at - 1 for at in spans.lost if at - 1 < len(record)]
            return _alone(_requoted(record, lost, rule), bool(lost))
        size *= 2


def _requoted(record: bytes, lost: list[int], rule: QuoteRule) -> bytes:
    """The record with its lost quotes written so that they are read as what they are: plain characters."""
    for at in reversed(lost):
        start = max(record.rfind(rule.sep, 0, at), record.rfind(rule.newline, 0, at)) + 1
        end = min((e for e in (record.find(rule.sep, at), record.find(rule.newline, at)) if e >= 0), default=len(record))
        record = record[:start] + b'"' + record[start:end].replace(b'"', b'""') + b'"' + record[end:]
    return record
