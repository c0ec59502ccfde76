"""Encoding, separator and header of text files, read from the head of each file in tasks."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.quoting import QUOTES
from gridloom.sources.files import InputFile, open_input

# Encodings tried in this order, separators considered, characters looked at.
ENCODINGS = ["utf-8", "utf-8-sig", "cp1251", "windows-1251", "latin-1", "cp1252"]
SEPARATORS = [",", ";", "\t", "|", ":"]
HEAD_CHARS = 8192

_SCHEMA = (
    "src int, encoding string, sep string, bom boolean, header array<string>, first_line string, dirty_header array<string>, newline string"
)


def decode_head(head: bytes, whole: bool, encoding: str | None = None) -> tuple[str, str]:
    """``(encoding, text)`` by the first encoding that reads the head without error."""
    for name in [encoding] if encoding else ENCODINGS:
        try:
            return name, codecs.getincrementaldecoder(name)("strict").decode(head, final=whole)
        except UnicodeDecodeError:
            continue
    return encoding or "utf-8", head.decode(encoding or "utf-8", errors="replace")


def guess_separator(text: str) -> str:
    """The standard library's guess among the known separators, else the most frequent of them."""
    sample = io.IncrementalNewlineDecoder(None, translate=True).decode(text)[:HEAD_CHARS]
    try:
        return csv.Sniffer().sniff(sample, delimiters="".join(SEPARATORS)).delimiter
    except csv.Error:
        return max(SEPARATORS, key=sample.count)


def first_record(text: str, sep: str) -> tuple[list[str], str, int]:
    """``(fields, first physical line, characters used)`` of the first record that is not blank."""
    lines = text.splitlines(keepends=True) if "\n" in text or "\r" in text else [text]
    used = 0

    def feed() -> Iterator[str]:
        nonlocal used
        for line in lines:
            used += len(line)
            yield line

    start = next((line for line in lines if line.strip("﻿ \r\n\t") or sep in line), "")
    for row in csv.reader(feed(), delimiter=sep):
        if row and row[0].startswith("﻿"):
            row[0] = row[0].lstrip("﻿")
        if len(row) > 1 or (row and row[0].strip()):
            return [c.replace("\r\n", "\n") for c in row], start.rstrip("\r\n"), used
    return [], "", used


def first_dirty_record(text: str, sep: str, apostrophe_as_quote: bool) -> list[str]:
    """Fields of the first record where any quote toggles, after quote repair."""
    table = {ord(k): v for k, v in QUOTES.items() if apostrophe_as_quote or v == '"'}
    text = text.lstrip("﻿").translate(table).replace('\\"', '""')
    if apostrophe_as_quote:
        text = text.replace("'", '"')
    record, quotes = "", 0
    for line in text.splitlines(keepends=True):
        record += line
        quotes += line.count('"')
        if quotes % 2 == 0:
            break
    record = record.rstrip("\r\n")
    pieces = record.split('"')
    joined = "".join(
        p if i % 2 else ('"' if p == "" and 0 < i < len(pieces) - 1 else p.replace(sep, "￿")) for i, p in enumerate(pieces)
    )
    return joined.split("￿")


class Head(NamedTuple):
    """What the head of a file tells; fields as in :func:`sniff`."""

    encoding: str
    sep: str
    bom: bool
    header: list[str]
    first_line: str
    dirty_header: list[str] | None
    newline: str


def read_head(path: str, encoding: str | None, sep: str | None, dirty: bool = False, apostrophe: bool = False) -> Head:
    size = 64 * 1024
    with open_input(path) as f:
        head = f.read(size)
        while True:
            whole = len(head) < size
            name, text = decode_head(head, whole, encoding)
            delimiter = sep or guess_separator(text)
            fields, first, used = first_record(text, delimiter)
            if whole or used < len(text):
                break
            size *= 4
            head += f.read(size - len(head))
    bom = text.startswith("\ufeff") or head.startswith(codecs.BOM_UTF8)
    # What ends the header record ends the others; CR LF counts as LF.
    newline = "\r" if text[:used].endswith("\r") else "\n"
    if not dirty:
        return Head(name, delimiter, bom, fields, first, None, newline)
    # Here a blank first line is a record too.
    first = text.splitlines()[0] if text else ""
    return Head(name, delimiter, bom, fields, first, first_dirty_record(text, delimiter, apostrophe), newline)


def sniff(
    spark: SparkSession, files: Sequence[InputFile], encoding: str | None = None, sep: str | None = None,
    dirty: bool = False, apostrophe_as_quote: bool = False,
) -> DataFrame:
    """``(src, encoding, sep, bom, header, first_line, dirty_header, newline)`` per file; only heads are read."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (s, *read_head(p, encoding, sep, dirty, apostrophe_as_quote)) for s, p in zip(batch["src"], batch["path"])
            ]
            yield pd.DataFrame(found, columns=["src", *Head._fields])

    listed = spark.createDataFrame([(f.src, f.path) for f in files], "src int, path string")
    slots = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    return listed.repartition(slots, F.col("path")).mapInPandas(heads, _SCHEMA)


def layouts(sniffed: DataFrame) -> list:
    """Distinct findings with the files they hold for: ``(encoding, sep, header, first_line, dirty_header, newline, srcs)``.

    Grouped before it reaches the driver, which so gets a header once and not per file.
    """
    facts = ["encoding", "sep", "header", "first_line", "dirty_header", "newline"]
    return sniffed.groupBy(*facts).agg(F.sort_array(F.collect_list("src")).alias("srcs")).collect()
