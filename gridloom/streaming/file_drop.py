"""Files as they arrive, read by the rules of the batch reader, with bounded memory."""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions.names import unique_headers
from gridloom.functions.years import year_in
from gridloom.operators.predicates import Filter, apply_filters
from gridloom.sources.csv_files import FILE, NA_TOKENS, ORD, YEAR, null_tokens
from gridloom.sources.files import open_input
from gridloom.sources.quote_scan import QuoteRule, read_stretch, records_of, sum_up
from gridloom.sources.sniff import read_head

#: Bytes of a file that are held at once.
STRETCH = 8 << 20

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_csv(
    spark: SparkSession, folder: str, columns: Sequence[str], sep: str | None = None, encoding: str | None = None,
    files_per_batch: int = 100, na_tokens: Sequence[str] | None = NA_TOKENS, with_order: bool = False, with_file: bool = False,
    stretch: int = STRETCH,
) -> DataFrame:
    """New CSV files as an unbounded all-text table of ``columns``, with ``_year`` from the file name.

    A micro-batch is a set of files of ``folder`` and its subfolders: Spark's file source
    lists them and keeps count of them, their contents are read in tasks. Each file has its own encoding, separator
    and order of columns, sniffed from its head where they are not given; a column it
    does not have is NULL, further ones are left out. Records, ragged rows, quotes and
    errors are those of :func:`gridloom.sources.csv_files.read_csv`. A file is read by
    one task, ``stretch`` bytes at a time.

    ``with_file`` adds ``_file``, ``with_order`` ``_ord``, by which rows of one file are as in it.
    """
    wanted = list(columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                yield from _rows(path, size, wanted, encoding, sep, stretch)

    schema = "path string, block long, seq long, " + ", ".join(f"c{i} string" for i in range(len(wanted)))
    files = spark.readStream.format("binaryFile").schema(_FILES).options(maxFilesPerTrigger=files_per_batch, recursiveFileLookup="true").load(folder)
    rows = files.select("path", "length").mapInArrow(read, schema)
    cells = [null_tokens(F.col(f"c{i}"), na_tokens) for i in range(len(wanted))]
    more = {YEAR: year_in(F.element_at(F.split("path", "/"), -1))}
    if with_order:
        more[ORD] = F.struct("path", "block", "seq")
    if with_file:
        more[FILE] = F.col("path")
    return rows.select(*cells, *more.values()).toDF(*wanted, *more)


def _rows(path: str, size: int, columns: list[str], encoding: str | None, sep: str | None, stretch: int) -> Iterator[pa.RecordBatch]:
    """The rows of one file. Its stretches are read in order, so each knows the state it starts in."""
    csv.field_size_limit(sys.maxsize)
    head = read_head(path, encoding, sep)
    if not head.header:
        return
    names = unique_headers(head.header)
    places = [names.index(c) if c in names else None for c in columns]
    rule = QuoteRule(head.sep.encode(), head.newline.encode(), len(names))
    inside, header = False, True
    with open_input(path) as file:
        for start in range(0, max(size, 1), stretch):
            data, ahead = read_stretch(file, start, start + stretch, rule.newline)
            if not data:
                continue
            told = sum_up(data, ahead, rule, head.encoding)
            if told.invalid:
                raise ValueError(f"{path} is not {head.encoding}: {told.invalid} lines do not decode; name its encoding")
            if told.other_in if inside else told.other_out:
                raise ValueError(f"{path} mixes line ends")
            seq = 0
            for offsets, values, _ in records_of(data, inside, ahead, rule):
                texts = [values[a:b].decode(head.encoding, errors="replace") for a, b in zip(offsets, offsets[1:])]
                texts = [t for t in texts if t.strip() or head.sep in t]
                if header and texts:
                    header, texts = False, texts[1:]
                rows = [r for r in csv.reader(texts, delimiter=head.sep) if len(r) <= len(names)]
                found = [[r[p] if p is not None and p < len(r) else None for r in rows] for p in places]
                place = [pa.array([path] * len(rows), pa.string()), pa.array([start] * len(rows), pa.int64()), pa.array(range(seq, seq + len(rows)), pa.int64())]
                seq += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [*place, *(pa.array(c, pa.string()) for c in found)], ["path", "block", "seq", *(f"c{i}" for i in range(len(columns)))])
            inside = told.ends_in if inside else told.ends_out


def filter_stream(df: DataFrame, filters: Sequence[Filter | Mapping], dialect: str = "worker") -> DataFrame:
    """Stateless, so the batch filter serves as it is."""
    return apply_filters(df, filters, dialect)


def write_stream(
    df: DataFrame, folder: str, checkpoint: str, fmt: str = "parquet", partition_by: Sequence[str] = (YEAR,),
    available_now: bool = True,
) -> StreamingQuery:
    """Append kept rows by year; the checkpoint makes restarts exact. ``available_now`` stops when all files are done."""
    writer = df.writeStream.format(fmt).outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
