"""Records of delimited text files: one look at the bytes, then one scan.

The look takes stretches of all files in one job and sums each up to a row: what it
does to the quote state, started outside and inside quotes, and whether its bytes
are in the encoding and its line ends of one kind. Chained, the sums give the state
each stretch starts in. After that every stretch is read once, by itself: it knows
where its first record starts and reads its last one to the end, so no line is
moved to another task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.files import InputFile, bytes_setting, open_input
from gridloom.sources.quote_scan import UTF8, QuoteRule, read_stretch, records_of, sum_up

#: Bytes of a stretch at most; Spark's own setting for input splits may ask for less.
STRETCH = 32 << 20
#: Records handed on at once.
ROWS = 1 << 16

# One-byte charsets: decoded as Latin-1, then the upper half is mapped.
_ONE_BYTE = {"cp1251": "cp1251", "windows-1251": "cp1251", "cp1252": "cp1252", "latin-1": None, "iso-8859-1": None}
_FACTS = ("lines", "plain", "ends_out", "ends_in", "other_out", "other_in", "invalid", "crlf", "lf", "cr", "nul")


def decode_bytes(raw: Column, encoding: str) -> Column:
    """Bytes of a record to text."""
    return raw.cast("string") if encoding.lower() in UTF8 else remap_latin(F.decode(raw, "ISO-8859-1"), encoding)


def remap_latin(latin: Column, encoding: str) -> Column:
    """Text decoded as Latin-1 to the one-byte charset it is really in; other text is left alone."""
    name = encoding.lower()
    if name in UTF8:
        return latin
    if name not in _ONE_BYTE:
        raise ValueError(f"unsupported encoding {encoding!r}")
    if _ONE_BYTE[name] is None:
        return latin
    upper = [(chr(b), bytes([b]).decode(_ONE_BYTE[name], errors="ignore")) for b in range(128, 256)]
    mapped = [(a, b) for a, b in upper if b]
    return F.translate(latin, "".join(a for a, _ in mapped), "".join(b for _, b in mapped))


@dataclass(frozen=True)
class TextFile:
    """A file, how to read it, and where its stretches that start inside quotes begin.

    ``line_end`` is the one line end of all its lines if each line is a record and
    Spark's own readers can be trusted with it, else None.
    """

    file: InputFile
    encoding: str
    rule: QuoteRule
    repair: Callable[[bytes], bytes] | None = None
    line_end: str | None = None
    inside: frozenset[int] = frozenset()


def stretch_bytes(spark: SparkSession) -> int:
    return min(STRETCH, bytes_setting(spark, "spark.sql.files.maxPartitionBytes"))


def _stretches(spark: SparkSession, texts: Sequence[TextFile]) -> DataFrame:
    """(at, start) of every stretch: ``at`` is the file's place in ``texts``."""
    size = stretch_bytes(spark)
    files = spark.createDataFrame([(i, t.file.bytes) for i, t in enumerate(texts)], "at int, bytes long")
    starts = files.select("at", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("start"))
    count = sum(max(1, -(-t.file.bytes // size)) for t in texts)
    # A few stretches to a task, dealt evenly whatever the sizes of the files.
    slots = max(1, min(count, max(4 * spark.sparkContext.defaultParallelism, count // 16)))
    return starts.repartition(slots, F.xxhash64("at", "start"))


def _opened(texts: Sequence[TextFile], size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes, Callable]]:
    for batch in batches:
        more = batch.column("inside").to_pylist() if "inside" in batch.schema.names else [False] * batch.num_rows
        for at, start, inside in zip(batch.column("at").to_pylist(), batch.column("start").to_pylist(), more):
            text = texts[at]
            with open_input(text.file.path) as file:
                yield at, start, inside, *read_stretch(file, start, start + size, text.rule.newline, text.repair)


def look_through(spark: SparkSession, texts: Sequence[TextFile]) -> list[TextFile]:
    """The files with what a look at all their bytes tells; an error names a file whose bytes or line ends are not what they should be.

    A stretch comes back as some twenty bytes.
    """
    # Headers stay here: tasks need the paths and the rules only.
    size, slim = stretch_bytes(spark), list(texts)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for at, start, _, data, ahead in _opened(slim, size, batches):
            told = sum_up(data, ahead, slim[at].rule, slim[at].encoding)
            rows.append((at, start, *(int(getattr(told, f)) for f in _FACTS)))
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["at", "start", *_FACTS])

    schema = "at int, start long, " + ", ".join(f"{f} long" for f in _FACTS)
    told = _stretches(spark, slim).mapInArrow(sums, schema).toArrow()
    column = {c: told[c].to_numpy() for c in told.column_names}
    order = np.lexsort((column["start"], column["at"]))
    column = {c: v[order] for c, v in column.items()}
    edges = np.searchsorted(column["at"], np.arange(len(slim) + 1))
    return [_judged(text, {c: v[a:b] for c, v in column.items()}) for text, a, b in zip(texts, edges, edges[1:])]


def _judged(text: TextFile, stretch: dict[str, np.ndarray]) -> TextFile:
    invalid = int(stretch["invalid"].sum())
    if invalid:
        raise ValueError(f"{text.file.uri} is not {text.encoding}: {invalid} lines do not decode; name its encoding")
    plain = bool(stretch["plain"].all() and not stretch["ends_out"].any())
    inside, other = [], int(stretch["other_out"].sum())
    if not plain:
        state, other = False, 0
        for i, (start, has_lines) in enumerate(zip(stretch["start"].tolist(), stretch["lines"].tolist())):
            if state:
                inside.append(start)
            other += int(stretch["other_in" if state else "other_out"][i])
            if has_lines:
                state = bool(stretch["ends_in" if state else "ends_out"][i])
    if other:
        raise ValueError(f"{text.file.uri} mixes line ends: {other} lines hold another one outside quotes")
    lf, cr, crlf = (int(stretch[c].sum()) for c in ("lf", "cr", "crlf"))
    line_end = None
    if plain and not stretch["nul"].any():
        if text.rule.newline == b"\r":
            line_end = "\r" if not lf else None
        else:
            line_end = "\n" if not crlf else "\r\n" if crlf == lf == cr else None
    return replace(text, line_end=line_end, inside=frozenset(inside))


def scan_records(spark: SparkSession, texts: Sequence[TextFile], blank: Callable[[str], bool] | None = None) -> DataFrame:
    """``(src, block, seq, value, damaged)`` of the data records of files of one encoding, their header records left out.

    Sorted by ``(src, block, seq)`` records are as in the files. ``blank`` tells
    records that cannot be a header. Damaged is a record in which a quote was lost.
    """
    size, slim = stretch_bytes(spark), list(texts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, start, inside, data, ahead in _opened(slim, size, batches):
            text, seq, header = slim[at], 0, start == 0
            for offsets, values, damaged in records_of(data, inside, ahead, text.rule) if data else ():
                first = 0
                while header and first < len(offsets) - 1:
                    record = values[offsets[first]:offsets[first + 1]].decode(text.encoding, errors="replace")
                    header, first = bool(blank and blank(record)), first + 1
                for low in range(first, len(offsets) - 1, ROWS):
                    part = offsets[low:low + ROWS + 1]
                    n = len(part) - 1
                    buffers = [None, pa.py_buffer((part - part[0]).astype(np.int32)), pa.py_buffer(values[part[0]:part[-1]])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, text.file.src, dtype=np.int32)), pa.array(np.full(n, start, dtype=np.int64)),
                            pa.array(np.arange(seq, seq + n, dtype=np.int64)), pa.Array.from_buffers(pa.binary(), n, buffers),
                            pa.array(np.full(n, damaged)),
                        ],
                        ["src", "block", "seq", "raw", "damaged"],
                    )
                    seq += n

    starts = _stretches(spark, slim)
    inside = [(i, s) for i, t in enumerate(slim) for s in t.inside]
    if inside:
        # Two numbers for a stretch, of which a scan takes MAX_SPLITS at most.
        known = spark.createDataFrame([(*x, True) for x in inside], "at int, start long, inside boolean")
        starts = starts.join(F.broadcast(known), ["at", "start"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    else:
        starts = starts.withColumn("inside", F.lit(False))
    found = starts.mapInArrow(read, "src int, block long, seq long, raw binary, damaged boolean")
    return found.select("src", "block", "seq", decode_bytes(F.col("raw"), slim[0].encoding).alias("value"), "damaged")
