"""CSV files with unknown encoding, separator and header, read as all-text tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.names import col, unique_headers
from gridloom.functions.quoting import field_count
from gridloom.functions.text import is_filled
from gridloom.functions.years import year_in_name
from gridloom.operators.union import union_exact
from gridloom.sources.files import InputFile, list_files, literal_path, pin_splits, scan_groups
from gridloom.sources.quote_scan import UTF8, QuoteRule
from gridloom.sources.records import TextFile, look_through, remap_latin, scan_records
from gridloom.sources.sniff import layouts, sniff

# Cell texts read as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

ORD = "_ord"
FILE = "_file"
YEAR = "_year"


@dataclass(frozen=True)
class Layout:
    encoding: str
    sep: str
    header: tuple[str, ...]
    newline: str = "\n"

    @property
    def rule(self) -> QuoteRule:
        return QuoteRule(self.sep.encode(), self.newline.encode(), len(self.header))


def null_tokens(c: Column, tokens: Sequence[str] | None = NA_TOKENS) -> Column:
    """Missing-value texts become NULL."""
    if tokens is None:
        return c
    # Most cells are longer than any token; their byte length is known without looking at them.
    longest = max(len(t.encode()) for t in tokens)
    return F.when((F.octet_length(c) > longest) | ~c.isin(list(tokens)), c)


def detect(
    spark: SparkSession, paths: str | Sequence[str], encoding: str | None = None, sep: str | None = None
) -> list[tuple[InputFile, Layout, str]]:
    """Each file with its layout and first line, in the caller's order."""
    files = list_files(spark, paths)
    found = {}
    for r in layouts(sniff(spark, files, encoding, sep)):
        layout = Layout(r.encoding, r.sep, tuple(r.header), r.newline)
        found.update(dict.fromkeys(r.srcs, (layout, r.first_line)))
    return [(f, *found[f.src]) for f in files]


def file_facts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(path, bytes, encoding, sep, bom, n_columns)`` per file, from the listing and the heads of the files."""
    files = list_files(spark, paths)
    listed = spark.createDataFrame([(f.src, f.path, f.bytes) for f in files], "src int, path string, bytes long")
    found = sniff(spark, files).withColumn("n_columns", F.size("header").cast("long"))
    return listed.join(found, "src").select("path", "bytes", "encoding", "sep", "bom", "n_columns")


def read_csv(
    spark: SparkSession, paths: str | Sequence[str], encoding: str | None = None, sep: str | None = None,
    na_tokens: Sequence[str] | None = NA_TOKENS, with_order: bool = False,
    with_file: bool = False, with_year: bool = False, years: Mapping[str, int] | None = None, look: int = QuoteRule.look,
) -> DataFrame:
    """Any number of CSV files as one all-text table, columns united by exact name.

    Rows with too many fields are dropped, short ones padded, quoted line breaks kept
    as they are, carriage returns included. One job looks at the bytes of all files;
    then each file is scanned once: by Spark's own reader where every line is a record,
    else record by record. Bytes that are not in the file's encoding are an error,
    wherever they stand, and so are line ends of two kinds outside quotes. A quote behind
    which whole rows follow for ``look`` bytes before anything closes it was lost and is a plain
    character of its cell; :func:`damaged_lines` lists the rows.

    ``with_order`` adds ``_ord``, ``with_file`` ``_file``, ``with_year`` ``_year``
    (from the file name, or from ``years`` by file name).
    """
    parts = read_csv_parts(spark, paths, encoding, sep, na_tokens, with_order, with_file, with_year, years, look)
    carry = [n for n, wanted in ((ORD, with_order), (FILE, with_file), (YEAR, with_year)) if wanted]
    frames = [p.frame if with_order else p.frame.drop(ORD) for p in parts]
    return frames[0] if len(frames) == 1 else union_exact(frames, carry)


@dataclass(frozen=True)
class CsvPart:
    """Files of one layout as one frame; ``years`` by ``src``, where years are asked for."""

    layout: Layout
    years: Mapping[int, int]
    files: tuple[InputFile, ...]
    frame: DataFrame


def read_csv_parts(
    spark: SparkSession, paths: str | Sequence[str], encoding: str | None = None, sep: str | None = None,
    na_tokens: Sequence[str] | None = NA_TOKENS, with_order: bool = True, with_file: bool = False,
    with_year: bool = False, years: Mapping[str, int] | None = None, look: int = QuoteRule.look,
) -> list[CsvPart]:
    """One frame per distinct layout, so the plan grows with layouts and not with files.

    ``_ord`` is there when asked for, or when a file fact is found by it.
    """
    ordered = with_order or with_file or with_year
    pin_splits(spark)
    looked = _looked(spark, paths, encoding, sep, look)
    year_of = file_years([t.file for texts in looked.values() for t in texts], years) if with_year else {}
    if not looked:
        raise ValueError(f"no header found in {paths!r}")
    parts = []
    for layout, texts in looked.items():
        of_path = {t.file.path: t for t in texts}
        for portion in scan_groups(spark, [t.file for t in texts]):
            frame = _read(spark, layout, [of_path[f.path] for f in portion], na_tokens, ordered)
            if with_file:
                frame = _with_file_fact(frame, {f.src: f.path for f in portion}, FILE, "string")
            part_years = {f.src: year_of[f.src] for f in portion} if with_year else {}
            if with_year:
                frame = _with_file_fact(frame, part_years, YEAR, "int")
            parts.append(CsvPart(layout, part_years, tuple(portion), frame))
    return parts


def _looked(
    spark: SparkSession, paths: str | Sequence[str], encoding: str | None, sep: str | None, look: int
) -> dict[Layout, list[TextFile]]:
    """Files that have a header by layout, all of them looked through in one job."""
    found = [(f, layout) for f, layout, _ in detect(spark, paths, encoding, sep) if layout.header]
    texts = [TextFile(f, layout.encoding, replace(layout.rule, look=look)) for f, layout in found]
    out: dict[Layout, list[TextFile]] = {}
    for (_, layout), text in zip(found, look_through(spark, texts) if texts else []):
        out.setdefault(layout, []).append(text)
    return out


def file_years(files: Sequence[InputFile], given: Mapping[str, int] | None = None) -> dict[int, int]:
    """Year of each file: as ``given`` by path or file name, else from the name; neither is an error."""
    out = {}
    for f in files:
        name = f.path.rsplit("/", 1)[-1]
        year = next((given[k] for k in (f.path, name) if given and k in given), None)
        year = year if year is not None else year_in_name(os.path.splitext(name)[0])
        if year is None:
            raise ValueError(f"no year in file name {name!r}; give one in years")
        out[f.src] = int(year)
    return out


def _with_file_fact(frame: DataFrame, facts: Mapping[int, object], name: str, dtype: str) -> DataFrame:
    if len(set(facts.values())) == 1:
        return frame.withColumn(name, F.lit(next(iter(facts.values()))).cast(dtype))
    # At most MAX_FILES rows.
    table = frame.sparkSession.createDataFrame(list(facts.items()), f"__src int, `{name}` {dtype}")
    placed = frame.withColumn("__src", col(ORD)["src"]).join(F.broadcast(table), "__src")
    return placed.select(*[col(c) for c in frame.columns], name)


def dropped_lines(
    spark: SparkSession, paths: str | Sequence[str], encoding: str | None = None, sep: str | None = None, look: int = QuoteRule.look
) -> DataFrame:
    """``(file, n_fields, value)`` of every record that :func:`read_csv` drops: it has more fields than its file's header.

    The same scan with the test turned round, so the two together hold every record that is not blank.
    """
    def wide(layout: Layout, rows: DataFrame) -> DataFrame:
        return rows.where(F.size(_fitting(layout)) == 0)

    return _listed(spark, _looked(spark, paths, encoding, sep, look), wide)


def damaged_lines(
    spark: SparkSession, paths: str | Sequence[str], encoding: str | None = None, sep: str | None = None, look: int = QuoteRule.look
) -> DataFrame:
    """``(file, n_fields, value)`` of every record in which a quote was lost, as it is read. Only files with such records are scanned."""
    looked = {layout: [t for t in texts if t.line_end is None] for layout, texts in _looked(spark, paths, encoding, sep, look).items()}
    return _listed(spark, {k: v for k, v in looked.items() if v}, lambda _, rows: rows.where("damaged"))


def _listed(spark: SparkSession, looked: Mapping[Layout, list[TextFile]], choose: Callable[[Layout, DataFrame], DataFrame]) -> DataFrame:
    frames = []
    for layout, texts in looked.items():
        of_path = {t.file.path: t for t in texts}
        for portion in scan_groups(spark, [t.file for t in texts]):
            chosen = choose(layout, _records(spark, layout, [of_path[f.path] for f in portion]))
            placed = _with_file_fact(chosen.withColumn(ORD, F.struct("src", "block", "seq")), {f.src: f.path for f in portion}, "file", "string")
            frames.append(placed.select("file", field_count(F.col("value"), layout.sep).cast("int").alias("n_fields"), "value"))
    if not frames:
        return spark.createDataFrame([], "file string, n_fields int, value string")
    return reduce(DataFrame.union, frames)


def _records(spark: SparkSession, layout: Layout, texts: Sequence[TextFile]) -> DataFrame:
    """Records that are not blank."""
    sep = layout.sep
    rows = scan_records(spark, texts, lambda record: not record.strip() and sep not in record)
    return rows.where(is_filled(F.col("value")) | F.contains("value", F.lit(sep)))


def _options(layout: Layout) -> dict[str, str]:
    return {"sep": layout.sep, "quote": '"', "escape": '"', "columnNameOfCorruptRecord": "_off"}


def _schema(layout: Layout) -> str:
    return ", ".join(f"{c} string" for c in [*(f"c{i}" for i in range(len(layout.header))), "_off"])


def _fitting(layout: Layout) -> Column:
    """An array of the cells of ``value``: one struct, or none where the record is ragged.

    Records with another number of fields than the header come back marked; only their
    fields are counted. inline() parses each record once for both the test and the cells.
    """
    record = F.from_csv("value", _schema(layout), _options(layout))
    return F.filter(F.array(record), lambda r: r["_off"].isNull() | (field_count(F.col("value"), layout.sep) <= len(layout.header)))


def _read(spark: SparkSession, layout: Layout, texts: Sequence[TextFile], na_tokens: Sequence[str] | None, ordered: bool) -> DataFrame:
    cells = [f"c{i}" for i in range(len(layout.header))]
    order = [ORD] if ordered else []
    # Spark's reader passes over lines of white space, which may be rows where that is what separates.
    own = layout.sep.strip() != ""
    by_end: dict[str | None, list[TextFile]] = {}
    for text in texts:
        by_end.setdefault(text.line_end if own else None, []).append(text)
    frames = []
    for line_end, members in by_end.items():
        if line_end is None:
            rows = _records(spark, layout, members).select(*[F.struct("src", "block", "seq").alias(c) for c in order], F.inline(_fitting(layout)))
        else:
            rows = _lines(spark, layout, members, line_end, ordered)
        frames.append(rows.select(*[null_tokens(F.col(c), na_tokens).alias(c) for c in cells], *order))
    return reduce(DataFrame.union, frames).toDF(*unique_headers(layout.header), *order)


def _lines(spark: SparkSession, layout: Layout, texts: Sequence[TextFile], line_end: str, ordered: bool) -> DataFrame:
    """Files whose every line is a record, by Spark's own reader."""
    encoding = "UTF-8" if layout.encoding.lower() in UTF8 else "ISO-8859-1"
    # Cells are told from what is left over only if all of them are parsed.
    options = {**_options(layout), "header": "true", "encoding": encoding, "lineSep": line_end, "columnPruning": "false"}
    raw = spark.read.schema(_schema(layout)).options(**options).csv([literal_path(t.file.path) for t in texts])
    place = []
    if ordered:
        known = F.lit(texts[0].file.src)
        if len(texts) > 1:
            uri = F.col("_metadata.file_path")
            raw = raw.select("*", uri.alias("_uri"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))
            # At most MAX_FILES rows; and the join must leave the lines where they are.
            table = spark.createDataFrame([(t.file.uri, t.file.src) for t in texts], "_uri string, _src int")
            raw, known = raw.join(F.broadcast(table), "_uri"), F.col("_src")
        else:
            raw = raw.select("*", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))
        place = [F.struct(known.alias("src"), F.col("_block").alias("block"), F.col("_seq").alias("seq")).alias(ORD)]
    fits = F.col("_off").isNull() | (field_count(F.col("_off"), layout.sep) <= len(layout.header))
    # A look at one more column: Spark refuses to read the left-over one alone.
    read = F.length(F.coalesce("c0", F.lit(""))) >= 0
    cells = [remap_latin(F.col(f"c{i}"), layout.encoding).alias(f"c{i}") for i in range(len(layout.header))]
    return raw.where(fits & read).select(*cells, *place)


def read_table(spark: SparkSession, paths: str | Sequence[str], sheet: str | None = None, **options) -> DataFrame:
    """CSV files or one sheet of workbooks, by file name ending."""
    given = [paths] if isinstance(paths, str) else list(paths)
    endings = {os.path.splitext(p)[1].lower() for p in given}
    if endings == {".csv"}:
        return read_csv(spark, given, **options)
    if endings == {".xlsx"}:
        from gridloom.sources.workbook import read_sheet

        return read_sheet(spark, given, sheet, **options)
    raise ValueError(f"cannot tell the format of {sorted(endings)}")
