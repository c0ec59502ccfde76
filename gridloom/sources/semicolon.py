"""Semicolon files with damaged quoting: quotes are repaired, records joined over lines, ragged rows kept."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.names import col, unique_headers
from gridloom.functions.numbers import safe_number
from gridloom.functions.quoting import QUOTES, quoted_split
from gridloom.operators.union import union_exact
from gridloom.sources.csv_files import ORD
from gridloom.sources.files import list_files, scan_groups
from gridloom.sources.quote_scan import QuoteRule
from gridloom.sources.records import TextFile, look_through, scan_records
from gridloom.sources.sniff import layouts, sniff

EXTRA = "_extra"
DAMAGED = "_damaged"
# Registry id columns that stay text when cells are typed.
TEXT_COLUMNS = ("reg_addr_koatuu", "n_reg_new")


@dataclass(frozen=True)
class QuoteRepair:
    """:func:`gridloom.functions.quoting.norm_quotes` on bytes of an encoding."""

    encoding: str
    apostrophe_as_quote: bool

    def __call__(self, data: bytes) -> bytes:
        for typographic, ascii_quote in QUOTES.items():
            if self.apostrophe_as_quote or ascii_quote == '"':
                coded = typographic.encode(self.encoding, errors="ignore")
                data = data.replace(coded, ascii_quote.encode()) if coded else data
        data = data.replace(b'\\"', b'""')
        return data.replace(b"'", b'"') if self.apostrophe_as_quote else data


def read_semicolon(
    spark: SparkSession, paths: str | Sequence[str], sep: str = ";", encoding: str | None = None,
    apostrophe_as_quote: bool = False, with_order: bool = False, with_damaged: bool = False, look: int = QuoteRule.look,
) -> DataFrame:
    """All-text table with the cells beyond the header in ``_extra ARRAY<STRING>`` (NULL where there are none).

    Any quote opens or closes, wherever it stands. A cell the row does not have is
    NULL, an empty one ``''``. A quote behind which ``look`` bytes of whole rows follow
    before anything closes it was lost: it is a plain character, and its row is marked in
    ``_damaged`` where ``with_damaged`` asks for it. Nearer to the end of the file, a quote
    that nothing closes makes the rest of the file its cell.
    """
    files = list_files(spark, paths)
    texts: dict[tuple, list[TextFile]] = {}
    for r in layouts(sniff(spark, files, encoding, sep, True, apostrophe_as_quote)):
        rule = QuoteRule(sep.encode(), r.newline.encode(), len(r.dirty_header), anywhere=True, look=look)
        repair = QuoteRepair(r.encoding, apostrophe_as_quote)
        texts.setdefault((r.encoding, tuple(r.dirty_header)), []).extend(TextFile(files[i], r.encoding, rule, repair) for i in r.srcs)
    looked = iter(look_through(spark, [t for members in texts.values() for t in members]))
    portions = []
    for (_, header), members in texts.items():
        of_path = {t.file.path: t for t in (next(looked) for _ in members)}
        ranked = sorted((t.file for t in of_path.values()), key=lambda f: f.src)
        portions += [(header, [of_path[f.path] for f in portion]) for portion in scan_groups(spark, ranked)]
    carry = [EXTRA, *([ORD] if with_order else []), *([DAMAGED] if with_damaged else [])]
    frames = []
    for header, members in sorted(portions, key=lambda p: p[1][0].file.src):
        records = scan_records(spark, members)
        fields = records.select(F.struct("src", "block", "seq").alias(ORD), quoted_split(F.col("value"), sep).alias("f"), F.col("damaged").alias(DAMAGED))
        n = len(header)
        cells = [F.get("f", F.lit(i)).alias(f"c{i}") for i in range(n)]
        extra = F.when(F.size("f") > n, F.slice("f", n + 1, F.size("f"))).alias(EXTRA)
        frames.append(fields.select(*cells, extra, *carry[1:]).toDF(*unique_headers(header), *carry))
    return frames[0] if len(frames) == 1 else union_exact(frames, carry)


def type_cells(df: DataFrame, text_columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """Each text cell as ``STRUCT<txt, num>``: numbers become numbers, ids and ``text_columns`` stay text."""
    stay = {c.strip().lower() for c in text_columns}
    out = []
    for field in df.schema.fields:
        cell = col(field.name)
        if field.dataType.simpleString() != "string":
            out.append(cell)
        elif field.name.strip().lower() in stay:
            text = F.struct(F.coalesce(cell, F.lit("")).alias("txt"), F.lit(None).cast("double").alias("num"))
            out.append(text.alias(field.name))
        else:
            out.append(safe_number(cell).alias(field.name))
    return df.select(*out)
