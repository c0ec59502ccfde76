"""Fill-in-the-middle: a text is cut at two ranks of its units and put together in another order.

Units are words with the white space before them. Each text's units lie in an
indexable skip list: lane 0 has a link for each unit, every lane above a link
for ``FAN`` links of the lane below, and each link carries how many units and
how many code points it passes. A rank is reached from the top lane by adding
up widths, so both cuts come out as code points without looking at the text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Links of a lane that one link of the lane above passes.
FAN = 16
#: Bytes of a text that are looked at together.
PIECE = 4 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_CUTS = StructType([StructField(name, LongType()) for name in ("n", "prefix_chars", "middle_chars")])


def unit_widths(data: bytes | memoryview) -> np.ndarray:
    """Code points of each unit of a UTF-8 text, in order.

    A unit ends where a byte that is no white space is followed by one that is,
    and at the end of the text.
    """
    ends, points, passed, inside = [], [], 0, False
    for at in range(0, len(data), PIECE):
        piece = np.frombuffer(data[at:at + PIECE], dtype=np.uint8)
        space = (piece == 32) | ((piece >= 9) & (piece <= 13))
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[0] &= inside
        inside = not space[-1]
        before = np.flatnonzero(cut)
        total = np.cumsum((piece & 0xC0) != 0x80, dtype=np.int64)
        # White space is one byte: the code points before a cut are all but its own.
        ends.append(passed + total[before] - 1)
        passed += int(total[-1])
    ends.append(np.array([passed] if len(data) else [], dtype=np.int64))
    return np.diff(np.concatenate(ends), prepend=0)


class SkipList:
    """Units under express lanes; every link knows the units and the code points it passes."""

    def __init__(self, widths: np.ndarray):
        self.size = len(widths)
        self.lanes = [(np.ones(len(widths), dtype=np.int64), widths)]
        while len(self.lanes[-1][0]) > FAN:
            units, points = self.lanes[-1]
            heads = np.arange(0, len(units), FAN)
            self.lanes.append((np.add.reduceat(units, heads), np.add.reduceat(points, heads)))

    def points_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        link, passed, points = 0, 0, 0
        for units, widths in reversed(self.lanes):
            while link < len(units) and passed + units[link] <= rank:
                passed += int(units[link])
                points += int(widths[link])
                link += 1
            link *= FAN
        return points


@F.arrow_udf(_CUTS)
def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, one, two in batches:
        found = []
        for text, a, b in zip(texts, one.to_pylist(), two.to_pylist()):
            units = SkipList(unit_widths(memoryview(text.as_buffer()) if text.is_valid else b""))
            low, high = sorted((a % (units.size + 1), b % (units.size + 1)))
            first = units.points_before(low)
            found.append((units.size, first, units.points_before(high) - first))
        columns = zip(*found) if found else ((), (), ())
        yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], names=_CUTS.names)


def draws(key: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2^32 that ``seed`` and ``key`` decide."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) of each row of ``docs`` (doc_id, text).

    ``rate`` of 100 texts are cut; of these ``suffix_first`` of 100 take the form
    spm, the others psm. A text that is empty or null, or holds one of the marks
    itself, stays plain: its output is the text, and the two widths are null.
    Null texts count as empty; a null id is drawn as an empty one. Rows with
    equal ids are cut at the same ranks, repeated rows stay repeated. Other
    columns are not read. White space at the end is a unit of its own; texts of
    any length are cut whole. No rows give no rows.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    cut = keyed.select("doc_id", "text", _cuts(F.col("text").cast("binary"), h1, h2).alias("cut"))
    text, first, middle = F.col("text"), F.col("cut.prefix_chars"), F.col("cut.middle_chars")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    told = cut.select("doc_id", "text", "cut.n", form.alias("form"), F.when(~plain, first).alias("prefix_chars"), F.when(~plain, middle).alias("middle_chars"))
    a, b = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, mid = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b)
    suffix = F.substring(text, a + b + 1, F.length(text))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), mid))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), mid))
        .otherwise(text)
    )
    return told.withColumn("output", output)


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` took; needs nothing but its output and form."""
    inner = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))

    def before(value: Column, mark: str) -> Column:
        return F.substring_index(value, mark, 1)

    def after(value: Column, mark: str) -> Column:
        return F.substring(value, F.locate(mark, value) + len(mark), F.length(value))

    psm = F.concat(before(inner, SUFFIX), after(inner, MIDDLE), before(after(inner, SUFFIX), MIDDLE))
    spm = F.concat(before(after(inner, PREFIX), MIDDLE), after(inner, MIDDLE), before(inner, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


#: What the query over ``documents`` returns.
SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as key from documents),
h as (select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
             ('0x' || key[1:8])::bigint as h1, ('0x' || key[9:16])::bigint as h2, ('0x' || key[17:24])::bigint as h3, ('0x' || key[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as hi,
             case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
                  when h4 % 100 < 80 then 'spm' else 'psm' end as form from h),
p as (select *, coalesce(array_to_string(u[1:lo], ''), '') as prefix, coalesce(array_to_string(u[lo + 1:hi], ''), '') as middle,
             coalesce(array_to_string(u[hi + 1:], ''), '') as suffix from c)
select doc_id, len(u)::bigint as n, form,
       case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
       sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""
