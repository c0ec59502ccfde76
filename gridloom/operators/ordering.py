"""Row numbers and capped sheets, without passing a group through one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.names import NUMBERED, col

ORD = "_ord"
# Fixed value: data rows a sheet holds below its header.
SHEET_ROWS = 1_048_575

# Equal rows that are numbered, and written out again, at once.
EQUAL_ROWS = 10_000

# Rows a task writes out again, on average.
ROWS_A_TASK = 500_000

_BUCKET = ["__b0", "__b1", "__b2"]
_COPIES = "__copies"


def _position(df: DataFrame, order_by: str) -> Column:
    dtype = df.schema[order_by].dataType
    if isinstance(dtype, T.NumericType):
        return col(order_by).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col(order_by).cast("timestamp").cast("double")
    raise ValueError(f"order_by must be a number, date or time, or {ORD}; {order_by!r} is {dtype.simpleString()}")


def tasks_for(rows: int) -> int:
    """Tasks that rows are dealt over so that none has many more than ``ROWS_A_TASK``."""
    return max(1, -(-rows // ROWS_A_TASK))


def _quantiles(df: DataFrame, order_by: str, buckets: int) -> Row:
    """Cuts between buckets of nearly equal size, NULL order values and rows."""
    position = _position(df, order_by)
    steps = [i / buckets for i in range(1, buckets)]
    cuts = F.approx_percentile(position, steps, max(10_000, 10 * buckets))
    return df.agg(cuts.alias("cuts"), F.count_if(position.isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows")).first()


def _by_quantiles(df: DataFrame, order_by: str, buckets: int, seen: Row | None = None) -> DataFrame:
    """Buckets of nearly equal size along ``order_by``; a value too frequent for one bucket is cut further.

    Where the frame has no ``_ord``, the rows of such values come once each, with the number of their copies
    in ``__copies``: equal rows may take any of their numbers.
    """
    seen = seen or _quantiles(df, order_by, buckets)
    cuts = seen.cuts or []
    hot = {a for a, b in zip(cuts, cuts[1:]) if a == b}
    edges = sorted({*cuts, *(math.nextafter(v, math.inf) for v in hot)} - {math.inf, -math.inf})
    placed = df.withColumn("__position", _position(df, order_by))
    if edges:
        bucketizer = Bucketizer(
            splits=[-math.inf, *edges, math.inf], inputCol="__position", outputCol=_BUCKET[0], handleInvalid="keep"
        )
        placed = bucketizer.transform(placed).withColumn(_BUCKET[0], F.coalesce(F.col(_BUCKET[0]).cast("int"), F.lit(len(edges) + 1)))
    else:
        placed = placed.withColumn(_BUCKET[0], F.lit(0))
    none = F.lit(0).cast("long")
    if not hot and not seen.nulls:
        return placed.withColumns({_BUCKET[1]: none, _BUCKET[2]: none}).drop("__position")
    # NULL order values share the last bucket and are cut like a hot value.
    crowded = F.col("__position").isNull()
    if hot:
        crowded = crowded | F.col("__position").isin(sorted(hot))
    if ORD in df.columns:
        finer = [col(ORD)["src"].cast("long"), col(ORD)["block"]]
    else:
        content = [col(f.name) for f in df.schema.fields if _comparable(f.dataType)]
        finer = [F.pmod(F.xxhash64(*content), F.lit(buckets)) if content else none, none]
        if len(content) == len(df.columns):
            calm = placed.where(~crowded).withColumns({_BUCKET[1]: none, _BUCKET[2]: none, _COPIES: F.lit(1).cast("long")})
            return calm.drop("__position").unionByName(_equal_rows(placed.where(crowded), df.schema.fields, finer[0]))
    return placed.withColumns({
        _BUCKET[1]: F.when(crowded, finer[0]).otherwise(none), _BUCKET[2]: F.when(crowded, finer[1]).otherwise(none),
    }).drop("__position")


def _comparable(dtype: T.DataType) -> bool:
    """Rows can be grouped by such a column."""
    if isinstance(dtype, T.ArrayType):
        return _comparable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_comparable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def _equal_rows(rows: DataFrame, fields: Sequence[T.StructField], finer: Column) -> DataFrame:
    """Each different row once for every ``EQUAL_ROWS`` of its copies. Copies are counted before they are shuffled."""
    # Grouping makes one zero of the two there are; their texts differ.
    keys = [(col(f.name).cast("string") if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col(f.name)).alias(f"__k{i}")
            for i, f in enumerate(fields)]
    # A flat key is its value as it is; a first text would make Spark sort the rows instead of counting them by hash.
    flat = [not isinstance(f.dataType, (T.FloatType, T.DoubleType, T.ArrayType, T.StructType)) for f in fields]
    kept = [F.first(col(f.name)).alias(f.name) for f, whole in zip(fields, flat) if not whole]
    counted = rows.groupBy(*keys).agg(*kept, F.first(_BUCKET[0]).alias(_BUCKET[0]), F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumnsRenamed({f"__k{i}": f.name for i, (f, whole) in enumerate(zip(fields, flat)) if whole})
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / EQUAL_ROWS).cast("long")))
    cut = counted.select(*[col(f.name) for f in fields], _BUCKET[0], finer.cast("long").alias(_BUCKET[1]), runs.alias(_BUCKET[2]), "__n")
    return cut.withColumn(_COPIES, F.least(F.lit(EQUAL_ROWS).cast("long"), F.col("__n") - F.col(_BUCKET[2]) * EQUAL_ROWS)).drop("__n")


def number_rows(
    df: DataFrame, group: Sequence[str], order_by: str | None = None, out: str = "_rn", buckets: int | None = None
) -> DataFrame:
    """Consecutive numbers from 1 within each group.

    Rows are put in ordered buckets (input splits for ``_ord``, quantiles for a
    column), buckets are counted, and a row's number is its bucket's offset plus its
    place in the bucket. So a group may hold any share of the rows: only its bucket
    counts meet in one task. Ties of ``order_by`` follow ``_ord`` where the frame has
    it, else row content; equal rows of a frequent value are counted, numbered as runs and
    written out again by tasks of ``ROWS_A_TASK`` rows or so.
    """
    cells = {c: F.col(f"__c{i}") for i, c in enumerate(df.columns)}
    if order_by in (None, ORD):
        if ORD not in df.columns:
            raise ValueError(f"numbering needs an order: give order_by, or scan with {ORD}")
        keyed = df.withColumns({
            _BUCKET[0]: F.lit(0), _BUCKET[1]: col(ORD)["src"].cast("long"), _BUCKET[2]: col(ORD)["block"],
        })
        inner = [cells[ORD]["seq"]]
    else:
        n = max(2, buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        seen = _quantiles(df, order_by, n)
        keyed = _by_quantiles(df, order_by, n, seen)
        inner = [cells[order_by].asc_nulls_last(), *([cells[ORD]] if ORD in df.columns else [])]

    groups = [f"__g{i}" for i in range(len(group))]
    many = _COPIES in keyed.columns
    copies = F.col(_COPIES) if many else F.lit(1).cast("long")
    keyed = keyed.select(
        *[col(g).alias(name) for g, name in zip(group, groups)], *_BUCKET, copies.alias(_COPIES), F.lit(None).cast("long").alias("__offset"),
        *[col(c).alias(f"__c{i}") for i, c in enumerate(df.columns)],
    )
    counted = keyed.groupBy(*groups, *_BUCKET).agg(F.sum(_COPIES).alias("__n"))
    before = Window.partitionBy(*groups).orderBy(*_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")))
    # A bucket's offset goes to its rows as the first row among them, so the rows are shuffled once.
    nothing = [F.lit(None).cast(f.dataType).alias(f"__c{i}") for i, f in enumerate(df.schema.fields)]
    heads = offsets.select(*groups, *_BUCKET, F.lit(0).cast("long").alias(_COPIES), "__offset", *nothing)
    in_order = Window.partitionBy(*groups, *_BUCKET).orderBy(F.col("__offset").isNull(), *inner)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = keyed.union(heads)
    if many:
        # Runs are few and small until they are written out, so tasks follow from the rows; by the runs' bytes there would be one.
        met = met.repartition(max(n, tasks_for(seen["rows"])), *groups, *_BUCKET)
    numbered = met.select(
        *cells.values(), _COPIES, F.sum(_COPIES).over(so_far).alias("__upto"), F.first("__offset").over(so_far).alias("__offset")
    ).where(F.col(_COPIES) > 0)
    # Every bucket was counted; should an input split be cut otherwise in this pass, fail rather than misnumber.
    offset = F.coalesce("__offset", F.raise_error(F.lit("input splits changed between two passes")).cast("long"))
    number = offset + F.col("__upto")
    if many:
        number = F.explode(F.sequence(number - F.col(_COPIES) + 1, number))
    return numbered.select(*[cell.alias(c) for c, cell in cells.items()], number.alias(out))


def sheet_name(group: Column, number: Column) -> Column:
    """``2023``, ``2023 (2)``, ``2023 (3)`` …"""
    return F.concat(group.cast("string"), F.when(number > 1, F.concat(F.lit(" ("), number.cast("string"), F.lit(")"))).otherwise(""))


def sheet_group(sheet: Column) -> Column:
    """``2023`` of ``2023``, ``2023 (2)``, ``2023 (3)`` …"""
    return F.regexp_replace(sheet, rf"{NUMBERED}\z", "")


def split_sheets(
    df: DataFrame, group: str, cap: int = SHEET_ROWS, order_by: str | None = None, buckets: int | None = None
) -> DataFrame:
    """Adds ``sheet_no``, ``sheet`` and ``sheet_row``: every group fills sheets of ``cap`` rows in order."""
    numbered = number_rows(df, [group], order_by, "__rn", buckets)
    number = (F.floor((F.col("__rn") - 1) / F.lit(cap)) + 1).cast("int")
    return numbered.withColumns({
        "sheet_no": number, "sheet": sheet_name(col(group), number),
        "sheet_row": (F.pmod(F.col("__rn") - 1, F.lit(cap)) + 1).cast("int"),
    }).drop("__rn")
