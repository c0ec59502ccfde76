"""Table profile and row counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gridloom.functions.names import col

# Narrowest and widest column shown on a sheet.
MIN_WIDTH, MAX_WIDTH = 5, 50
SUMMARY_MIN_WIDTH, SUMMARY_MAX_WIDTH, SUMMARY_PADDING = 12, 60, 2


def display_width(longest: Column, summary: bool = False) -> Column:
    """Sheet column width for the longest cell."""
    if summary:
        return F.least(F.greatest(longest + SUMMARY_PADDING, F.lit(SUMMARY_MIN_WIDTH)), F.lit(SUMMARY_MAX_WIDTH))
    return F.least(F.greatest(longest, F.lit(MIN_WIDTH)), F.lit(MAX_WIDTH))


def profile(df: DataFrame, columns: Sequence[str] | None = None, distinct: str = "approx") -> DataFrame:
    """One row per column: position, name, type, rows, filled cells, distinct values, longest cell, sheet width.

    ``approx`` is one pass with fixed-size sketches; ``exact`` shuffles the distinct
    (column, value) pairs.
    """
    names = list(columns or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ordinals = {c: i + 1 for i, c in enumerate(df.columns)}
    facts = F.array(
        *[F.struct(F.lit(ordinals[n]).alias("ordinal"), F.lit(n).alias("column"), F.lit(types[n]).alias("type")) for n in names]
    )
    if distinct == "exact":
        out = _exact(df, names)
        info = df.sparkSession.createDataFrame(
            [(ordinals[n], n, types[n]) for n in names], "ordinal int, column string, type string"
        )
        zero = {c: 0 for c in ("n_rows", "non_null", "n_distinct", "longest")}
        out = info.join(out, "column", "left").fillna(zero)
    else:
        measures = []
        for i, n in enumerate(names):
            cell = col(n)
            measures += [
                F.count(cell).alias(f"f{i}"), F.approx_count_distinct(cell).alias(f"d{i}"),
                F.coalesce(F.max(F.length(cell.cast("string"))), F.lit(0)).alias(f"w{i}"),
            ]
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), *measures)
        stats = F.array(
            *[
                F.struct(F.col(f"f{i}").alias("non_null"), F.col(f"d{i}").alias("n_distinct"), F.col(f"w{i}").alias("longest"))
                for i in range(len(names))
            ]
        )
        out = (
            row.select("n_rows", F.inline(F.arrays_zip(facts.alias("fact"), stats.alias("stat"))))
            .select("fact.ordinal", "fact.column", "fact.type", "n_rows", "stat.non_null", "stat.n_distinct", "stat.longest")
        )
    return out.select(
        "ordinal", "column", "type", F.col("n_rows").cast("long").alias("n_rows"),
        F.col("non_null").cast("long").alias("non_null"), F.col("n_distinct").cast("long").alias("n_distinct"),
        F.col("longest").cast("int").alias("longest"), display_width(F.col("longest")).cast("int").alias("width"),
    )


def _exact(df: DataFrame, names: Sequence[str]) -> DataFrame:
    cells = df.select(*[col(n).cast("string").alias(f"__v{i}") for i, n in enumerate(names)])
    stacked = cells.unpivot([], [F.col(f"__v{i}").alias(n) for i, n in enumerate(names)], "column", "value")
    # Pre-aggregating by value first keeps a hot value, and the few columns, off single tasks.
    per_value = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("filled"))
    return per_value.groupBy("column").agg(
        F.sum("rows").alias("n_rows"), F.sum("filled").alias("non_null"),
        F.count("value").alias("n_distinct"), F.coalesce(F.max(F.length("value")), F.lit(0)).alias("longest"),
    )


def count_rows(df: DataFrame, name: str, conditions: Mapping[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """Count rows while they pass: no extra job. Read ``observation.get`` after an action on the frame."""
    observation = Observation(name)
    measures = [F.count(F.lit(1)).alias("rows")]
    measures += [F.count_if(c).alias(label) for label, c in (conditions or {}).items()]
    return df.observe(observation, *measures), observation
