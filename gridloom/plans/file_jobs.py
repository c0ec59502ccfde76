"""One-step jobs on files: filter, frequency, unique values, dedup, profile, preview."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators import dedup, profile, summarize
from gridloom.operators.predicates import Filter, apply_filters
from gridloom.sources.csv_files import ORD, read_table


def filter_file(
    spark: SparkSession, paths: str | Sequence[str], filters: Sequence[Filter | Mapping], sheet: str | None = None,
    dialect: str = "default", **options,
) -> DataFrame:
    return apply_filters(read_table(spark, paths, sheet, **options), filters, dialect)


def frequency_of_file(
    spark: SparkSession, paths: str | Sequence[str], column: str, sheet: str | None = None, top: int | None = None,
    case: str = "upper", strip_ws: bool = True, drop_empty: bool = True, **options,
) -> DataFrame:
    return summarize.frequency(read_table(spark, paths, sheet, **options), column, case, strip_ws, drop_empty, top=top)


def unique_of_file(
    spark: SparkSession, paths: str | Sequence[str], column: str, sheet: str | None = None,
    case: str = "upper", strip_ws: bool = True, drop_empty: bool = True, **options,
) -> DataFrame:
    return summarize.unique_values(read_table(spark, paths, sheet, **options), column, case, strip_ws, drop_empty)


def dedup_file(
    spark: SparkSession, paths: str | Sequence[str], keys: Sequence[str], normalize_keys: bool = True,
    keep: str | bool = "first", sheet: str | None = None, **options,
) -> DataFrame:
    df = read_table(spark, paths, sheet, with_order=True, **options)
    return dedup.deduplicate(df, keys, normalize_keys, keep).drop(ORD)


def profile_file(
    spark: SparkSession, paths: str | Sequence[str], sheet: str | None = None, distinct: str = "approx", **options
) -> DataFrame:
    return profile.profile(read_table(spark, paths, sheet, **options), distinct=distinct)


def preview_file(spark: SparkSession, paths: str | Sequence[str], n: int = 20, sheet: str | None = None, **options) -> DataFrame:
    """The first rows of the first file."""
    return read_table(spark, paths, sheet, with_order=True, **options).orderBy(ORD).limit(n).drop(ORD)
