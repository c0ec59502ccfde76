"""The exact top of a frequency from candidates of a sketch."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import summarize


@pytest.fixture
def skewed(spark):
    random.seed(5)
    often = [f" v{i} " for i in range(30) for _ in range(40 * (31 - i))]
    rare = [f"r{i}" for i in range(9_000)] + ["", "  ", None] * 50
    cells = often + rare
    random.shuffle(cells)
    return spark.createDataFrame([(c, i) for i, c in enumerate(cells)], "V string, n int").repartition(6)


@pytest.mark.parametrize("tracked", [(4_096,), (64, 4_096), (16, 32), (1 << 14,)])
@pytest.mark.parametrize("options", [{}, {"drop_empty": False}, {"case": "keep", "strip_ws": False, "count_name": "n"}])
def test_equals_the_full_count(skewed, rows, monkeypatch, tracked, options):
    monkeypatch.setattr(summarize, "TRACKED", tracked)
    got = summarize.top_frequency(skewed, "v", 12, **options)
    want = summarize.frequency(skewed, "v", top=12, **options)
    assert got.columns == want.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


@pytest.mark.parametrize("top", [0, 1, 7, 5_000])
def test_ties_and_few_values(spark, monkeypatch, top):
    monkeypatch.setattr(summarize, "TRACKED", (32,))
    frame = spark.range(3_000).select((F.col("id") % 500).alias("v"))
    got = [tuple(r) for r in summarize.top_frequency(frame, "v", top).collect()]
    assert got == [tuple(r) for r in summarize.frequency(frame, "v", top=top).collect()]
    few = frame.where("v < 3")
    assert [tuple(r) for r in summarize.top_frequency(few, "v", 9).collect()] == [("0", 6), ("1", 6), ("2", 6)]


def test_no_rows(spark):
    assert summarize.top_frequency(spark.range(0).select(F.col("id").alias("v")), "v", 3).count() == 0


def test_the_full_count_is_not_needed(spark):
    """A column of 150,000 values: candidates settle it, so the result is not the plan that groups all values."""
    frame = spark.range(200_000).select(F.when(F.col("id") % 4 == 0, F.lit(7)).otherwise(F.col("id")).alias("v"))
    got = summarize.top_frequency(frame, "v", 1)
    assert [tuple(r) for r in got.collect()] == [("7", 50_001)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
