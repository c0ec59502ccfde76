"""Row numbers and sheets."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import ordering
from gridloom.operators.ordering import number_rows, split_sheets
from gridloom.sources.csv_files import read_csv


def test_sheets_roll_over(spark, tmp_path):
    (tmp_path / "data_2023.csv").write_text("v,w\n" + "".join(f"{i},x\n" for i in range(5)))
    (tmp_path / "data_2024.csv").write_text("v,w\n" + "".join(f"{i},x\n" for i in range(3)))
    df = read_csv(spark, str(tmp_path), with_order=True, with_year=True)
    got = split_sheets(df, "_year", cap=2).groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct("sheet_row", "v"))).alias("r"))
    assert {r.sheet: [(x.sheet_row, x.v) for x in r.r] for r in got.collect()} == {
        "2023": [(1, "0"), (2, "1")], "2023 (2)": [(1, "2"), (2, "3")], "2023 (3)": [(1, "4")],
        "2024": [(1, "0"), (2, "1")], "2024 (2)": [(1, "2")],
    }


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_numbers_match_a_plain_window(spark, parts):
    random.seed(parts)
    data = [(random.choice("aab"), random.choice([1.0, 1.0, 1.0, None, random.random() * 9]), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, v double, id long").repartition(parts)
    got = [tuple(r) for r in number_rows(df, ["g"], "v", buckets=8).collect()]
    for g in "ab":
        mine = sorted((r for r in got if r[0] == g), key=lambda r: r[3])
        assert [r[3] for r in mine] == list(range(1, len(mine) + 1))
        filled = [r[1] for r in mine if r[1] is not None]
        assert filled == sorted(filled) and all(r[1] is None for r in mine[len(filled):])
    assert sorted(r[2] for r in got) == list(range(500))


def test_equal_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(ordering, "EQUAL_ROWS", 7)
    data = [("a", 1.0, 0.0)] * 60 + [("a", 1.0, -0.0)] * 15 + [("a", 2.0, 1.0), ("b", 1.0, 0.0), ("a", 0.5, 3.0)] + [("a", None, None)] * 20
    df = spark.createDataFrame(data, "g string, v double, w double").repartition(3)
    assert ordering._by_quantiles(df, "v", 8).agg(F.max("__copies")).first()[0] == 7
    got = [tuple(r) for r in number_rows(df, ["g"], "v", buckets=8).collect()]
    assert sorted(map(repr, (r[:3] for r in got))) == sorted(map(repr, data))
    mine = sorted((r for r in got if r[0] == "a"), key=lambda r: r[3])
    assert [r[3] for r in mine] == list(range(1, 98))
    assert [r[1] for r in mine] == [0.5] + [1.0] * 75 + [2.0] + [None] * 20


def test_text_order_is_refused(spark):
    with pytest.raises(ValueError):
        number_rows(spark.createDataFrame([("a", "b")], "g string, v string"), ["g"], "v")


def test_runs_are_written_out_by_many_tasks(spark, monkeypatch):
    """Runs are small, so tasks sized by their bytes would write a whole table's copies out in one."""
    monkeypatch.setattr(ordering, "EQUAL_ROWS", 500)
    monkeypatch.setattr(ordering, "ROWS_A_TASK", 5_000, raising=False)
    df = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 4).alias("v"))
    got = number_rows(df, ["g"], "v")
    tasks = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(tasks) >= 10 and max(r.n for r in tasks) <= 20_000
    seen = got.groupBy("g", "v").agg(F.min("_rn").alias("lo"), F.max("_rn").alias("hi"), F.count_distinct("_rn").alias("n")).orderBy("g", "v").collect()
    assert all(r.hi - r.lo + 1 == r.n for r in seen) and sum(r.n for r in seen) == 100_000
    assert [r.lo for r in seen if r.v == 0] == [1, 1]


def test_equal_rows_are_counted_by_hash(spark):
    df = spark.range(1_000).select(F.lit("a").alias("g"), (F.col("id") % 2).alias("v"), F.lit(1.5).alias("w"))
    plan = ordering._by_quantiles(df, "v", 8)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
