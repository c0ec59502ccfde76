"""Summaries, dedup, unions, profile and jobs on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import dedup, profile, summarize, union
from gridloom.plans import file_jobs, merge
from gridloom.plans.group_summary import COUNT_TITLE, OVERALL_FREQUENCY, group_summary, stack_blocks
from gridloom.plans.yearly import yearly_rows
from gridloom.session import shared_folder
from gridloom.sinks.sheets import append_sheet, export_sheets, read_appended, sheet_names, write_blocks
from gridloom.sources.csv_files import file_facts
from gridloom.sources.workbook import read_sheet, read_sheets
from gridloom.streaming import file_drop


def frame(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` string")


def test_frequency(spark, rows):
    df = frame(spark, ["b", "a ", "a", "B", "c", "", None, " "])
    assert rows(summarize.frequency(df, "v")) == [("A", 2), ("B", 2), ("C", 1)]
    assert rows(summarize.frequency(df, "v", drop_empty=False, top=1)) == [("", 3)]
    assert rows(summarize.frequency(df, "v", case="keep", strip_ws=False, count_name="n")) == [
        (" ", 1), ("B", 1), ("a", 1), ("a ", 1), ("b", 1), ("c", 1)
    ]
    total = summarize.frequency(df, "v").agg(F.sum("cnt")).first()[0]
    assert total == 5


def test_unique(spark, rows):
    df = frame(spark, ["b", "a", "A", None, "ї", "Z"], "my.col")
    assert rows(summarize.unique_values(df, "A", case="keep")) == [("A",), ("Z",), ("a",), ("b",), ("ї",)]
    assert summarize.unique_values(df, "my.col", count_name="n").columns == ["my.col", "n"]


def test_typed_columns_count_like_text(spark, rows):
    df = spark.createDataFrame([(1, 1.5, True), (1, None, False), (2, 1.5, True)], "i int, d double, b boolean")
    assert rows(summarize.frequency(df, "i")) == [("1", 2), ("2", 1)]
    assert rows(summarize.frequency(df, "d", drop_empty=False)) == [("1.5", 2), ("", 1)]
    assert rows(summarize.frequency(df, "b")) == [("TRUE", 2), ("FALSE", 1)]


def test_presence_and_total(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (3, "z")], "s int, v string")
    per_sheet = summarize.frequency_by_sheet(df, "s", "v", case="keep")
    both = {r.value: (r.sheets, r.cnt) for r in summarize.overall(per_sheet, "both").collect()}
    assert both == {"x": (2, 3), "y": (1, 1), "z": (1, 1)}
    assert dict(map(tuple, summarize.sheet_total(df, "s", "v", case="keep").collect())) == {"x": 3, "y": 1, "z": 1}
    with pytest.raises(ValueError):
        summarize.overall(per_sheet, "other")


def test_profile(spark):
    df = spark.createDataFrame([("a", 1), ("b" * 70, None), (None, 1)], "t string, n int")
    for kind in ("exact", "approx"):
        got = {r.column: tuple(r)[3:] for r in profile.profile(df, distinct=kind).collect()}
        assert got == {"t": (3, 2, 2, 70, 50), "n": (3, 2, 1, 1, 5)}


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_dedup_does_not_depend_on_partitions(spark, parts):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("a ", 4), ("b", 5)], "k string, v int").repartition(parts)

    def got(f, *args, **kw):
        return sorted(((r.k, r.v) for r in f(df, ["k"], *args, **kw).collect()), key=lambda r: r[1])

    assert got(dedup.dedup_raw, "last", "v") == [("a", 1), (None, 3), ("a ", 4), ("b", 5)]
    assert got(dedup.dedup_normalized, "first", "v") == [("A", 1), ("", 2), ("B", 5)]
    assert got(dedup.dedup_normalized, "last", "v") == [("", 3), ("A", 4), ("B", 5)]
    assert got(dedup.dedup_normalized, "none") == [("B", 5)]
    assert got(dedup.dedup_raw, False) == [("a", 1), ("a ", 4), ("b", 5)]
    with pytest.raises(ValueError):
        dedup.dedup_raw(df, "k", "first")


def test_hot_key_is_cut_before_the_shuffle(spark):
    random.seed(1)
    df = spark.createDataFrame([("hot" if i % 3 else str(i % 50), i) for i in range(3000)], "k string, v int")
    for keep in ("first", "none"):
        plan = dedup.dedup_raw(df, "k", keep, "v")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2
    once = dedup.dedup_raw(df, "k", "first", "v")
    assert once.count() == dedup.dedup_raw(once, "k", "first", "v").count() == df.select("k").distinct().count()


def test_dedup_by_key(spark):
    df = spark.createDataFrame([(" ab-1 ", 1), ("AB1", 2), ("a b-1", 3), (None, 4)], "Key string, v int")
    got = dedup.dedup_by_key(df, [" KEY "], order_by="v", drop_spaces=True, drop_dashes=True)
    assert sorted(map(tuple, got.collect())) == [("", 4), (" ab-1 ", 1)]


def test_unions(spark):
    a = spark.createDataFrame([(1, 2)], "a int, B int")
    b = spark.createDataFrame([(3, 4, 5)], "b int, a int, c int")
    df = union.union_exact([a, b])
    assert df.columns == ["a", "B", "b", "c"]
    assert sorted(map(tuple, df.collect())) == [(1, 2, None, None), (4, None, 3, 5)]
    text = union.union_exact([a, spark.createDataFrame([("x",)], "a string")])
    assert dict(text.dtypes)["a"] == "string"
    collide = [frame(spark, ["1"], "Лід"), frame(spark, ["2"], "Дід")]
    assert union.union_normalized(collide).columns == ["Лід", "Дід"]
    assert union.union_normalized(collide, norm="compat").columns == ["Лід"]


def test_group_summary(spark):
    sheets = {
        "one": spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "2")], "Brand string, k string"),
        "two": spark.createDataFrame([("X", "1")], "brand string, k string"),
        "other": frame(spark, ["?"], "nothing"),
    }
    with pytest.warns(UserWarning, match="other"):
        summary = group_summary(sheets, "brand")
    got = {(r.block, r.value): r.cnt for r in summary.collect()}
    assert got == {("one — brand", "X"): 2, ("one — brand", "Y"): 1, ("two — brand", "X"): 1, (OVERALL_FREQUENCY, "X"): 2, (OVERALL_FREQUENCY, "Y"): 1}
    del sheets["other"]
    total = group_summary(sheets, "brand", overall_kind="total")
    assert {r.value: r.cnt for r in total.where("block_no = 2").collect()} == {"X": 3, "Y": 1}
    several = group_summary(sheets, "A,B", several=True, dedup_keys="k", order_by=["k", "Brand"], filters={"two": [{"type": 1, "col_token": "k", "eq_value": "9"}]})
    assert sorted((r.block, r.value, r.cnt) for r in several.collect()) == [("one — Brand", "X", 2), ("one — k", "1", 1), ("one — k", "2", 1)]
    stacked = stack_blocks(total, "brand").orderBy("block_no", "part", F.desc_nulls_last("cnt"), "a")
    assert [(r.a, r.b) for r in stacked.collect()][:5] == [("one — brand", None), ("brand", COUNT_TITLE), ("X", "2"), ("Y", "1"), (None, None)]


def test_summary_workbook(spark, tmp_path):
    summary = group_summary({"s": frame(spark, ["x", "x", "y"])}, "v")
    write_blocks(stack_blocks(summary, "v"), str(tmp_path / "out"))
    book = read_sheet(spark, str(tmp_path / "out"), "SUMMARY", na_tokens=None, with_order=True)
    assert [tuple(r)[:2] for r in book.orderBy("_ord").collect()][:4] == [("s — v", None), ("v", COUNT_TITLE), ("X", "2"), ("Y", "1")]


def put(folder, name, text, encoding="utf-8"):
    (folder / name).write_text(text, encoding=encoding)
    return str(folder / name)


def test_three_years_merged(spark, tmp_path):
    paths = [
        put(tmp_path, "data2023.csv", "ID;Name\n1;a\n2;b\n"), put(tmp_path, "data2022.csv", "ID,Extra\n2,e\n 3 ,f\n"),
        put(tmp_path, "data2024.csv", "ID;Name\n3;c\n4;d\n"),
    ]
    merged = merge.merge_files(spark, paths, dedup_keys=["ID"], with_order=True).orderBy("_ord")
    assert [tuple(r)[:3] for r in merged.collect()] == [("1", "a", None), ("2", "b", None), ("3", None, "f"), ("4", "d", None)]
    filtered = merge.merge_files(spark, paths, [{"mode": "1", "column": "Name", "value": "B"}])
    # The file without the column keeps its rows: the filter is left out there.
    assert sorted(r.ID.strip() for r in filtered.collect()) == ["2", "2", "3"]
    rows = yearly_rows(spark, paths, [{"mode": "2", "column": "name", "value": "[bc]"}], columns="first")
    assert sorted((r.ID, r.Name, r._year) for r in rows.collect()) == [("2", "b", 2023), ("3", "c", 2024)]


def test_first_file_of_a_year_sets_its_columns(spark, tmp_path):
    paths = [put(tmp_path, "a2023.csv", "k,x\n1,p\n"), put(tmp_path, "b2023.csv", "k;y\n2;q\n"), put(tmp_path, "a2024.csv", "k;y\n3;r\n")]
    df = yearly_rows(spark, paths, columns="first")
    assert sorted((r.k, r.x, r.y) for r in df.collect()) == [("1", "p", None), ("2", None, None), ("3", None, "r")]


def test_file_jobs(spark, rows, tmp_path):
    path = put(tmp_path, "people.csv", "ID,Status\n1,Active\n2,active \n3,\n2,Gone\n")
    assert rows(file_jobs.frequency_of_file(spark, path, "status")) == [("ACTIVE", 2), ("GONE", 1)]
    assert rows(file_jobs.unique_of_file(spark, path, "B", case="lower")) == [("active",), ("gone",)]
    assert file_jobs.filter_file(spark, path, [{"mode": "1", "column": "Status", "value": "active"}]).count() == 2
    assert sorted(rows(file_jobs.dedup_file(spark, path, ["ID"], keep="last"))) == [("1", "Active"), ("2", "Gone"), ("3", None)]
    assert rows(file_jobs.preview_file(spark, path, 1)) == [("1", "Active")]
    facts = file_facts(spark, path).first()
    assert facts.bytes > 0 and (facts.encoding, facts.sep, facts.n_columns) == ("utf-8", ",", 2)
    with pytest.raises(ValueError):
        file_jobs.preview_file(spark, "x.xls")


def test_sheets_as_datasets(spark, tmp_path):
    folder = str(tmp_path / "sheets")
    df = frame(spark, ["a", "b"])
    assert [append_sheet(df, folder) for _ in range(3)] == ["UNIQUE", "UNIQUE (2)", "UNIQUE (3)"]
    assert sheet_names(folder) == ["UNIQUE", "UNIQUE (2)", "UNIQUE (3)"]
    assert read_appended(spark, folder, "UNIQUE (2)").count() == 2


def test_exported_sheets(spark, tmp_path):
    from gridloom.operators.ordering import split_sheets

    df = spark.range(10).selectExpr("cast(2023 + id % 2 as int) y", "id")
    split = split_sheets(df, "y", 3, "id")
    export_sheets(split, str(tmp_path / "x"), "workbook", force_text=["id"])
    got = {}
    for p in (tmp_path / "x").glob("*.xlsx"):
        got |= {s: [r.id for r in d.orderBy("_ord").collect()] for s, d in read_sheets(spark, str(p), with_order=True).items()}
    assert got == {"2023": ["0", "2", "4"], "2023 (2)": ["6", "8"], "2024": ["1", "3", "5"], "2024 (2)": ["7", "9"]}
    export_sheets(split, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("sheet = '2023 (2)'").count() == 2


def test_file_drop(spark, tmp_path):
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    inbox.mkdir()
    put(inbox, "d2023.csv", "k,v\n1,x\n2,y,z\n3,NA\n")

    def drain():
        df = file_drop.stream_csv(spark, str(inbox), ["k", "v"], files_per_batch=1)
        kept = file_drop.filter_stream(df, [{"mode": "5", "column": "K", "min": "1", "max": "9"}])
        file_drop.write_stream(kept, out, check).awaitTermination()
        return sorted((r.k, r.v, r._year) for r in spark.read.parquet(out).collect())

    assert drain() == [("1", "x", 2023), ("3", None, 2023)]
    put(inbox, "d2024.csv", "k,v\n4,w\n")
    assert drain() == [("1", "x", 2023), ("3", None, 2023), ("4", "w", 2024)]


def test_counters(spark):
    counted, seen = profile.count_rows(spark.range(10), "n", {"even": F.col("id") % 2 == 0})
    counted.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5}


def test_shared_folder_is_the_clusters(spark):
    assert shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_values_that_print_alike_are_one_group(spark):
    from gridloom.operators.summarize import frequency

    frame = spark.createDataFrame([(["a"], b"x"), (["A"], b"X"), (["b"], b"x")], "k array<string>, b binary")
    assert sorted(r.cnt for r in frequency(frame, "k").collect()) == [1, 2]
    assert [r.cnt for r in frequency(frame, "b").collect()] == [3]


def test_exact_profile_of_an_empty_table(spark):
    from gridloom.operators.profile import profile

    got = profile(spark.createDataFrame([], "a string, b int"), distinct="exact").orderBy("ordinal").collect()
    assert [(r.column, r.n_rows, r.non_null, r.n_distinct, r.longest) for r in got] == [("a", 0, 0, 0, 0), ("b", 0, 0, 0, 0)]


def test_merge_keeps_the_callers_order_of_mixed_sources(spark, tmp_path):
    from gridloom.sinks.workbook import write_workbooks

    folder = tmp_path / "dir"
    folder.mkdir()
    for i in range(3):
        put(folder, f"f{i}.csv", f"k,v\nsame,d{i}\nd{i},x\n")
    write_workbooks(spark.createDataFrame([("same", "book"), ("b", "x")], "k string, v string").coalesce(1), str(tmp_path / "books"))
    assert [p.name[:5] for p in (tmp_path / "books").iterdir() if p.name[0] not in "._"] == ["part-"]
    assert not list((tmp_path / "books").glob("_staged*"))
    paths = [str(folder), str(tmp_path / "books" / "*.xlsx"), put(tmp_path, "z.csv", "k,v\nsame,z\nz,x\n")]
    ordered = merge.merge_files(spark, paths, with_order=True).orderBy("_ord").collect()
    assert [r._ord.src for r in ordered] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert [r.v for r in ordered if r.k == "same"] == ["d0", "d1", "d2", "book", "z"]
    for given, keep, kept in ((paths, "last", "z"), (paths[1:], "first", "book")):
        merged = merge.merge_files(spark, given, dedup_keys=["k"], keep=keep)
        # Keys of kept rows come in their normal form, in capitals.
        assert merged.where("k = 'SAME'").first().v == kept


def test_sheets_appended_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "sheets")
    with ThreadPoolExecutor(8) as pool:
        names = list(pool.map(lambda i: append_sheet(spark.range(50 * i, 50 * i + 50, 1, 3), folder, "UNIQUE: all"), range(8)))
    assert sorted(names) == sorted(["UNIQUE: all", *(f"UNIQUE: all ({n})" for n in range(2, 9))]) == sorted(sheet_names(folder))
    for i, name in enumerate(names):
        assert sorted(r.id for r in read_appended(spark, folder, name).collect()) == list(range(50 * i, 50 * i + 50))
    assert append_sheet(spark.range(1), folder, "UNIQUE: all") == "UNIQUE: all (9)"
