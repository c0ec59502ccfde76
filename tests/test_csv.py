"""CSV ingest on small hand-written files."""

import io

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.sources.csv_files import detect, read_csv
from gridloom.sources.sniff import guess_separator


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def in_order(df):
    return [tuple(r) for r in df.orderBy("_ord").drop("_ord").collect()]


def check_like_pandas(spark, path, **options):
    got = in_order(read_csv(spark, path, with_order=True, **options))
    want = pd.read_csv(path, dtype=str, engine="python", on_bad_lines="skip", **options)
    want = [tuple(None if pd.isna(x) else x for x in r) for r in want.itertuples(index=False)]
    assert got == want
    return got


def test_ragged(spark, tmp_path):
    path = put(tmp_path, "r.csv", 'a,b,c\n1,2\n1,2,3\n1,2,3,4\n\n"x,y",2,3\n')
    assert check_like_pandas(spark, path, sep=",") == [("1", "2", None), ("1", "2", "3"), ("x,y", "2", "3")]


def test_trailing_separator_is_one_field_too_many(spark, tmp_path):
    path = put(tmp_path, "t.csv", "a,b,c\n1,2,3\n1,2,3,\n4,5,6\n")
    df = read_csv(spark, path, sep=",")
    assert sorted(r.a for r in df.select("a").collect()) == ["1", "4"]
    assert df.count() == 2
    assert sorted(tuple(r) for r in df.groupBy("a").count().collect()) == [("1", 1), ("4", 1)]


def test_first_row_long(spark, tmp_path):
    assert read_csv(spark, put(tmp_path, "l.csv", "a,b\n1,2,3\n4,5,6\n"), sep=",").count() == 0


def test_missing_value_tokens(spark, tmp_path):
    tokens = ["NA", "N/A", "null", "NULL", "None", "nan", "NaN", "#N/A", "n/a", "<NA>", "", '"NA"']
    kept = ["-", "none", "Nan"]
    path = put(tmp_path, "n.csv", "k,v\n" + "".join(f"{i},{t}\n" for i, t in enumerate(tokens + kept)))
    got = [v for _, v in check_like_pandas(spark, path, sep=",")]
    assert got == [None] * len(tokens) + kept


def test_duplicate_and_blank_headers(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "d.csv", "a,a,,b\n1,2,3,4\n"), sep=",")
    assert df.columns == ["a", "a.1", "Unnamed: 2", "b"]
    assert [tuple(r) for r in df.collect()] == [("1", "2", "3", "4")]


def test_byte_order_mark(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "b.csv", "﻿a,b\n1,2\n"))
    assert df.columns == ["a", "b"] and df.count() == 1


def test_cp1251(spark, tmp_path):
    path = put(tmp_path, "c.csv", "назва;ціна\nПриклад;1,5\nЇжак «№»;2\n", "cp1251")
    assert detect(spark, path)[0][1].encoding == "cp1251"
    df = read_csv(spark, path)
    assert df.columns == ["назва", "ціна"]
    assert {tuple(r) for r in df.collect()} == {("Приклад", "1,5"), ("Їжак «№»", "2")}


@pytest.mark.parametrize("sep", [",", ";", "\t", "|", ":"])
def test_separator_detected(sep):
    assert guess_separator(f"a{sep}b{sep}c\n1{sep}2{sep}3\n4{sep}5{sep}6\n") == sep


def test_times_do_not_win_over_commas():
    assert guess_separator("t,v\n10:11:12,1\n10:12:13,2\n") == ","


def test_quoted_line_breaks(spark, tmp_path):
    text = 'a,b\n1,"x\ny"\n2,"p\n\nq,""r"""\n3,19" monitor\n4,z\n"5\n","w"\n'
    got = check_like_pandas(spark, put(tmp_path, "q.csv", text), sep=",")
    assert got[0] == ("1", "x\ny") and got[2] == ("3", '19" monitor')


def test_quoted_line_breaks_across_many_splits(spark, tmp_path):
    # Tiny splits: records start, run through and end in different splits.
    lines = ["a,b"]
    for i in range(150):
        lines.append(f'{i},"line {i}\n{"mid" * (i % 40)}\n, end"' if i % 7 == 0 else f'"{i}","v{i}"' if i % 3 else f"{i},plain")
    path = put(tmp_path, "m.csv", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        check_like_pandas(spark, path, sep=",")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_repeated_header_line_is_data(spark, tmp_path):
    path = put(tmp_path, "h.csv", "\na,b\n1,2\na,b\n3,4\n")
    assert check_like_pandas(spark, path, sep=",") == [("1", "2"), ("a", "b"), ("3", "4")]


def test_tab_rows_of_missing_cells_stay(spark, tmp_path):
    path = put(tmp_path, "t.csv", "a\tb\tc\n1\t2\t3\n\t\t\n \n4\t5\t6\n")
    assert check_like_pandas(spark, path, sep="\t")[1] == (None, None, None)


def test_many_files_with_different_layouts(spark, tmp_path):
    paths = [
        put(tmp_path, "data2024.csv", "ID;b\n1;x\n2;y\n", "cp1251"),
        put(tmp_path, "data2022.csv", "ID,c,B\n3,p,q\n"),
        put(tmp_path, "old data [1].csv", "ID;b\n9;ї\n", "cp1251"),
    ]
    df = read_csv(spark, paths, with_order=True, with_file=True, with_year=True, years={"old data [1].csv": 1999})
    assert df.columns == ["ID", "b", "c", "B", "_ord", "_file", "_year"]
    got = [(r[0], r[1], r[2], r[3], r[6]) for r in df.orderBy("_ord").collect()]
    assert got == [("1", "x", None, None, 2024), ("2", "y", None, None, 2024), ("3", None, "p", "q", 2022), ("9", "ї", None, None, 1999)]
    assert [f.rsplit("/", 1)[-1] for f in (r._file for r in df.orderBy("_ord").collect())][-1] == "old data [1].csv"
    with pytest.raises(ValueError):
        read_csv(spark, paths, with_year=True)


def test_header_only_file_reads_as_no_rows(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "e.csv", "a,b\n"), sep=",")
    assert df.columns == ["a", "b"] and df.count() == 0


def test_header_longer_than_the_head(spark, tmp_path):
    names = [f"column_{i}_" + "x" * 400 for i in range(200)]
    path = put(tmp_path, "w.csv", ",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    df = read_csv(spark, path, sep=",")
    assert df.columns == names
    assert df.select(F.col(names[-1])).first()[0] == "1"


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
def test_carriage_returns_in_cells_stay(spark, tmp_path, newline):
    cell = "x\r\ny" if newline != "\r" else "x\ry"
    text = newline.join(["a,b", f'1,"{cell}"', '2,"p\nq"', "3,z", ""])
    df = read_csv(spark, put(tmp_path, "c.csv", text), sep=",", with_order=True)
    assert in_order(df) == [("1", cell), ("2", "p\nq"), ("3", "z")]


def test_lone_carriage_return_in_a_cell_stays(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "c.csv", 'a,b\n1,"c\rd"\n2,e\n'), sep=",", with_order=True)
    assert in_order(df) == [("1", "c\rd"), ("2", "e")]


def test_late_bytes_of_another_encoding_fail(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"a,b\n" + b"1,plain\n" * 12_000 + "2,Київ\n".encode("cp1251"))
    with pytest.raises(ValueError, match="late.csv is not utf-8: 1 lines"):
        read_csv(spark, str(path))
    assert read_csv(spark, str(path), encoding="cp1251").where("a = '2'").first().b == "Київ"


def test_mixed_line_ends_outside_quotes_fail(spark, tmp_path):
    with pytest.raises(ValueError, match="mixes line ends"):
        read_csv(spark, put(tmp_path, "m.csv", "a,b\n1,2\r3,4\n"), sep=",")
