"""Damaged semicolon files."""

from gridloom.sources.semicolon import read_semicolon, type_cells


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def in_order(df):
    return [tuple(r) for r in df.orderBy("_ord").drop("_ord").collect()]


DIRTY = 'a;b\n«x;y»;1\n"l1\nl2";2\n"a""b";3\n5;6;7;8\n'
WANT = [("x;y", "1", None), ("l1\nl2", "2", None), ('a"b', "3", None), ("5", "6", ["7", "8"])]


def test_dirty_file(spark, tmp_path):
    df = read_semicolon(spark, put(tmp_path, "d.csv", DIRTY), with_order=True)
    assert df.columns == ["a", "b", "_extra", "_ord"]
    assert in_order(df) == WANT


def test_dirty_file_in_tiny_splits(spark, tmp_path):
    body = "".join(f'{i};"open\n{"x;" * (i % 5)}\nclose"\n' if i % 3 == 0 else f"{i};v\n" for i in range(60))
    path = put(tmp_path, "d.csv", "k;v\n" + body)
    want = [(str(i), f"open\n{'x;' * (i % 5)}\nclose" if i % 3 == 0 else "v", None) for i in range(60)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert in_order(read_semicolon(spark, path, with_order=True)) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_apostrophes(spark, tmp_path):
    path = put(tmp_path, "p.csv", "слово;n\nп'ять;1\nшість;2\n")
    assert in_order(read_semicolon(spark, path, with_order=True)) == [("п'ять", "1", None), ("шість", "2", None)]
    assert read_semicolon(spark, path, apostrophe_as_quote=True).count() == 1


def test_backslash_quote_and_unclosed_last_record(spark, tmp_path):
    path = put(tmp_path, "u.csv", 'a;b\n"x \\"y\\" z";1\n2;"never closed\nat all\n')
    assert in_order(read_semicolon(spark, path, with_order=True)) == [('x "y" z', "1", None), ("2", "never closed\nat all", None)]


def test_typed_cells(spark, tmp_path):
    path = put(tmp_path, "t.csv", "v;N_REG_NEW\n" + "".join(f"{v};007\n" for v in ["12345678901", "007", "1,5", "-2", "1234567890.123456", " ", "x"]))
    rows = [(r.v.txt, r.v.num, r.N_REG_NEW.txt, r.N_REG_NEW.num) for r in type_cells(read_semicolon(spark, path, with_order=True)).orderBy("_ord").collect()]
    assert [r[:2] for r in rows] == [
        ("12345678901", None), (None, 7.0), (None, 1.5), (None, -2.0), ("1234567890.123456", None), ("", None), ("x", None)
    ]
    assert {r[2:] for r in rows} == {("007", None)}


def test_encodings_per_file(spark, tmp_path):
    paths = [put(tmp_path, "a.csv", "назва;n\nПриклад;1\n", "cp1251"), put(tmp_path, "b.csv", "назва;n\nЇжак;2\n", "utf-8")]
    assert in_order(read_semicolon(spark, paths, with_order=True)) == [("Приклад", "1", None), ("Їжак", "2", None)]


def test_carriage_returns_in_cells_stay(spark, tmp_path):
    path = put(tmp_path, "r.csv", "a;b\r\n«x\r\ny»;1\r\nz;2\r\n")
    assert in_order(read_semicolon(spark, path, with_order=True)) == [("x\r\ny", "1", None), ("z", "2", None)]
