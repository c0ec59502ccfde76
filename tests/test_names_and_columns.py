"""Header names and column addressing; no Spark needed except for the column form."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import names
from gridloom.operators.columns import ColumnNotFound, reindex, rename_column, resolve_column, resolve_columns, resolve_positions, select_columns
from gridloom.operators.union import union_schema

CARS = ["Brand", "Model", "Year"]


def test_loose_name():
    assert names.norm_name(" VІN-code ") == "vincode" == names.norm_name("vin code")
    assert names.norm_name(None) == ""
    assert names.norm_name("АВЕ") == "abe"
    assert names.norm_name("ґ", "summary") == "ґ" and names.norm_name("ґ") == "g"


def test_header_forms():
    assert names.norm_header(" N_REG -NEW ") == "n_reg_new" == names.norm_header("n reg new", "compat")
    assert names.norm_header("Лід", "compat") == names.norm_header("Дід", "compat") == "i"
    assert names.norm_header("Лід") != names.norm_header("Дід")
    assert names.norm_header("ДЛЗ", "compat") == "" and names.norm_header("ДЛЗ") == "длз"
    assert names.norm_header(None) == ""


@pytest.mark.parametrize("norm", ["safe", "compat"])
def test_header_form_on_columns(spark, norm):
    raw = [" N_REG -NEW ", "Лід", "a__b--c", "_x_", "VІN №", "tab\there", "п'ять", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "h string").select(names.norm_header_column(F.col("h"), norm)).collect()]
    assert got == [names.norm_header(x, norm) for x in raw]


def test_letters():
    assert [names.letters_to_index(x) for x in ("A", "z", "AA", "xfd")] == [0, 25, 26, 16383]
    assert [names.index_to_letters(i) for i in (0, 25, 26, 16383)] == ["A", "Z", "AA", "XFD"]
    for bad in ("", "A1", "ABCD"):
        with pytest.raises(ValueError):
            names.letters_to_index(bad)


def test_free_names():
    assert names.free_name(["Jan"], "UNIQUE") == "UNIQUE"
    assert names.free_name(["UNIQUE", "UNIQUE (2)"], "UNIQUE") == "UNIQUE (3)"
    assert names.unique_headers(["a", "a", "", None, "a.1"]) == ["a", "a.1", "Unnamed: 2", "Unnamed: 3", "a.1.1"]
    assert names.canonical_headers([None, 5, "x"]) == ["", "5", "x"]


@pytest.mark.parametrize("token, want", [
    ("A", ["Brand"]), ("b:d", ["Model", "Year"]), ("D:B", ["Model", "Year"]), ("A,C", ["Brand", "Year"]),
    ("Brand,Model", ["Brand", "Model"]), ("brand, YEAR", ["Brand", "Year"]), ("ode", ["Model"]), (["Year", "A"], ["Year", "Brand"]),
])
def test_addressing(token, want):
    assert resolve_columns(CARS, token) == want


def test_single_column_rules():
    assert resolve_column(["ID", "B"], "ID") == "ID"
    assert resolve_column([f"c{i}" for i in range(300)], "ID") == "c237"
    assert resolve_column(["Client ID", "x"], "ID") == "Client ID"
    assert resolve_column(["", "N-1"], "n1") == "N-1"
    for bad in ("Price", "", " "):
        with pytest.raises(ColumnNotFound):
            resolve_column(CARS, bad)
    assert resolve_column(["VIN", " vin "], "Vin", "ci") == " vin "
    with pytest.raises(ColumnNotFound):
        resolve_column(CARS, "A", "ci")


def test_unknown_columns():
    assert resolve_columns(CARS, "Brand,Price", on_missing="skip") == ["Brand"]
    assert resolve_positions(CARS, "Year,nothing like it") == [2]
    for missing in ("error", "skip"):
        with pytest.raises(ColumnNotFound):
            resolve_columns(CARS, "Price", missing)


def test_projection_of_awkward_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, `c``d` int, `e f` int")
    assert select_columns(df, "A:B").columns == ["a.b", "c`d"]
    assert [tuple(r) for r in reindex(df, ["e f", "new", "a.b"]).collect()] == [(3, None, 1)]
    assert rename_column(df, "C", "G").columns == ["a.b", "c`d", "G"]


def test_union_schema():
    plan = union_schema([["N_REG-NEW", "VIN", "vin", ""], [" n reg new ", "Brand"], ["VІN"]])
    assert plan.display == ("N_REG-NEW", "VIN", "Brand")
    assert plan.positions == ((0, 1, None), (0, None, 1), (None, 0, None))


def test_header_forms_in_one_pass():
    assert names.norm_header("__a - ! -_b?c  ") == "a_bc" == names.norm_header("A__B?C", "compat")
    assert names.norm_header(" - ") == "" and names.norm_header("é_№5") == "é_5" and names.norm_header("é_№5", "compat") == "5"
    assert names.norm_name("\tA_b - C ") == "a_bc"
