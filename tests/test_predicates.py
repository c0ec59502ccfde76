"""Filters in every dialect, against rows chosen by hand or by Python's own re / pandas."""

import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions.numbers import to_numeric
from gridloom.functions.text import strip
from gridloom.operators import predicates
from gridloom.operators.membership import drop_members, keep_members
from gridloom.operators.predicates import Filter, apply_filters, filters_for, java_pattern, read_spec

PEOPLE = [
    ("1", "ann@gmail.com", " active ", "Ukraine", "25", "+380501", "1000"),
    ("2", "bob@mail.com", "ACTIVE", "poland", "25.0", "380502", "999,5"),
    ("3", None, None, "Germany", " 3 ", "+38", "5000"),
    ("4", "c@GMAIL.COM", "Inactive", " France", "x", None, "nan"),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "ID string, Email string, Status string, Country string, Age string, Phone string, Price string").cache()


def ids(df):
    return "".join(sorted(r.ID for r in df.collect()))


@pytest.mark.parametrize("spec, want", [
    ({"mode": "1", "column": "Status", "value": "Active"}, "12"),
    ({"mode": "1", "column": "Status", "value": "ACTIVE", "case": "keep"}, "2"),
    ({"mode": "1", "column": "Status", "value": " active ", "case": "lower", "strip_ws": False}, "1"),
    ({"mode": "1", "column": "Status", "value": ""}, "3"),
    ({"mode": "2", "column": "Email", "value": "@gmail.com"}, "14"),
    ({"mode": "2", "column": "Email", "value": ""}, "1234"),
    ({"mode": "2", "column": "Email", "value": ".*"}, ""),
    ({"mode": "3", "column": "Country", "values": ["Ukraine", "Poland", "Germany"]}, "123"),
    ({"mode": "3", "column": "Country", "values": [" France"]}, ""),
    ({"mode": "3", "column": "Country", "values": []}, ""),
    ({"mode": "3", "column": "Email", "values": [""]}, "3"),
    ({"mode": "4", "column": "Age", "value": "25"}, "12"),
    ({"mode": "4", "column": "Age", "value": "x"}, ""),
    ({"mode": "5", "column": "Price", "min": "1000", "max": "5000"}, "13"),
    ({"mode": "5", "column": "Price", "min": "", "max": "bad"}, "13"),
    ({"mode": "5", "column": "Price", "max": "4999,5"}, "1"),
    ({"mode": "6", "column": "Phone", "pattern": r"^\+38"}, "13"),
    ({"mode": "6", "column": "Phone", "pattern": r"(unclosed"}, "1234"),
    ({"mode": "6", "column": "Status", "pattern": "^A", "case": "upper"}, "12"),
    ({"mode": "0"}, "1234"), ({}, "1234"),
    ({"mode": "9", "column": "ID"}, "1234"),
    ({"mode": "1", "column": "nowhere", "value": "x"}, "1234"),
    ({"mode": "1", "column": "nowhere", "value": "x", "on_missing": "empty"}, ""),
])
def test_default_dialect(people, spec, want):
    assert ids(apply_filters(people, [spec])) == want


@pytest.mark.parametrize("dialect, spec, want", [
    ("worker", {"mode": "1", "column": "status", "value": "ACTIVE"}, "2"),
    ("worker", {"mode": "2", "column": "Email", "value": "GMAIL.COM"}, "14"),
    ("worker", {"mode": "2", "column": "Email", "value": "^.@g"}, "4"),
    ("worker", {"mode": "3", "column": "Country", "values": ["UKRAINE", "Poland"]}, "12"),
    ("worker", {"mode": "4", "column": "Age", "value": "25,0"}, ""),
    ("worker", {"mode": "5", "column": "Price", "min": "2000", "max": "x"}, "13"),
    ("worker", {"mode": "6", "column": "Email"}, "1234"),
    ("worker", {"mode": "1", "column": "nowhere", "value": "x"}, ""),
    ("unify", {"mode": "2", "column": " EMAIL ", "value": ".com"}, "124"),
    ("unify", {"mode": "5", "column": "Price", "min": "999,5", "max": "x"}, "123"),
    ("unify", {"mode": "4", "column": "Price", "value": "999.5"}, "2"),
    ("unify", {"mode": "1", "column": "nowhere", "value": "x"}, "1234"),
    ("summary", {"type": 3, "col_token": "D", "list_values": ["poland"]}, "2"),
    ("summary", {"type": 5, "col_token": "Price", "num_min": 2000.0, "num_max": "x"}, "13"),
    ("summary", {"type": 4, "col_token": "Age", "num_eq": math.nan}, ""),
    ("summary", {"type": 6, "col_token": "Status", "pattern": "^INA"}, "4"),
])
def test_other_dialects(people, dialect, spec, want):
    assert ids(apply_filters(people, [spec], dialect)) == want


def test_chain_order_does_not_matter(people):
    chain = [{"mode": "2", "column": "Email", "value": "mail"}, {"mode": "4", "column": "Age", "value": 25}]
    assert ids(apply_filters(people, chain)) == "12" == ids(apply_filters(people, chain[::-1]))


def test_policies(people):
    with pytest.raises(KeyError):
        apply_filters(people, [Filter("eq", "nowhere", on_missing="error")])
    with pytest.raises(re.error):
        apply_filters(people, [Filter("regex", "ID", "(", on_bad_pattern="error")])
    assert filters_for({"a": [1]}, "a") == [1] and filters_for({"a": [1]}, "b") == () and filters_for([2], "b") == [2]
    assert read_spec(Filter("eq")).kind == "eq"


def test_long_list_becomes_a_join(people, monkeypatch):
    monkeypatch.setattr(predicates, "MAX_LITERALS", 1)
    df = apply_filters(people, [{"mode": "3", "column": "Country", "values": ["ukraine", "POLAND"]}])
    assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()
    assert ids(df) == "12"


def test_membership(spark, people):
    listed = spark.createDataFrame([("ACTIVE",), ("ACTIVE",), (None,)], "v string")
    assert ids(keep_members(people, "Status", listed)) == "123"
    assert ids(drop_members(people, "Status", listed)) == "4"


def test_typed_bounds_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as double) x", "cast(id as string) s").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))

    def pushed(spec):
        plan = apply_filters(t, [spec])._jdf.queryExecution().executedPlan().toString()
        return plan.split("PushedFilters: [")[1].split("]")[0]

    assert "GreaterThanOrEqual(id,3)" in pushed({"mode": "5", "column": "id", "min": "2.5", "max": ""})
    assert "EqualTo(id,4)" in pushed({"mode": "4", "column": "id", "value": "4"})
    assert "LessThanOrEqual(x,7.5)" in pushed({"mode": "5", "column": "x", "max": "7,5"})
    assert "EqualTo(s,5)" in pushed({"mode": "1", "column": "s", "value": "5", "case": "keep", "strip_ws": False})
    assert apply_filters(t, [{"mode": "4", "column": "id", "value": "2.5"}]).count() == 0
    assert apply_filters(t.selectExpr("id", "case when id=1 then double('nan') else x end x"), [{"mode": "5", "column": "x"}]).count() == 9


def test_numbers_like_pandas(spark):
    random.seed(3)
    cells = ["1", " 2 ", "1e3", "inf", "-Infinity", ".5", "5.", "+3", "1,5", "1_000", "0x10", "0x1p3", "True", "1d", "1f", "1D", "1 2",
             "nan", "NaN", "", " 7", "1e400", " inf", "--1", "1e", ".", "\t4\n", "007", "1.5e-3", None]
    cells += ["".join(random.choice("0123456789.,eE+- dfxX_") for _ in range(random.randint(1, 7))) for _ in range(1500)]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(to_numeric(F.col("c"))).collect()]
    for cell, mine in zip(cells, got):
        want = pd.to_numeric(pd.Series([cell], dtype=object), errors="coerce")[0]
        want = None if want is None or pd.isna(want) or (math.isinf(want) and "in" not in str(cell)) else float(want)
        assert mine == want, cell


def test_strip_like_python(spark):
    random.seed(4)
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["​", "﻿"]
    cells = ["".join(random.choice([*blanks, "x", "ї", " "]) for _ in range(random.randint(0, 6))) for _ in range(800)]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(strip(F.col("c"))).collect()]
    assert got == [c.strip() for c in cells]


def test_regex_like_python(spark):
    patterns = [r"^\w+$", r"\d{2}", r"(?P<a>x)(?P=a)", r"end\Z", r"^a.c$", r"[А-Я]ї", r"\bкіт\b", r"a&&b", r"[a[b]", r"(?i)ЇЖАК", r"(x)?(?(1)y|z)", r"\\Z", r"(?P<a_b>q)", r"[\w&&x]", r"x{,2}$", r"{id}", r"[]x]", r"[^]x]", r"[\b]", r"x{1,2}", r"\v"]
    cells = ["кіт", "xx", "the end", "end\n", "a\nc", "a\rc", "abc", "Мї", "їжак", "xy", "z", "y", "12", "٣٤", "a&&b", "[", "b", "q", "\\Z", " ", "", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    for p in patterns:
        got = {r.i for r in df.where(predicates.regex_search(F.col("c"), p)).collect()}
        assert got == {i for i, c in enumerate(cells) if c is not None and re.search(p, c)}, p
    assert java_pattern(r"a&&b") is None and java_pattern(r"(?P<n>x)") == "(?Ud)(?<n>x)"
