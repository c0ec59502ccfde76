"""One plan for all sheets against a plan for each sheet."""

import random
import warnings

import pytest

from gridloom.plans.group_summary import group_summary
from gridloom.plans.workbook_summary import workbook_summary
from gridloom.sources.workbook import read_sheets
from tests.test_workbook import book

BRANDS = ["audi", " Audi ", "BMW", "", None, "їжак", "bmw"]


def sheets_of(count):
    rng = random.Random(count)
    out = {}
    for i in range(count):
        header = ["Brand", "Price", "Id"]
        rng.shuffle(header)
        if i % 5 == 4:
            header.remove("Price")
        value = {"Brand": lambda: rng.choice(BRANDS), "Price": lambda: rng.choice([5, 10.5, "x", None, 700]), "Id": lambda: rng.randrange(12)}
        out[f"s{i}"] = [header, *[[value[h]() for h in header] for _ in range(30)]]
    out["odd"] = [["nothing"], ["?"]]
    return out


def nodes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


FILTERS = {
    "s0": [{"type": 5, "col_token": "price", "num_min": 1, "num_max": 100}], "s1": [{"type": 1, "col_token": "Brand", "eq_value": "bmw"}],
    "s2": [{"type": 3, "col_token": "Brand", "list_values": ["Audi", "їжак"]}, {"type": 5, "col_token": "price", "num_min": 1, "num_max": 100}],
    "s3": [{"type": 6, "col_token": "Id", "pattern": "1"}], "s4": [{"type": 5, "col_token": "price", "num_min": 1, "num_max": 9}],
}


@pytest.mark.parametrize("options", [
    {}, {"filters": FILTERS}, {"filters": [{"type": 2, "col_token": "Brand", "substr": "M"}], "overall_kind": "total"},
    {"dedup_keys": "Id", "kind": "unique"}, {"several": True, "column": "Brand,Id", "dedup_keys": "Id,Price", "filters": FILTERS},
])
def test_like_sheets_read_one_by_one(spark, tmp_path, options):
    path = book(tmp_path / "b.xlsx", sheets_of(6))
    options = {"column": "Brand", **options}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = workbook_summary(spark, path, **options)
        one_by_one = read_sheets(spark, path, na_tokens=None, with_order=True)
        want = group_summary(one_by_one, order_by="_ord" if "dedup_keys" in options else None, **options)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_the_plan_does_not_grow_with_sheets(spark, tmp_path):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        few = workbook_summary(spark, book(tmp_path / "few.xlsx", sheets_of(10)), "Brand", filters=FILTERS, dedup_keys="Id")
        many = workbook_summary(spark, book(tmp_path / "many.xlsx", sheets_of(60)), "Brand", filters={**FILTERS, **{f"s{i}": FILTERS["s2"] for i in range(9, 60)}}, dedup_keys="Id")
    assert nodes(many) == nodes(few) and len(many.select("block").distinct().collect()) == 61


def test_sheets_without_the_column(spark, tmp_path):
    path = book(tmp_path / "b.xlsx", {"a": [["x"], ["1"]], "b": [["Brand"], ["q"]]})
    with pytest.warns(UserWarning, match="'a' left out"):
        assert [tuple(r) for r in workbook_summary(spark, path, "Brand").where("block_no = 0").collect()] == [(0, "b — Brand", "Q", 1)]
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        workbook_summary(spark, path, "Missing", sheets="a")
