"""Workbooks: codec, source, sink, sheet choice, union of sheets."""

import datetime as dt
import functools
import io
import zipfile

import pytest

from gridloom.sinks.workbook import csv_to_workbook, workbook_to_csv, write_workbooks
from gridloom.sinks.xlsx_writer import WorkbookWriter
from gridloom.sources.csv_files import read_csv
from gridloom.sources.workbook import choose_sheets, input_sheets, read_cells, read_sheet, read_sheets, sheet_catalog, unite_sheets
from gridloom.sources.xlsx_cells import Workbook


def book(path, sheets, **options):
    with open(path, "wb") as f:
        w = WorkbookWriter(f, **options)
        for name, (header, *rows) in sheets.items():
            w.start_sheet(name, header)
            w.write_rows(rows)
        w.close()
    return str(path)


def test_round_trip_of_awkward_text(tmp_path):
    cells = ["a<b>&\"c'", " padded ", "line\nbreak", "cr\rhere", "bell\x07", "_x0041_ literally", "ї", "", None, 5, 1.5, True]
    path = book(tmp_path / "a.xlsx", {"S": [["h"], *[[c] for c in cells], ["end"]]})
    with open(path, "rb") as f:
        got = [row[0] if row else None for _, row in Workbook(f).rows("S")]
    assert got == ["h", "a<b>&\"c'", " padded ", "line\nbreak", "cr\rhere", "bell\x07", "_x0041_ literally", "ї", "", None, "5", "1.5", "True", "end"]


def test_foreign_workbook_features():
    """Shared and rich strings, dates by style, errors, gaps, cached formula values."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        f'<Relationship Id="r1" Type="{rel}/worksheet" Target="/xl/worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        '<row r="4"><c r="A4" s="1"><v>44927</v></c><c r="B4" s="2"><v>44927.5</v></c><c r="C4" s="3"><v>2.5</v></c><c r="D4" t="e"><v>#N/A</v></c>'
        '<c r="E4" t="str"><f>A1</f><v>cached</v></c><c r="F4"><v>12.0</v></c><c r="G4" s="1"><v>0.25</v></c><c r="H4" t="b"><v>1</v></c></row>'
        '<row r="9"><c r="A9" s="1"/></row></sheetData></worksheet>',
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    buffer.seek(0)
    assert list(Workbook(buffer).rows("One")) == [
        (1, ["plain", None, "rich"]), (2, []), (3, []),
        (4, [str(dt.datetime(2023, 1, 1)), str(dt.datetime(2023, 1, 1, 12)), "2.5", None, "cached", "12", "06:00:00", "True"]),
    ]


def test_sheet_choice():
    names = ["Jan", "Feb", "UNIQUE", "unique (2)", "Uniques"]
    assert choose_sheets(names, "всі") == names == choose_sheets(names, None)
    assert choose_sheets(names, "1, Jan") == ["Feb", "Jan"]
    assert choose_sheets(names, "Jan,Mar", "ignore") == ["Jan"]
    for bad in ("9", "Mar"):
        with pytest.raises(KeyError):
            choose_sheets(names, bad)
    assert input_sheets(names, "UNIQUE") == ["Jan", "Feb", "Uniques"]


def test_choice_with_parts():
    names = ["F (10)", "F (2)", "F", "F (1)", "F (x)", "FF (2)", "P (3)", "2023 (2)"]
    assert choose_sheets(names, "F") == ["F"]
    assert choose_sheets(names, "P, F (2), F, 6", "ignore", parts=True) == ["P (3)", "F (2)", "F", "F (10)"]
    assert choose_sheets(names, "2", parts=True) == ["F", "F (2)", "F (10)"]
    for bad in ("9", "2023", "X"):
        with pytest.raises(KeyError):
            choose_sheets(names, bad, parts=True)


def test_query_reads_all_parts_of_its_sheets(spark, tmp_path, monkeypatch):
    """More rows of a status than a sheet holds; a status named like a part; no status."""
    import __spark_entry__ as entry

    statuses = [*["F"] * 23, *["P"] * 2, *["O"] * 5, *["F (2)"] * 3, *["F (x)"] * 3, None]
    spark.createDataFrame([(s, i, i % 3) for i, s in enumerate(statuses)], "o_orderstatus string, o_orderkey long, o_custkey long").write.parquet(
        str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(entry, "split_sheets", functools.partial(entry.split_sheets, cap=2))
    got = sorted(map(tuple, entry.queries()["sheet_selection"](spark, str(tmp_path)).collect()))
    assert got == sorted((s, str(i), str(i % 3)) for i, s in enumerate(statuses) if s in ("F", "P"))


@pytest.fixture
def registry(tmp_path):
    return book(tmp_path / "reg.xlsx", {
        "s1": [["N_REG-NEW", "VIN"], ["AA 1", "x"], ["AA-2", None]],
        "s2": [[" n reg new ", "Brand"], ["aa 1", "Ford"]],
        "s3": [["vin", "VIN", ""], ["z", "ignored", "blank header"]],
        "UNIQUE": [["N_REG-NEW"], ["own output"]],
    })


def test_catalog_and_partitions(spark, registry):
    assert [tuple(r)[2:] for r in sheet_catalog(spark, registry).orderBy("position").collect()] == [("s1", 0), ("s2", 1), ("s3", 2), ("UNIQUE", 3)]
    cells = read_cells(spark, [registry], ["s1", "s2"])
    assert cells.rdd.getNumPartitions() == 2
    assert cells.count() == 5


def test_united_sheets(spark, registry):
    df = unite_sheets(spark, registry, base="UNIQUE", with_order=True)
    assert df.columns == ["N_REG-NEW", "VIN", "Brand", "_ord"]
    assert [tuple(r)[:3] for r in df.orderBy("_ord").collect()] == [
        ("AA 1", "x", None), ("AA-2", None, None), ("aa 1", None, "Ford"), (None, "z", None)
    ]


def test_one_sheet_and_each_sheet(spark, registry):
    assert [tuple(r) for r in read_sheet(spark, registry).collect()] == [("AA 1", "x"), ("AA-2", None)]
    each = read_sheets(spark, registry, "s2,s3")
    assert each["s2"].columns == [" n reg new ", "Brand"] and each["s3"].columns == ["vin", "VIN", "Unnamed: 2"]


def test_sink_rolls_over_full_sheets(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(7).selectExpr("id", "cast(id as string) s").coalesce(1)
    from gridloom.sources.workbook import register

    register(spark)
    df.write.format("workbook").mode("append").option("sheet", "D").option("max_rows", 4).option("path", out).save()
    got = {s: df.count() for s, df in read_sheets(spark, out).items()}
    assert got == {"D": 3, "D (2)": 3, "D (3)": 1}


def test_conversions(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("id;name\n00012345678901;Ф\n2;\n", encoding="cp1251")
    csv_to_workbook(spark, str(source), str(tmp_path / "books"))
    back = read_sheet(spark, str(tmp_path / "books"))
    assert sorted(map(tuple, back.collect())) == [("00012345678901", "Ф"), ("2", None)]
    workbook_to_csv(spark, str(tmp_path / "books"), str(tmp_path / "csv"), encoding="cp1251", sep=";")
    again = read_csv(spark, str(tmp_path / "csv" / "*.csv"), sep=";")
    assert sorted(map(tuple, again.collect())) == [("00012345678901", "Ф"), ("2", None)]


def test_failed_write_leaves_nothing_visible(spark, tmp_path):
    bad = spark.range(3).selectExpr("case when id = 2 then repeat('x', 40000) else 'ok' end as v")
    with pytest.raises(Exception):
        write_workbooks(bad, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*.xlsx"))
