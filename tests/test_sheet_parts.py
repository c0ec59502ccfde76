"""A sheet read in parts against the sheet read whole."""

import io
import os
import random
import zipfile

import pytest

from gridloom.sources.workbook import read_cells, sheet_headers, unite_sheets
from gridloom.sources.xlsx_cells import Workbook
from tests.test_workbook import book

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def archive(rows, prefix="", shared=None):
    x = f"{prefix}:" if prefix else ""
    names = f'xmlns{":" + prefix if prefix else ""}="{NS}"'
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{NS}" xmlns:r="{REL}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        f'<Relationship Id="r1" Type="{REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<{x}worksheet {names}><{x}cols/><{x}sheetData>{"".join(rows)}</{x}sheetData><{x}pageMargins/></{x}worksheet>',
    }
    if shared:
        parts["xl/sharedStrings.xml"] = shared
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    buffer.seek(0)
    return buffer


def in_parts(stream, size):
    whole = Workbook(stream)
    total, got = whole.size("S"), []
    for low in range(0, total, size):
        got += list(Workbook(stream).rows("S", low, low + size if low + size < total else None))
    return list(whole.rows("S")), got


def some_rows(seed, numbered, prefix=""):
    rng, x, rows, number = random.Random(seed), f"{prefix}:" if prefix else "", [], 0
    for _ in range(120):
        number += rng.choice([1, 1, 1, 4])
        place = f' r="{number}"' if numbered == "all" or numbered == "some" and rng.random() < 0.3 else ""
        kind = rng.random()
        if kind < 0.2:
            rows.append(f"<{x}row{place}/>")
        elif kind < 0.4:
            rows.append(f'<{x}row{place} spans="1:2"><{x}c/><{x}c s="1"/></{x}row>')
        else:
            rows.append(f'<{x}row{place}><{x}c t="inlineStr"><{x}is><{x}t>{"é&amp;" * rng.randrange(9)}</{x}t></{x}is></{x}c><{x}c><{x}v>{number}</{x}v></{x}c></{x}row>')
    return rows + [f"<{x}row/>"] * rng.randrange(4)


@pytest.mark.parametrize("numbered", ["all", "none", "some"])
@pytest.mark.parametrize("prefix", ["", "x"])
@pytest.mark.parametrize("size", [1, 64, 333, 5_000])
def test_parts_make_the_sheet(numbered, prefix, size):
    for seed in range(3):
        whole, got = in_parts(archive(some_rows(seed, numbered, prefix), prefix), size * (20 if size == 1 else 1))
        assert got == whole and len(whole) > 100


def test_blank_parts_and_empty_sheets():
    blank = ['<row r="1"><c><v>1</v></c></row>', *[f'<row r="{i}"><c/></row>' for i in range(2, 60)]]
    for rows in (blank, [*blank, '<row r="90"><c><v>2</v></c></row>'], blank[1:], []):
        for size in (30, 100, 2_000):
            whole, got = in_parts(archive(rows), size)
            assert got == whole
    assert len(whole) == 0


def test_shared_strings_are_parsed_when_asked_for():
    items = ["<si><t>plain</t></si>", "<si><t>a &amp; b</t></si>", '<si><t xml:space="preserve"> x </t></si>', "<si><r><t>ri</t></r><r><t>ch</t></r></si>", "<si/>", "<si><t>_x0041_</t></si>"]
    rows = [f'<row r="{i + 1}"><c t="s"><v>{i}</v></c></row>' for i in range(len(items))]
    stream = archive(rows, shared=f'<?xml version="1.0"?><sst xmlns="{NS}" count="6">{"".join(items)}</sst>')
    assert [c for _, c in Workbook(stream).rows("S")] == [["plain"], ["a & b"], [" x "], ["rich"], [""], ["A"]]


def test_a_sheet_is_read_by_several_tasks(spark, tmp_path):
    path = book(tmp_path / "b.xlsx", {"one": [["h", "n"], *[[f"v{i}", i] for i in range(3_000)]], "two": [["h"], ["x"]]})
    cells = read_cells(spark, [path], part=20_000)
    assert cells.rdd.getNumPartitions() > 8
    got = sorted((r.sheet, r.row_no, tuple(r.cells)) for r in cells.collect())
    assert got == [("one", 1, ("h", "n")), *[("one", i + 2, (f"v{i}", str(i))) for i in range(3_000)], ("two", 1, ("h",)), ("two", 2, ("x",))]
    assert [r.row_no for r in read_cells(spark, [path], ["one"], 2, 20_000).collect()] == [1, 2]
    direct = spark.read.format("workbook").option("files", path).load()
    assert direct.count() == 3_003


def test_a_manifest_opens_known_books_no_more(spark, tmp_path):
    paths = [book(tmp_path / f"b{i}.xlsx", {"S": [["k", f"c{i}"], ["x", i]], "T": [["k"], ["y"]]}) for i in range(5)]
    manifest = str(tmp_path / "manifest")
    first = sheet_headers(spark, paths, manifest=manifest)
    assert first == sheet_headers(spark, paths) and len(first) == 10
    # Known books are not opened: these bytes are no workbook, but size and time of change are as before.
    for path in paths[:4]:
        was = os.stat(path)
        with open(path, "r+b") as file:
            file.write(b"\0" * was.st_size)
        os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns))
    more = book(tmp_path / "b9.xlsx", {"U": [["new"]]})
    again = sheet_headers(spark, [*paths, more], manifest=manifest)
    assert again[:10] == first and [(s.sheet, h) for s, h in again[10:]] == [("U", ["new"])]
    # A book that has changed is read anew.
    book(paths[4], {"S": [["other", "header"], ["x", "y"]]})
    os.utime(paths[4], ns=(1, 10 ** 18))
    assert [(s.sheet, h) for s, h in sheet_headers(spark, [paths[4]], manifest=manifest)] == [("S", ["other", "header"])]
    assert [tuple(r) for r in unite_sheets(spark, [paths[4]], manifest=manifest).collect()] == [("x", "y")]
