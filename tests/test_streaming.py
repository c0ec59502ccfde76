"""Arriving files against the batch reader, and deduplication that remembers."""

import random

import pytest

from gridloom.sources.csv_files import read_csv
from gridloom.streaming import file_drop, key_ledger
from tests.test_csv import put

HARD = [
    ("quoted 2021.csv", 'id,name,x\n1,"a\nb",p\n2,"q ""r"" \n\n s",\n3,19" monitor,z\n4,"late"\n', "utf-8"),
    ("cyrillic 2022.csv", "x;назва;id;name\nп;ж;5;«ї»\nк;л;6;NA\n", "cp1251"),
    ("ragged 2023.csv", "name|id\na|7\nb\nc|8|\nd|9|more\n\n|\ne|10\n", "utf-8"),
    ("ends 2024.csv", 'id\tname\r\n11\t"u\r\nv"\r\n\t\r\n12\tw\r\n', "utf-8-sig"),
    ("macs 2020.csv", 'id,name\r13,"x\ry"\r14,z\r', "utf-8"),
    ("header only 2019.csv", "id,name\n", "utf-8"),
]


@pytest.mark.parametrize("stretch", [7, 1 << 20])
def test_a_stream_reads_what_the_batch_reader_reads(spark, tmp_path, stretch):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for name, text, encoding in HARD:
        put(inbox, name, text, encoding)
    columns = ["name", "id", "x", "назва"]
    arriving = file_drop.stream_csv(spark, str(inbox), columns, files_per_batch=2, with_file=True, with_order=True, stretch=stretch)
    file_drop.write_stream(arriving, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = [(r._file.rsplit("/", 1)[-1].replace("%20", " "), r._year, *(r[c] for c in columns)) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("_ord").collect()]
    batch = read_csv(spark, str(inbox), with_order=True, with_file=True, with_year=True)
    want = [(r._file.rsplit("/", 1)[-1].replace("%20", " "), r._year, *(r[c] for c in columns)) for r in batch.orderBy("_ord").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 15
    for name, _, _ in HARD:
        assert [r for r in got if r[0] == name] == [r for r in want if r[0] == name]


@pytest.mark.parametrize("data,message", [("a,b\n1,Київ\n".encode() + "2,Київ\n".encode("cp1251"), "is not utf-8"), (b"a,b\n1,2\r3,4\n", "mixes line ends")])
def test_a_stream_refuses_what_the_batch_reader_refuses(spark, tmp_path, data, message):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "d2020.csv").write_bytes(data)
    arriving = file_drop.stream_csv(spark, str(inbox), ["a", "b"], sep=",", encoding="utf-8")
    with pytest.raises(Exception, match=message):
        file_drop.write_stream(arriving, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()


def test_rows_seen_before_are_absent(spark, tmp_path):
    rng = random.Random(3)
    ledger = key_ledger.KeyLedger(str(tmp_path / "rows"), ["K", "n"], drop_dashes=True)
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    with pytest.raises(ValueError):
        ledger.rows(spark)
    seen, want, number = set(), set(), 0

    def drain():
        arriving = file_drop.stream_csv(spark, str(inbox), ["k", "n", "v"], sep=",", files_per_batch=1, with_order=True).drop("_year")
        key_ledger.unify_stream(arriving, ledger, str(tmp_path / "check")).awaitTermination()
        return {tuple(r) for r in ledger.rows(spark).collect()}

    for drop in range(3):
        lines = []
        for _ in range(200):
            number += 1
            # A third of all rows have one key; some differ from others in case and dashes only.
            k, n = ("hot", "1") if rng.random() < 0.33 else (rng.choice(["a-b", "AB", "x", " X", "y", "ї-1"]) + str(rng.randrange(20)), rng.choice(["", "2"]))
            lines.append((k, n, f"v{number}"))
        put(inbox, f"d{drop}.csv", "k,n,v\n" + "".join(",".join(x) + "\n" for x in lines))
        for k, n, v in lines:
            key = (k.strip().upper().replace("-", ""), n)
            if key not in seen:
                seen.add(key)
                want.add((k, n or None, v))
        assert drain() == want
    # Starting again changes nothing, nor does a portion that is done once more.
    assert drain() == want
    again = read_csv(spark, str(inbox / "d1.csv"), sep=",", with_order=True)
    ledger.add(again, 1)
    assert {tuple(r) for r in ledger.rows(spark).collect()} == want


def test_portions_of_batch_runs(spark, tmp_path):
    ledger = key_ledger.KeyLedger(str(tmp_path / "rows"), ["k"])
    for portion, text in enumerate(["k,v\na,1\nb,2\na,3\n", "k,v\nB,4\nc,5\n,6\n", "k,v\n,7\n"]):
        ledger.add(read_csv(spark, put(tmp_path, f"p{portion}.csv", text), sep=",", with_order=True), portion)
    assert sorted(map(tuple, ledger.rows(spark).collect()), key=str) == sorted([("a", "1"), ("b", "2"), ("c", "5"), (None, "6")], key=str)
