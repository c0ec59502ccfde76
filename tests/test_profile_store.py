"""Stored profiles against a profile of all files at once."""

import os

from gridloom.operators.profile import profile
from gridloom.plans.profile_store import profile_files
from gridloom.sources.csv_files import read_csv
from tests.test_csv import put


def facts(df):
    return sorted(tuple(r) for r in df.collect())


def test_files_are_read_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    paths = [put(inbox, f"f{i}.csv", "k,v\n" + "".join(f"{j % (10 + i)},{'x' * j}\n" for j in range(40))) for i in range(3)]
    paths.append(put(inbox, "g.csv", "v;w\nlong one;\nb;NA\n", "cp1251"))
    paths.append(put(inbox, "h.csv", "k,v\n"))
    store = str(tmp_path / "store")
    want = facts(profile(read_csv(spark, paths), distinct="exact"))
    assert facts(profile_files(spark, paths, store)) == want
    # Known files are not opened: their bytes are no text any more, their size and time of change are as before.
    for path in paths[:3]:
        was = os.stat(path)
        with open(path, "r+b") as file:
            file.write(b"\xff" * was.st_size)
        os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns))
    assert facts(profile_files(spark, paths, store)) == want
    more = put(inbox, "i.csv", "k,z\n99,1\n98,\n")
    got = {r.column: (r.ordinal, r.n_rows, r.non_null, r.n_distinct) for r in profile_files(spark, [*paths, more], store).collect()}
    assert got == {"k": (1, 124, 122, 14), "v": (2, 124, 119, 41), "w": (3, 124, 0, 0), "z": (4, 124, 1, 1)}
    # A part of the set is merged from what is known.
    assert {r.column: r.n_rows for r in profile_files(spark, paths[:1], store).collect()} == {"k": 40, "v": 40}
