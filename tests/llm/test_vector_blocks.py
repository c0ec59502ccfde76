"""Blocks of cells: what the multi-index writes does not grow with the visits, and links across blocks are found."""

import os

import numpy as np
import pytest

from gridloom.llm import multi_index
from gridloom.session import shared_folder


def linked(x, threshold):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (unit @ unit.T >= threshold).sum(axis=1) - 1


def frame(spark, x, label=0):
    rows = [(i, v.tolist(), label) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)


def written(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_disk_does_not_grow_with_the_visits(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "WORDS", (32, 1_024))
    x = np.random.default_rng(4).normal(size=(3_000, 64)).astype(np.float32)
    x[2_000:] = x[:1_000] + 0.05 * x[1_000:2_000]
    folder = shared_folder(spark)
    before = written(folder)
    got = {r.vec_id: r.n_links for r in multi_index.near_duplicates(frame(spark, x)).collect()}
    assert written(folder) - before < 2 * x.nbytes
    want = linked(x.astype(np.float64), multi_index.THRESHOLD)
    assert [got[i] for i in range(len(x))] == want.tolist() and want.sum() > 1_000


@pytest.mark.parametrize("held", [16 * 40, 16 * 150, 1 << 22])
def test_links_across_blocks(spark, monkeypatch, held):
    """Near copies lie in one cell, which several blocks hold; other links cross cells."""
    monkeypatch.setattr(multi_index, "HELD", (held, held))
    monkeypatch.setattr(multi_index, "FEW", 2)
    monkeypatch.setattr(multi_index, "EDGES", 50)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16))
    x[:200] = x[0] + 0.02 * rng.normal(size=(200, 16))
    x[200:700] = np.repeat(x[200:250], 10, axis=0) + 0.13 * rng.normal(size=(500, 16))
    x = x.astype(np.float32).astype(np.float64)
    got = {r.vec_id: r for r in multi_index.near_duplicates(frame(spark, x)).collect()}
    want = linked(x, multi_index.THRESHOLD)
    assert [got[i].n_links for i in range(len(x))] == want.tolist()
    assert {got[i].component_id for i in range(200)} == {0}
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_two_blocks_meet_once():
    ranges = multi_index.Ranges([(0, 3, 0, 0), (4, 9, 1, 1), (10, 10, 2, 4), (12, 20, 4, 4)])
    cells = np.array([0, 3, 5, 10, 10, 10, 12, 19])
    home = ranges.home(cells, np.arange(len(cells)))
    assert home.tolist()[:3] == [0, 0, 1] and set(home[3:6].tolist()) <= {2, 3, 4} and home.tolist()[6:] == [4, 4]
    row, block = ranges.visited(np.repeat(np.arange(8), 21), np.tile(np.arange(21), 8), home)
    sent = {(int(home[r]), int(b)) for r, b in zip(row, block)}
    blocks = sorted(set(home.tolist()))
    assert all(((a, b) in sent) != ((b, a) in sent) for a in blocks for b in blocks if a != b)
    assert len(set(zip(row.tolist(), block.tolist()))) == len(row)
    # Cell 11 holds nothing, so nobody is sent to a block for it.
    assert len(ranges.visited(np.array([0]), np.array([11]), np.array([0]))[0]) == 0
