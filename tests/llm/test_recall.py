"""Links of the multi-index where differences are concentrated: few dimensions, one component, data in a plane of many dimensions."""

import numpy as np
import pytest

from gridloom.llm import multi_index


def linked(x, threshold):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (unit @ unit.T >= threshold).sum(axis=1) - 1


def cases():
    rng = np.random.default_rng(8)
    few = rng.normal(size=(700, 4))
    plane = np.zeros((700, 64))
    plane[:, :2] = rng.normal(size=(700, 2))
    plane += 0.01 * rng.normal(size=plane.shape)
    base = rng.normal(size=(350, 16))
    one = np.concatenate([base, base])
    # A single component carries the whole difference, at cosines around 0.981.
    one[350:, 3] += 0.19 * np.linalg.norm(base, axis=1)
    return {"few dimensions": few, "a plane": plane, "one component": one}


@pytest.mark.parametrize("name", list(cases()))
def test_no_link_is_lost(spark, name):
    x = cases()[name]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in multi_index.near_duplicates(frame).collect()}
    want = linked(x, multi_index.THRESHOLD)
    assert [got[i] for i in range(len(x))] == want.tolist() and want.sum() > 300


def test_words_are_visited_by_growing_distance():
    rng = np.random.default_rng(1)
    near1, near2 = rng.integers(0, 30, (20, 6)).astype(float), rng.integers(0, 30, (20, 9)).astype(float)
    seen = {row: [] for row in range(20)}
    for rows, first, second in multi_index._multi_sequence(near1, near2, 25.0):
        for row, i, j in zip(rows.tolist(), first.tolist(), second.tolist()):
            seen[row].append((i, j))
    for row, pairs in seen.items():
        sums = [near1[row, i] + near2[row, j] for i, j in pairs]
        assert sums == sorted(sums) and len(set(pairs)) == len(pairs)
        assert set(pairs) == {(i, j) for i in range(6) for j in range(9) if near1[row, i] + near2[row, j] <= 25}


def test_a_lower_target_is_reached_with_fewer_visits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 4))
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    want = linked(x, multi_index.THRESHOLD)
    found = sum(r.n_links for r in multi_index.near_duplicates(frame, target=0.9).collect())
    assert 0.87 * want.sum() <= found < want.sum()


def test_grown_codebooks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "WORDS", (64, 1_024))
    x = cases()["a plane"]
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in multi_index.near_duplicates(frame).collect()}
    assert [got[i] for i in range(len(x))] == linked(x, multi_index.THRESHOLD).tolist()
