"""Neighbours against brute force."""

import numpy as np
import pytest

from splitlane.llm import neighbours
from splitlane.llm.neighbours import nearest_neighbours, usable

SCHEMA = "vec_id long, embedding array<float>, label int"


def truth(rows, every, k=10):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(frame, every, **more):
    out = {}
    rows = nearest_neighbours(frame, every, **more).orderBy("query_id", "rank").collect()
    for r in rows:
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_awkward_vectors(spark):
    rows = [
        (None, [1.0, 2.0], 0), (0, [1.0, 2.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [float("nan"), 1.0], 0),
        (4, [float("inf"), 1.0], 0), (5, [1.0, None], 0), (6, [1.0, 2.0, 3.0], 0), (7, [], 0), (8, [1.0, 2.0], 0),
        (9, [1.0, 2.0], 0), (10, [3.0, 4.0], 0), (10, [3.0, 4.0], 0),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.vec_id for r in usable(frame).collect()) == [0, 8, 9, 10]
    kept = [(0, [1, 2]), (8, [1, 2]), (9, [1, 2]), (10, [3, 4])]
    assert found(frame, 5) == truth(kept, 5)


def test_no_vectors(spark):
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA), 100).count() == 0


def test_one_vector_has_no_neighbours(spark):
    assert nearest_neighbours(spark.createDataFrame([(0, [1.0], 1)], SCHEMA), 100).count() == 0


@pytest.mark.parametrize("block", [16_384, 40])
def test_recall_and_scores(spark, monkeypatch, block):
    """With a third of all vectors equal, and lists cut into blocks."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(900, 32)).astype(np.float32)
    v[::3] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    frame = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)
    expected, got = truth(rows, 20), found(frame, 20)
    assert got.keys() == expected.keys()
    hits = 0
    for q, near in expected.items():
        known = dict(near)
        hits += sum(i in known for i, _ in got[q])
        assert len(got[q]) == 10 and all(abs(known[i] - s) < 1e-12 for i, s in got[q] if i in known)
    assert hits / (10 * len(expected)) >= 0.9
    assert got[0] == expected[0]
