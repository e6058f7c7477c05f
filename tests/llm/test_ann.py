import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import hilbert_ann as H


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "q") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, rank int, query string")


def brute_force(rows, k=5):
    rows = [(i, np.asarray(v, float)) for i, v in rows]
    found = set()
    for q, a in rows:
        if q % 50 == 0:
            scored = [(-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), i) for i, b in rows if i != q]
            found |= {(q, n + 1, i) for n, (_, i) in enumerate(sorted(scored)[:k])}
    return found


def search(df):
    return H.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect()


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_unit_steps(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = H.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("clusters", [0, 20])
def test_recall(spark, clusters, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 64)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 32))
    if clusters:
        v = 0.2 * v + rng.normal(size=(clusters, 32))[np.arange(3000) % clusters]
    v = v.astype(np.float32)
    got = search(table(spark, v.tolist()))
    truth = brute_force(list(enumerate(v)))
    assert len(got) == len(truth)
    assert len({(r.query_id, r.id) for r in got} & {(q, i) for q, _, i in truth}) >= 0.9 * len(truth)
    for r in got[:20]:
        a, b = v[r.query_id].astype(float), v[r.id].astype(float)
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_ties_go_to_smaller_ids(spark):
    vectors = [[1.0, 0.0, 0.0]] * 500 + [[0.0, 1.0, 0.0]] * 3
    got = {(r.query_id, r.rank, r.id) for r in search(table(spark, vectors))}
    assert got == brute_force(list(enumerate(vectors)))


def test_vectors_that_take_no_part(spark):
    vectors = [[1.0, 2.0], None, [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [2.0, 1.0], [1.0], []]
    got = search(table(spark, vectors))
    assert [(r.query_id, r.rank, r.id) for r in got] == [(0, 1, 6)]
    assert search(table(spark, [])) == []
    assert search(table(spark, [None])) == []
    assert search(table(spark, [[1.0, 1.0]])) == []
