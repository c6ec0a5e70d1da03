"""Inputs on which operators once did less than the whole job."""

import numpy as np
import pytest

from draftlens.llm import neighbours, vector_dedup
from draftlens.llm import vectors as V


def planted(n, pairs, seed=11, dims=64):
    """Random unit vectors; the first ``pairs`` have a partner of cosine 0.93 to 0.97."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(pairs, dims))
    side -= (side * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.931, 0.97, (pairs, 1))
    x[pairs:2 * pairs] = c * x[:pairs] + np.sqrt(1 - c * c) * side
    return x


def links(x, least=0.93):
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    return near


def test_vector_dedup_recall_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CLUSTER", 40)
    monkeypatch.setattr(vector_dedup, "PART", 64)  # crowded shards are cut, too
    x = planted(3000, 1200)
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(rows).collect()}
    want = links(x).sum(1)
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.99 * want.sum()


def test_vector_dedup_counts_each_link_once(spark, monkeypatch):
    """Dense groups over several shards: links, roots and the search across shards are exact."""
    monkeypatch.setattr(vector_dedup, "CLUSTER", 25)
    monkeypatch.setattr(vector_dedup, "PART", 50)
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(12, 8))
    x = V.unit(middle[rng.integers(0, 12, 600)] + 0.35 * rng.normal(size=(600, 8)))
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(rows).collect()}
    near, root = links(x), np.arange(600)
    for _ in range(600):
        low = np.minimum(root, np.where(near, root[None, :], 10**9).min(axis=1))
        if (low == root).all():
            break
        root = low
    assert near.sum() > 2000
    missed = sum(int(near[i].sum()) - got[i][0] for i in range(600))
    assert 0 <= missed <= 0.01 * near.sum()
    if not missed:
        assert got == {i: (int(near[i].sum()), int(root[i])) for i in range(600)}


def test_vector_dedup_expands_across_shards(spark):
    """a and c share no home; b, in range of both, leads from one to the other."""
    t = np.deg2rad([0, 10, 20, 70])
    v = np.stack([np.cos(t), np.sin(t)], axis=1)
    nodes = spark.createDataFrame([(i, x.tolist(), 2) for i, x in enumerate(v)], "node long, vec array<double>, dims int")
    lists = spark.createDataFrame([(0, 1, [0], [0, 1]), (1, 0, [0, 1], [0]), (1, 2, [0, 1], [1]), (2, 1, [1], [0, 1]), (2, 3, [1], [2]), (3, 2, [2], [1])],
                                  "node long, to long, homes array<int>, to_homes array<int>")
    assert [(r.a, r.b) for r in vector_dedup.expand(lists, nodes, 0.93).collect()] == [(0, 2)]
    assert vector_dedup.expand(lists.limit(0), nodes, 0.93) is None


def test_vector_dedup_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0, "x"), (2, [1.0, 0.01], 0, "x"), (2, [1.0, 0.01], 0, "x"), (3, [1.0, 0.0, 0.0], 0, "x"), (4, [1.0, 0.0], None, "x"),
            (5, None, 0, "x"), (6, [0.0, 0.0], 0, "x"), (7, [float("nan"), 1.0], 0, "x"), (8, [1e200, 1e198], 0, "x"), (None, [0.0, 1.0], 0, None), (9, [], 0, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect())
    assert got == [(-1, 0, None), (1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 3, 1), (9, 0, 9)]
    assert vector_dedup.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("copies", [198, 205, 212, 700])
def test_nearest_among_copies_by_id(spark, monkeypatch, copies):
    """Smallest ids among copies, with shards in parts and scores in blocks."""
    monkeypatch.setattr(neighbours, "SHARD", 64)
    x = np.random.default_rng(copies).normal(size=(34, 64))
    rows = [(i, x[0].tolist()) for i in range(copies)] + [(copies + i, (x[0] * 2.0 ** (i % 9)).tolist()) for i in range(copies)]
    rows += [(10_000 + i, v.tolist()) for i, v in enumerate(x[1:])]
    df = spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>")
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    u = m / np.sqrt((m * m).sum(1, keepdims=True))
    got = {}
    for r in neighbours.nearest(df, df["vec_id"] >= 9_990 - 9_990 * (df["vec_id"] < 3).cast("int")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in [0, 1, 2, *range(10_000, 10_033)]:
        score = np.round(u @ u[ids == q][0], 12)
        score[ids == q] = -9
        assert got[q] == ids[np.lexsort((ids, -score))[:5]].tolist()
