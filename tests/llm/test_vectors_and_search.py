"""Vector operators against brute force."""

import math

import numpy as np
import pytest

from moodstream.llm import topk, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def _rows(seed=0, n=600, dims=16):
    """Background vectors, a hot group of near copies, a chain, copies and unusable vectors."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x[: n // 3] = x[0] + 0.15 * rng.standard_normal((n // 3, dims))
    x[n // 3 : n // 3 + 60] = np.repeat(rng.standard_normal((6, dims)), 10, axis=0)
    x *= rng.uniform(0.2, 3, (n, 1))
    rows = [(int(i), [float(v) for v in row], 0) for i, row in zip(rng.permutation(n) * 5, x.astype(np.float32))]
    nan, inf = math.nan, math.inf
    bad = [None, [], [None] + [1.0] * 15, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [0.0] * 16]
    return rows, [(10_000 + 50 * k, v, None) for k, v in enumerate(bad)] + [(None, [1.0] * 16, 1)]


def _brute_groups(rows):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(near, label[None, :], label.max()).min(axis=1))
        if (new == label).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), label)}, near.sum()
        label = new


@pytest.mark.parametrize("cell_rows, block", [(100, 64), (10_000, 4096)])
def test_vector_groups(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows, bad = _rows()
    frame = spark.createDataFrame(rows + bad + rows[:3], SCHEMA).withColumnRenamed("label", "n_links")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_groups(frame).collect()}
    expected, links = _brute_groups(rows)
    assert set(got) == set(expected) | {r[0] for r in bad if r[0] is not None}
    found = sum(got[i][0] for i in expected)
    assert all(got[i][0] <= expected[i][0] for i in expected) and found >= 0.95 * links
    if cell_rows > 600:
        assert all(got[i][:2] == expected[i] for i in expected)
    for vec_id, *_ in bad[:-1]:
        assert got[vec_id] == (0, vec_id, True)


def test_links_over_hundreds_of_cells(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", 8)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2400, 24))
    x[1200:] = x[:1200] + 0.42 * rng.standard_normal((1200, 24))  # cosines around 0.92
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x.astype(np.float32))]
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert len(vector_dedup.fit_cells(unit, 300)) > 200
    reached = vector_dedup._reached(unit, vector_dedup.fit_cells(unit, 300), 0.9)
    home = np.array([r[0] for r in reached])
    near = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))
    assert all(home[j] in reached[i] or home[i] in reached[j] for i, j in near)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    expected, links = _brute_groups(rows)
    assert links > 1000 and got == expected


def test_vector_groups_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_dedup.near_groups(empty).count() == 0
    one = spark.createDataFrame([(3, [0.0, 0.0], 1), (4, None, 1)], SCHEMA)
    assert sorted(map(tuple, vector_dedup.near_groups(one).collect())) == [(3, 0, 3, True), (4, 0, 4, True)]


@pytest.mark.parametrize("shard, block", [(8192, 2048), (50, 5)])
def test_top_k(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "QUERY_ROWS", block)
    monkeypatch.setattr(topk, "RESCORED", 8)
    rows, bad = _rows(1, 300)
    got = topk.search_embeddings(spark.createDataFrame(rows + bad + rows[:3], SCHEMA), k=5, every=50).collect()
    ids = np.array([r[0] for r in rows] + [10_250])
    v = np.floor(256 * np.array([r[1] for r in rows] + [[0.0] * 16], np.float64)).astype(np.int64)
    expected = set()
    for q in np.flatnonzero(ids % 50 == 0):
        order = [j for j in np.lexsort((ids, -(v @ v[q]))) if j != q][:5]
        expected |= {(int(ids[q]), k + 1, int(ids[j]), int(v[j] @ v[q])) for k, j in enumerate(order)}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_top_k_of_few_rows(spark):
    assert topk.search_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
    two = spark.createDataFrame([(50, [0.5], 0), (7, [0.25, 1.0], 0)], SCHEMA)
    assert [tuple(r) for r in topk.search_embeddings(two).collect()] == [(50, 1, 7, 128 * 64)]
    assert topk.search_embeddings(two.where("vec_id = 50")).count() == 0


def test_top_k_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "RESCORED", 4)
    two = spark.createDataFrame([(50, [1.0, 0.0], 0), (7, [0.5, 0.0], 0), (7, [1.0, 0.0], 0)], SCHEMA)
    assert [tuple(r) for r in topk.search_embeddings(two).collect()] == [(50, 1, 7, 65_536)]
    rng = np.random.default_rng(3)
    ids = np.where(rng.random(400) < 0.4, 7, rng.integers(0, 150, 400))  # one id holds many rows
    x = rng.standard_normal((400, 12)).astype(np.float32)
    got = topk.search_embeddings(spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA)).collect()
    v = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    expected = set()
    for q in {int(i) for i in ids if i % 50 == 0}:
        best = {}
        for a in np.flatnonzero(ids == q):
            for b in np.flatnonzero(ids != q):
                best[int(ids[b])] = max(best.get(int(ids[b]), -(1 << 60)), int(v[a] @ v[b]))
        order = sorted(best, key=lambda i: (-best[i], i))[:5]
        expected |= {(q, k + 1, i, best[i]) for k, i in enumerate(order)}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_search_stops_on_proof():
    """Equal to all products, though a good part of the postings is never read."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 64))
    x = centres[rng.integers(0, 40, 8000)] + 0.4 * rng.standard_normal((8000, 64))
    values = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    ids = rng.permutation(8000)
    index = topk.ImpactIndex(ids, values)
    assert index.postings == np.count_nonzero(values)
    got = list(index.search(ids[:100], values[:100], 5))
    for q in range(100):
        scores = values @ values[q]
        order = [j for j in np.lexsort((ids, -scores)) if j != q][:5]
        mine = [(i, s) for query, i, s in got if query == ids[q]]
        assert mine == [(int(ids[j]), int(scores[j])) for j in order]
    assert index.touched < 0.6 * index.postings * 100


def test_planted_pairs_by_margin(spark, monkeypatch):
    """With the query's margin over hundreds of cells: nearly all pairs just above the threshold, little compared."""
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", 100)
    rng = np.random.default_rng(4)
    n, dims = 20_000, 64
    x = rng.standard_normal((n // 2, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rng.standard_normal((n // 2, dims))
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    cosine = rng.uniform(0.901, 0.95, (n // 2, 1))
    x = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * turn]).astype(np.float32)
    unit = vector_dedup._unit(x)[0]
    centres = vector_dedup.fit_cells(unit, n // 100)
    reached = vector_dedup._reached(unit, centres, 0.9, vector_dedup.PROBED)
    home = np.bincount([r[0] for r in reached])
    members = np.bincount(np.concatenate(reached))
    assert len(centres) > 150 and (home * members[: len(home)]).sum() < 0.15 * n * n
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: r.n_links for r in vector_dedup.near_groups(frame, margin=vector_dedup.PROBED).collect()}
    expected = np.zeros(n, np.int64)
    for at in range(0, n, 1000):
        expected[at : at + 1000] = (unit[at : at + 1000] @ unit.T >= 0.9).sum(axis=1) - 1
    assert all(got[i] <= expected[i] for i in range(n)) and len(got) == n
    assert expected.sum() >= n and sum(got.values()) >= 0.99 * expected.sum()


def test_several_vectors_of_one_id(spark):
    rows = [(3, [1.0, 0.0], 0), (3, [0.0, 1.0], 0), (3, [0.0, 1.0], 0), (5, [2.0, 0.1], 0), (9, [0.1, 2.0], 0)]
    got = sorted(map(tuple, vector_dedup.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(3, 2, 3, True), (5, 1, 3, False), (9, 1, 3, False)]
