"""Vector searches against brute force."""
from __future__ import annotations

import numpy as np
import pytest

from tidewatch.llm import exact_search, hnsw
from tidewatch.llm.exact_search import exact_top_k
from tidewatch.llm.hnsw import near_neighbours
from tidewatch.llm.vectors import usable

SCHEMA = "vec_id long, embedding array<double>, score string, rank string, shard int"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r], None, None, None) for i, r in zip(ids, x)], SCHEMA)


def brute(ids, x, queries, k):
    want = {}
    for q in queries:
        score = x @ x[q]
        rows = [(ids[j], score[j]) for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        want[int(ids[q])] = rows
    return want


def test_usable_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (None, [1.0, 1.0])]
    assert [r.vec_id for r in usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()] == [1]


@pytest.mark.parametrize("low,high", [(-3, 4), (-400, 400), (-(2**26), 2**26)])
def test_exact_top_k(spark, monkeypatch, low, high):
    monkeypatch.setattr(exact_search, "SHARD", 150)
    monkeypatch.setattr(exact_search, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(low % 7)
    x = rng.integers(low, high, (400, 13)).astype(float)
    x[100:180] = x[7]                                   # ties
    ids = rng.permutation(4000)[:400]
    queries = [i for i in range(0, 400, 9)]
    rows = exact_top_k(frame(spark, ids, x), frame(spark, ids[queries], x[queries]), 20).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    exact = x.astype(object)
    want = {int(ids[q]): [(i, s) for s, i in sorted((-int(sum(exact[j] * exact[q])), int(ids[j])) for j in range(400) if ids[j] != ids[q])[:20]] for q in queries}
    assert got == {q: [(i, -s) for i, s in rows] for q, rows in want.items()}


def test_few_candidates_and_empty_tables(spark):
    x = np.array([[1.0, 0], [2, 0], [3, 0]])
    some, none = frame(spark, [1, 2, 3], x), frame(spark, [], x[:0])
    longer = frame(spark, [9], np.ones((1, 5)))
    for search in (exact_top_k, near_neighbours):
        rows = search(some.unionByName(longer), frame(spark, [3], x[2:]), 20).collect()
        assert [(r.rank, r.vec_id, r.score) for r in rows] == [(1, 2, 6), (2, 1, 3)]
        assert search(none, some).collect() == [] and search(some, none).collect() == []


@pytest.mark.parametrize("equal", [True, False])
def test_recall_of_the_graph(spark, monkeypatch, equal):
    monkeypatch.setattr(hnsw, "SHARD", 1000)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2500, 32))
    if equal:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[2000:2200] = x[11]                                # a large group of equal vectors
    x[2300] = 0
    ids = np.arange(2500)
    queries = [q for q in range(0, 2500, 20) if q != 2300] + [11]
    rows = near_neighbours(frame(spark, ids, x), frame(spark, ids[queries + [2300]], x[queries + [2300]]), 20).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(x[r.vec_id] @ x[r.query_id]), abs=1e-12) and r.vec_id != r.query_id
    live = np.delete(ids, 2300)
    want = brute(live, x[live], [int(np.searchsorted(live, q)) for q in queries], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * 20 * len(want)
    assert got[11] == [i for i, _ in want[11]]          # ties to the smallest ids


def test_recall_on_the_embeddings(spark):
    rows = usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    all_ = rows.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in all_]), np.array([r.embedding for r in all_])
    want = brute(ids, x, [i for i in range(len(ids)) if ids[i] % 20 == 0], 20)
    got = near_neighbours(rows, rows.where("vec_id % 20 = 0")).collect()
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert hits >= 0.9 * sum(len(w) for w in want.values())
