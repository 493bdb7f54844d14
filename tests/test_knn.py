import numpy as np
import pytest

import tidemark.operators.knn as k
from tidemark.operators.knn import best_of_each, exact_top_k, with_empty

SCHEMA = "id bigint, embedding array<float>, rank string"


def frame(spark, x, start=0):
    return spark.createDataFrame([(i + start, None if v is None else [float(z) for z in v], "clash") for i, v in enumerate(x)], SCHEMA)


@pytest.mark.parametrize("block", [20_000, 7])
@pytest.mark.parametrize("exclude", [True, False])
def test_matches_brute_force(spark, monkeypatch, block, exclude):
    monkeypatch.setattr(k, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:60] = x[0]
    rows = frame(spark, x).repartition(5)
    got = {}
    for r in exact_top_k(rows.where("id % 10 = 0"), rows, 6, exclude).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.match_id, r.similarity))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    for q in range(0, 300, 10):
        order = sorted((i for i in range(300) if not (exclude and i == q)), key=lambda i: (-s[q, i], i))[:6]
        assert [m for _, m, _ in sorted(got[q])] == order and [n for n, _, _ in sorted(got[q])] == list(range(1, 7))


def test_odd_vectors_and_empty_tables(spark):
    rows = frame(spark, [[1, 0], [0, 1], None, [0, 0], [1, 0, 0], [float("inf"), 1], []])
    hits = exact_top_k(rows, rows, 5)
    assert {(r.query_id, r.match_id) for r in hits.collect()} == {(0, 1), (1, 0)}
    lists = {r.query_id: len(r.hits) for r in with_empty(rows, hits).collect()}
    assert lists == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}
    assert exact_top_k(rows.limit(0), rows, 5).count() == 0 and exact_top_k(rows, rows.limit(0), 5).count() == 0


@pytest.mark.parametrize("dim", [4, None])
def test_one_length_holds_for_all_batches(spark, dim):
    """Short vectors are as many as sound ones or more among the queries and in one part of the rows, but not in the table."""
    long, short = np.eye(4)[[0, 1, 2, 3, 0, 1]], np.ones((3, 2))
    rows = frame(spark, long).coalesce(1).unionByName(frame(spark, [*short, long[0]], 6).coalesce(1))
    asked = rows.where("id >= 6")
    hits = {(r.query_id, r.match_id) for r in exact_top_k(asked, rows, 3, False, dim).collect()}
    assert hits == {(9, 0), (9, 4), (9, 9)}


def test_best_of_each_settles_ties_by_place():
    rng = np.random.default_rng(5)
    for n, k in ((1, 3), (5, 5), (40, 3), (40, 1)):
        sim = rng.integers(0, 4, (30, n)).astype(float)
        sim[rng.random(sim.shape) < 0.3] = -np.inf
        row, col = best_of_each(sim, k)
        want = [(i, j) for i in range(30) for j in [j for j in np.argsort(-sim[i], kind="stable") if sim[i, j] > -np.inf][:k]]
        assert list(zip(row.tolist(), col.tolist(), strict=True)) == want
