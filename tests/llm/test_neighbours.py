import numpy as np
import pandas as pd
import pytest

import tidemark.llm.neighbours as n
from tidemark.llm.neighbours import DIM, cells_by_heap, similar_pairs, top_similar

SCHEMA = "row_seq bigint, chunk_id string, embedding array<float>, doc_id string, other string"


def frame(spark, vectors, ids=None):
    ids = ids or [f"c{i:05d}" for i in range(len(vectors))]
    rows = [(i, c, None if v is None else [None if x is None else float(x) for x in v], "d", "clash") for i, (c, v) in enumerate(zip(ids, vectors, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def families(count, size, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(count, DIM))
    x = np.repeat(centres, size, axis=0) + spread * rng.normal(size=(count * size, DIM))
    return (x / np.linalg.norm(x, axis=1)[:, None] * rng.choice([1.0, 1.0, 2.5], len(x))[:, None]).astype(np.float32)


def brute(ids, x, k, least):
    wide = x.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1)[:, None]
    s = np.round(wide @ wide.T, 6)
    out = {}
    for i, c in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= least), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[c] = [ids[j] for j in order]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.chunk_id, r.place)):
        out.setdefault(r.chunk_id, []).append(r.other)
    return out


def test_recall_and_truth_of_what_is_found(spark):
    x = np.concatenate([families(300, 6, 0.25, 1), families(1200, 1, 0, 2)])
    ids = [f"c{i:05d}" for i in range(len(x))]
    want = brute(ids, x, 5, 0.6)
    got = lists(top_similar(frame(spark, x), 5, 0.6))
    pairs = lambda d: {(a, b) for a, own in d.items() for b in own}
    assert len(pairs(got) & pairs(want)) >= 0.95 * len(pairs(want))
    found = similar_pairs(top_similar(frame(spark, x), 5, 0.6), 0.6).collect()
    assert len(found) == len(set(found)) and all(r.chunk_id_a < r.chunk_id_b for r in found)


def test_recall_where_cells_are_many(spark, tmp_path):
    """Among 90,000 vectors nearly every neighbour of 0.85 and more is found."""
    x = families(45_000, 2, 0.38, 9)
    ids = [f"c{i:05d}" for i in range(len(x))]
    pd.DataFrame({"row_seq": range(len(x)), "chunk_id": ids, "embedding": list(x)}).to_parquet(tmp_path / "v.parquet")
    unit = n.unit_rows(x)
    like = (unit[0::2] * unit[1::2]).sum(1)
    want = {(ids[2 * i], ids[2 * i + 1]) for i in np.flatnonzero(like > 0.851)}
    assert len(want) > 10_000
    got = {tuple(r) for r in similar_pairs(top_similar(spark.read.parquet(str(tmp_path / "v.parquet")), 5, 0.85), 0.85).collect()}
    assert len(got & want) >= 0.98 * len(want)


def test_exact_where_all_cells_are_visited(spark):
    """Few rows lie in one cell, so the result is that of brute force, ties, equal and scaled vectors included."""
    base = families(5, 3, 0.3, 3)
    x = np.concatenate([base, base[:4], base[:4], base[:2] * 2, np.repeat(base[:1], 9, axis=0)])
    ids = [f"c{(i * 7) % len(x):05d}" for i in range(len(x))]
    for k, least in ((5, -1.0), (2, 0.9)):
        assert lists(top_similar(frame(spark, x, ids), k, least)) == {c: o for c, o in brute(ids, x, k, least).items() if o}


def test_odd_vectors_take_no_part(spark):
    v = families(1, 3, 0.1, 4)
    odd = [None, [], [0.0] * DIM, [1.0] * 32, [1.0] * 63 + [None], [float("nan")] + [1.0] * 63]
    got = lists(top_similar(frame(spark, [*v, *odd]), 5))
    assert set(got) == {"c00000", "c00001", "c00002"} and all(len(o) == 2 for o in got.values())
    assert top_similar(frame(spark, odd), 5).count() == 0
    assert top_similar(frame(spark, [*v]).limit(0), 5).count() == 0


def test_few_usable_vectors_among_many_rows(spark, monkeypatch):
    """The sample is drawn from raw rows, of which hardly any is usable here."""
    monkeypatch.setattr(n, "SAMPLE", 2)
    x = families(6, 3, 0.1, 10)
    ids = [f"u{i:03d}" for i in range(len(x))]
    rows = frame(spark, [*x, *[None] * 400], [*ids, *[f"n{i:03d}" for i in range(400)]])
    assert lists(top_similar(rows, 5, 0.5)) == brute(ids, x, 5, 0.5)


def test_latest_row_of_an_id_counts(spark):
    a, b, c = families(3, 1, 0, 5)
    got = lists(top_similar(frame(spark, [a, b, c, b], ["x", "y", "z", "x"]), 1, 0.5))
    assert got == {"x": ["y"], "y": ["x"]}


def test_a_family_too_large_for_one_cell_gets_a_finer_index(monkeypatch):
    monkeypatch.setattr(n, "FULL_CELL", 200)
    x = np.concatenate([families(1, 1500, 0.02, 6), families(1700, 1, 0, 7)])
    unit = n.unit_rows(x).astype(np.float32)
    index = n.fit(unit, np.random.default_rng(1), [0])
    own = n.own_cells(index, unit)
    assert index.finer and pd.Series(own).value_counts().max() <= 200
    row, cell = n.visits(index, unit, 16)
    assert set(zip(range(len(x)), own.tolist(), strict=True)) <= set(zip(row.tolist(), cell.tolist(), strict=True))


def test_a_third_of_all_rows_in_one_family_are_split_by_count(spark, monkeypatch):
    """The family's group is split, and the guests of the rest are shared out, without a loss."""
    x = np.concatenate([families(1, 700, 0.02, 6), families(450, 3, 0.3, 7)])
    ids = [f"c{i:05d}" for i in range(len(x))]
    monkeypatch.setattr(n, "GROUP_ROWS", 100)
    monkeypatch.setattr(n, "FULL_GROUP", 200)
    df = frame(spark, x, ids)
    raw = df.selectExpr("xxhash64(embedding) as cls", "embedding")
    start = n.k_means(n.unit_rows(x).astype(np.float32)[::7], 4, np.random.default_rng(1))
    centroids, parts = n.balanced_groups(raw, start, np.random.default_rng(1))
    own, guests = n.groups_of(raw, centroids)
    assert len(centroids) > 4 and own.max() <= 230 and parts.max() > 1 and (guests <= 200 * parts).all()
    got, want = ({(a, b) for a, o in d.items() for b in o} for d in (lists(top_similar(df, 5, 0.85)), brute(ids, x, 5, 0.85)))
    away = {p for p in want if p[0] >= "c00700"}
    assert len(got & away) >= 0.98 * len(away) and len(got & want) >= 0.9 * len(want)


def test_ids_beyond_ascii_rank_by_their_bytes(spark):
    base = families(1, 1, 0, 11)
    x = np.concatenate([base, base, base, base, families(1, 1, 0, 12)])
    ids = ["ü", "z", "日", "a", "ß"]
    assert lists(top_similar(frame(spark, x, ids), 2, 0.9)) == {"a": ["z", "ü"], "z": ["a", "ü"], "ü": ["a", "z"], "日": ["a", "z"]}


def test_heap_order():
    rng = np.random.default_rng(8)
    a, b = sorted(rng.random(9) * n.MARGIN), sorted(rng.random(7) * n.MARGIN)
    got = cells_by_heap(a, b, 20)
    sums = sorted(x + y for x in a for y in b)
    within = [s for s in sums if s <= a[0] + b[0] + n.MARGIN][:20]
    assert [a[i] + b[j] for i, j in got] == pytest.approx(within) and len(set(got)) == len(got)
