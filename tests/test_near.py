import numpy as np
import pytest

import tidemark.operators.near as m
from tidemark.operators.near import near_links
from tidemark.plans import ledger

SCHEMA = "row_seq bigint, chunk_id string, embedding array<float>, cls string, n string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, f"c{i:04d}", None if v is None else [float(z) for z in v], "x", "y") for i, v in enumerate(vectors)], SCHEMA)


@pytest.mark.parametrize(("cell_rows", "full"), [(4096, 1 << 15), (15, 1 << 15), (4096, 150), (15, 12)])
def test_every_link_of_every_row_is_counted(spark, monkeypatch, cell_rows, full):
    """In one cell and in some 40, across whose borders many pairs lie, and the same where full cells are parted."""
    monkeypatch.setattr(m, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(m, "FULL_CELL", full)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 64)).repeat(10, axis=0) + 0.11 * rng.normal(size=(600, 64))
    x = np.concatenate([x, x[:30], 3 * x[:5], 0.35 * rng.normal(size=(100, 64)) + 1]).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    want = (np.round(u @ u.T, 6) >= 0.98).sum(1) - 1
    got = {r.chunk_id: r.n_links for r in near_links(frame(spark, x), 0.98).collect()}
    assert want.max() > 5 and got == {f"c{i:04d}": w for i, w in enumerate(want)}


def test_odd_vectors_and_empty_tables(spark):
    one = [1.0] * 64
    rows = frame(spark, [one, one, None, [0.0] * 64, [1.0] * 32, [float("nan")] + one[1:], [float("inf")] + one[1:]])
    assert {(r.chunk_id, r.n_links) for r in near_links(rows, 0.98).collect()} == {("c0000", 1), ("c0001", 1)}
    assert near_links(rows.limit(0), 0.98).count() == 0


def test_near_duplicates_are_not_sought_by_sample():
    assert "near_duplicate_chunks" in ledger.QUERIES
