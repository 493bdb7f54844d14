import datetime as dt

import pytest

from tidemark.plans.ledger import deleted_retrievable, erased_retrievable

T = [dt.datetime(2024, m, 3) for m in range(1, 13)]


@pytest.mark.parametrize(("query", "status", "pii"), [(deleted_retrievable, "deleted", 0), (erased_retrievable, "live", 1)])
def test_targets_are_the_last_chunks_and_found_only_if_held(spark, tmp_path, query, status, pii):
    """Of the target d, x::0 is held, x::1 not, but its text is, under another id; an old version doesn't count, a live document neither."""
    docs = [("d", "p", "c", "c", status, None, pii, T[1], T[1]), ("other", "p", "c", "c", "live", None, 0, T[1], T[1])]
    chunks = [("old::0", "d", 1, 0, "t0", 1, T[1]), ("x::0", "d", 2, 0, "t1", 1, T[1]), ("x::1", "d", 2, 1, "t2", 1, T[1]), ("o::0", "other", 3, 0, "t2", 1, T[1])]
    events = [(i, "pgvector", c, op, T[1], "c", 1, T[1]) for i, (c, op) in enumerate([("old::0", "upsert"), ("x::0", "upsert"), ("x::1", "upsert"), ("x::1", "delete"), ("o::0", "upsert")])]
    axis = lambda *i: [1.0 if n in i else 0.0 for n in range(64)]
    vectors = [(1, "old::0", axis(3)), (3, "x::0", axis(9)), (5, "x::0", axis(1)), (7, "x::1", axis(2)), (9, "o::0", axis(2))]
    for name, rows, schema in (
        ("ledger_documents", docs, "doc_id string, source_path string, first_seen_commit string, last_seen_commit string, status string, renamed_to string, is_synthetic_pii int, snapshot_at timestamp_ntz, loaded_at timestamp_ntz"),
        ("doc_versions", [(1, "d", "c", T[1], "h", "add", T[1])], "version_id bigint, doc_id string, commit_sha string, commit_date timestamp_ntz, content_sha256 string, action string, loaded_at timestamp_ntz"),
        ("chunks", chunks, "chunk_id string, doc_id string, version_id bigint, ordinal int, text_sha256 string, token_count int, loaded_at timestamp_ntz"),
        ("index_events", events, "event_id bigint, engine string, chunk_id string, op string, applied_at timestamp_ntz, commit_sha string, expected_present int, loaded_at timestamp_ntz"),
        ("chunk_vectors", vectors, "row_seq bigint, chunk_id string, embedding array<float>"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(r.k, r["mode"]): (r.n_targets, r.n_found) for r in query(spark, str(tmp_path)).collect()}
    assert got == {(k, m): (2, n) for k in (5, 10) for m, n in (("exact_id", 1), ("doc_scoped", 2), ("content_scoped", 2))}
