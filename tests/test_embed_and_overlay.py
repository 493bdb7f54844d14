import hashlib
import re

import numpy as np
import pytest

from tidemark.operators import embed, overlay
from tidemark.operators.audit import precision_recall, retrievable, venn
from tidemark.operators.ledger import insert_if_absent, upsert


def model(text, dim):
    v = np.zeros(dim)
    for t in re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]", text.lower()):
        h = hashlib.md5(t.encode()).hexdigest()
        v[int(h[:8], 16) % dim] += 1 if int(h[8], 16) < 8 else -1
    return v / np.linalg.norm(v) if v.any() else None


def test_hashed_vectors(spark):
    texts = ["Some words, some more.", "", None, "word " * 1000, "é ü", "a"]
    chunks = spark.createDataFrame([(f"c{i}", t, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts)] + [("same", texts[0], hashlib.sha256(texts[0].encode()).hexdigest())], "chunk_id string, text string, text_sha256 string")
    got = {r.chunk_id: r.embedding for r in embed.embed_by_hash(chunks, 16).collect()}
    assert set(got) == {"c0", "c3", "c4", "c5", "same"} and got["same"] == got["c0"]
    for i in (0, 3, 4, 5):
        assert got[f"c{i}"] == pytest.approx(model(texts[i], 16), abs=1e-6)


def test_hash_mismatches(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    stored = spark.createDataFrame([("a", sha("x")), ("b", sha("y"))], "chunk_id string, text_sha256 string")
    rebuilt = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "x"), ("b", None)], "chunk_id string, text string")
    assert sorted((r.chunk_id, r.problem) for r in embed.hash_mismatches(rebuilt, stored).collect()) == [("b", "changed"), ("b", "changed"), ("c", "unknown")]


def test_staff_pages_and_migration(spark):
    pages = overlay.profile_pages(overlay.employees(spark, 30))
    again = overlay.profile_pages(overlay.employees(spark, 30))
    assert sorted(pages.collect()) == sorted(again.collect()) and pages.select("doc_id").distinct().count() == 30
    assert pages.where("size(split(trim(body), '[ \n]+')) < 30").count() == 0
    docs = spark.createDataFrame([("legacy", "p", "c", "c", "live", None, 1), ("other", "p", "c", "c", "live", None, 0)], "doc_id string, source_path string, first_seen_commit string, last_seen_commit string, status string, renamed_to string, is_synthetic_pii int")
    versions = spark.createDataFrame([(1, "legacy"), (2, "other")], "version_id bigint, doc_id string")
    chunks = spark.createDataFrame([("l0", "legacy"), ("o0", "other")], "chunk_id string, doc_id string")
    events = spark.createDataFrame([(1, "l0"), (2, "o0")], "event_id bigint, chunk_id string")
    out = overlay.migrate(docs, versions, chunks, events, "legacy", pages, "c1")
    assert [out[t].count() for t in ("documents", "doc_versions", "chunks", "index_events")] == [31, 31, 31, 91]
    new = out["doc_versions"].where("version_id > 2").agg({"version_id": "max"}).first()[0]
    assert new == 32 and out["index_events"].select("event_id").distinct().count() == 91
    twice = overlay.migrate(out["documents"], out["doc_versions"], out["chunks"], out["index_events"], "legacy", pages, "c2")
    for t in out:
        assert sorted(twice[t].collect(), key=str) == sorted(out[t].collect(), key=str)
    nothing = overlay.migrate(docs, versions, chunks, events, None, pages.limit(0), "c1")
    assert [nothing[t].count() for t in ("documents", "doc_versions", "chunks", "index_events")] == [2, 2, 2, 2]


def test_backfill_only_goes_ahead_with_the_texts_once_stored(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    versions = spark.createDataFrame([("d", 1), ("e", 2)], "doc_id string, version_id bigint")
    chunks = spark.createDataFrame([("d0", 1, sha("some words")), ("e0", 2, sha("others"))], "chunk_id string, version_id bigint, text_sha256 string")
    manifest = lambda *rows: spark.createDataFrame(rows, "doc_id string, text string")
    made = embed.verified_backfill(manifest(("d", "some words"), ("e", "others")), versions, chunks, embed.by_hash(8)).collect()
    assert {r.chunk_id for r in made} == {"d0", "e0"}
    for wrong in (("d", "other words"), ("f", "unknown"), ("d", None)):
        with pytest.raises(ValueError, match=wrong[0]):
            embed.verified_backfill(manifest(("e", "others"), wrong), versions, chunks, embed.by_hash(8))
    own = embed.embed_texts(chunks.selectExpr("chunk_id", "chunk_id as text", "text_sha256"), lambda texts: texts.selectExpr("text_sha256", "array(float(length(text))) as embedding"))
    assert {r.chunk_id: r.embedding for r in own.collect()} == {"d0": [2.0], "e0": [2.0]}


def test_retrievable_modes(spark):
    rows = spark.createDataFrame([(1, "d", "x"), (2, "d", "y"), (3, "e", "x"), (4, "f", "z")], "id bigint, doc_id string, text_sha256 string")
    hits = spark.createDataFrame([(1, 1, 3), (1, 2, 2), (1, 7, 1), (4, 1, 2)], "query_id bigint, rank int, match_id bigint")
    got = {(r["k"], r["mode"]): (r.n_targets, r.n_found) for r in retrievable(rows.where("id in (1, 4)"), hits, rows).collect()}
    assert got == {(5, "exact_id"): (2, 0), (10, "exact_id"): (2, 1), (5, "doc_scoped"): (2, 1), (10, "doc_scoped"): (2, 1), (5, "content_scoped"): (2, 1), (10, "content_scoped"): (2, 1)}


def test_upsert_insert_and_flags(spark):
    schema = "k string, n bigint, first_n bigint, v string"
    base, new = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, None)], schema), spark.createDataFrame([("a", 2, 2, None), ("c", 5, 5, "z"), ("c", 4, 4, "y")], schema)
    assert sorted(tuple(r) for r in upsert(base, new, ["k"], "n", ["first_n"]).collect()) == [("a", 2, 1, None), ("b", 1, 1, None), ("c", 5, 4, "z")]
    assert sorted(tuple(r) for r in insert_if_absent(base, new, ["k"]).collect()) == [("a", 1, 1, "x"), ("b", 1, 1, None), ("c", 4, 4, "y")]
    flags = spark.createDataFrame([("e", True, False), ("e", True, True), ("e", False, True), ("e", False, False)], "engine string, p boolean, q boolean")
    assert {r.region: r.n_chunks for r in venn(flags, ["p", "q"], "engine").collect()} == {0: 1, 1: 1, 2: 1, 3: 1}
    r = precision_recall(flags, flags.p, flags.q, "engine").first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 1, 1, 0.5, 0.5)
