import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import replay, store
from tidemark.operators.chunker import Tokenizer, chunk

WRITES = "chunk_id string, row_seq bigint, embedding array<float>, is_found string"
ROWS = [("a", 1, [1.0], "x"), ("a", 3, [2.0], "y"), ("b", 2, None, "x"), (None, 9, [9.0], "x"), ("c", 4, [], "x")]


@pytest.fixture(scope="module")
def writes(spark):
    return spark.createDataFrame(ROWS, WRITES).drop("is_found")


def ids(spark, *names):
    return spark.createDataFrame([(n, "clash") for n in names], "chunk_id string, embedding string")


def test_current_vectors_and_lookups(spark, writes):
    now = store.current_vectors(writes)
    assert {r.chunk_id: (r.row_seq, r.embedding) for r in now.collect()} == {"a": (3, [2.0]), "b": (2, None), "c": (4, [])}
    got = {r.chunk_id: (r.is_found, r.row_seq) for r in store.lookup(now, ids(spark, "a", "zz", "a", None)).collect()}
    assert got == {"a": (True, 3), "zz": (False, None)}
    assert store.lookup_one(now, "a").count() == 1 and store.lookup_one(now, "zz").count() == 0
    assert store.lookup(now.limit(0), ids(spark, "a")).first().is_found is False and store.lookup(now, ids(spark).limit(0)).count() == 0


def test_new_writes_come_after_stored_ones_whatever_their_numbers(spark, writes):
    new = spark.createDataFrame([("a", 1, [7.0], ""), ("a", 0, [6.0], ""), ("d", 5, [5.0], "")], WRITES)
    got = {r.chunk_id: r.embedding for r in store.upsert_vectors(writes, new).collect()}
    assert got == {"a": [7.0], "b": None, "c": [], "d": [5.0]}
    assert store.upsert_vectors(writes, new.limit(0)).count() == 3 and store.upsert_vectors(writes.limit(0), new).count() == 2


def test_deletes_and_what_they_leave(spark, writes):
    now = store.current_vectors(writes)
    assert {r.chunk_id for r in store.delete_vectors(now, ids(spark, "a", "a", "zz", None)).collect()} == {"b", "c"}
    sent = store.fan_out_deletes(ids(spark, "a", "a", None))
    assert {(r.engine, r.wait_mode) for r in sent.collect()} == {("pgvector", "sync"), ("qdrant", "async"), ("chroma", "sync")}
    held = spark.createDataFrame([("qdrant", "a"), ("qdrant", "b"), ("chroma", "b")], "engine string, chunk_id string")
    assert {(r.engine, r.chunk_id) for r in store.soft_deleted(held, sent).where("is_tombstone").collect()} == {("qdrant", "a")}


def test_shards(spark, writes):
    new = spark.range(25).select(F.format_string("c%02d", "id").alias("chunk_id"))
    rows = store.shard_numbers(new, "chunk_id", 10, 4).groupBy("shard").agg(F.count("*").alias("n"), F.min("chunk_id").alias("lo")).collect()
    assert {(r.shard, r.n, r.lo) for r in rows} == {(4, 10, "c00"), (5, 10, "c10"), (6, 5, "c20")}
    assert {r.chunk_id: r.embedding for r in store.merged_shards(writes, "row_seq").collect()} == {"a": [2.0], "b": None, "c": []}


def test_storage_ratios(spark, writes):
    r = store.storage_ratios(writes, ids(spark, "a", "b")).first()
    assert (r.n_writes, r.n_live, r.bytes_per_live_vector, r.dead_ratio) == (4, 2, 4.0, 0.5)
    r = store.storage_ratios(writes.limit(0), ids(spark).limit(0)).first()
    assert (r.n_writes, r.n_live, r.bytes_per_live_vector, r.dead_ratio) == (0, 0, None, None)


def test_baseline_and_first_commits(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    versions = spark.createDataFrame([("b", day(2)), ("a", day(2)), ("c", day(5)), ("c", day(1)), ("d", None), (None, day(3))], "commit_sha string, commit_date timestamp_ntz")
    assert replay.first_commit_since(versions, "2024-01-02").first().commit_sha == "a"
    assert [r.commit_sha for r in replay.first_commits(versions, 2).collect()] == ["c", "a"]
    with pytest.raises(ValueError, match="no commit"):
        replay.first_commit_since(versions, "2024-01-03")


def test_a_tokenizer_is_a_parameter(spark):
    """Words by spaces, sliced by words."""
    words = Tokenizer(lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")), lambda s, most: F.transform(F.sequence(F.lit(0), F.size(F.split(s, " ")) - 1, F.lit(most)), lambda k: F.array_join(F.slice(F.split(s, " "), k + 1, most), " ")))
    docs = spark.createDataFrame([(1, "a-b c-d e-f\n\ng-h"), (2, None), (3, "")], "id int, t string")
    got = [(r.ordinal, r.text, r.token_count) for r in chunk(docs, "id", "t", 2, 0, words).orderBy("ordinal").collect()]
    assert got == [(0, "a-b c-d", 2), (1, "e-f\n\ng-h", 2)]
