import json

from pyspark.sql import functions as F
from test_changefeed import EVENTS, model, random_feed

from tidemark.operators.changefeed import apply_feed
from tidemark.sources import readers, writers
from tidemark.streaming import feed


def test_markdown_tree(spark, tmp_path):
    root = tmp_path / "content/handbook"
    (root / "a").mkdir(parents=True)
    (root / "a/x.md").write_bytes(b"caf\xc3\xa9\r\n")
    (root / "a/bad.md").write_bytes(b"caf\xe9")
    (root / "y.v2.md").write_text("y")
    (root / "z.txt").write_text("no")
    got = {r.doc_id: r.text for r in readers.markdown_tree(spark, str(tmp_path)).collect()}
    assert got == {"a/x": "café\r\n", "a/bad": "caf�", "y.v2": "y"}
    assert [r.doc_id for r in readers.markdown_tree(spark, str(tmp_path), limit=1).collect()] == ["a/bad"]


def test_change_list(spark, tmp_path):
    (tmp_path / "log.txt").write_text("1\tc1\tA\ta.md\n2\tc1\tR100\ta.md\tb.md\nnonsense\n3\tc2\tD\tpic.png\n")
    got = [tuple(r) for r in readers.change_list(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [(1, "c1", "add", None, "a.md"), (2, "c1", "rename", "a.md", "b.md")]


def test_shards_resume_and_later_ones_win(spark, tmp_path):
    path = str(tmp_path / "shards")
    df = lambda *ids: spark.createDataFrame([(i, [float(len(i))]) for i in ids], "chunk_id string, embedding array<float>")
    assert writers.write_shard(df("a", "bb"), path, 0) == 2
    assert writers.write_shard(df("a", "bb", "ccc"), path, 1) == 1
    spark.createDataFrame([(7, "a", [9.0])], readers.SHARD).write.parquet(f"{path}/part=7")
    assert {r.chunk_id: r.embedding for r in readers.vector_shards(spark, path).collect()} == {"a": [9.0], "bb": [2.0], "ccc": [3.0]}


def test_many_shards_with_a_manifest(spark, tmp_path):
    path, manifest = str(tmp_path / "shards"), str(tmp_path / "manifest")
    df = lambda n: spark.range(n).select(F.format_string("c%03d", "id").alias("chunk_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    assert [writers.write_shards(df(n), path, manifest, 10) for n in (25, 25, 32, 0)] == [3, 0, 1, 0]
    rows = sorted((r.shard, r.n_rows, r.first_id, r.last_id) for r in spark.read.parquet(manifest).collect())
    assert rows == [(0, 10, "c000", "c009"), (1, 10, "c010", "c019"), (2, 5, "c020", "c024"), (3, 7, "c025", "c031")]
    assert {r.chunk_id: r.embedding for r in readers.vector_shards(spark, path).collect()} == {f"c{i:03d}": [float(i)] for i in range(32)}


def test_append_missing_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "events")
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("a", "y", 1)], "engine string, chunk_id string, n int")
    assert [writers.append_missing(df, path, ["engine", "chunk_id"]).count() for _ in range(2)] == [2, 0]
    assert spark.read.parquet(path).count() == 2


def test_sorted_vectors_manifest_and_pages(spark, tmp_path):
    df = spark.range(100).select(F.format_string("c%03d", "id").alias("chunk_id"), F.array(F.lit(1.0)).alias("embedding"))
    writers.write_vectors(df, str(tmp_path / "v"), 4)
    back = spark.read.parquet(str(tmp_path / "v"))
    seen, after = [], None
    while rows := readers.page(back, "chunk_id", after, 30).collect():
        seen += [r.chunk_id for r in rows]
        after = seen[-1]
    assert seen == [f"c{i:03d}" for i in range(100)]
    writers.write_manifest(df.agg(F.count("*").alias("n")), str(tmp_path / "m"))
    assert readers.manifest(spark, str(tmp_path / "m"), "n bigint").first().n == 100
    (tmp_path / "list.json").write_text(json.dumps([{"n": 1}, {"n": 2}]))
    assert readers.manifest(spark, str(tmp_path / "list.json"), "n bigint").count() == 2


def test_streamed_feed_ends_as_the_whole_feed_does(spark, tmp_path):
    rows = random_feed(8, 300)  # corrected and repeated deliveries come in other batches too
    for i in range(0, len(rows), 60):
        spark.createDataFrame(rows[i : i + 60], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = feed.start(feed.event_stream(spark, str(tmp_path / "in"), EVENTS, 1), str(tmp_path / "state"), str(tmp_path / "ckpt"), range_size=50_000)
        assert q.awaitTermination(120)
    got = [tuple(r) for r in feed.current(spark, str(tmp_path / "state")).collect()]
    whole = apply_feed(spark.createDataFrame(rows, EVENTS)).collect()
    assert set(got) == model(rows) == {tuple(r) for r in whole} and len(got) == len(whole)
    kept = feed._generations(spark, str(tmp_path / "state"), 2**62)
    assert len(kept) >= 6 and max(map(len, kept.values())) <= 2
    assert feed.current(spark, str(tmp_path / "nothing")).count() == 0


def test_windows_and_sessions_on_a_stream(spark, tmp_path):
    rows = spark.sql(
        "select id as event_id, 'a' as engine, if(id % 2 = 0, 'upsert', ' DELETE') as op, 'c' as commit_sha, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 10) as applied_at, timestamp_ntz'2024-01-01 00:00:00' as loaded_at from range(12) union all select 0, 'a', 'upsert', 'c', timestamp_ntz'2024-01-01 09:00:00', timestamp_ntz'2024-01-01 00:00:00'"
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("w", feed.events_per_window(stream()), "complete"), ("s", feed.sessions(stream()), "complete"), ("d", feed.first_deliveries(stream()), "append")):
        q = df.writeStream.format("memory").queryName(f"out_{name}").outputMode(mode).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert {(r.window_start.hour, r.op, r.n_events) for r in spark.table("out_w").collect()} == {(0, "upsert", 3), (0, "delete", 3), (1, "upsert", 3), (1, "delete", 3), (9, "upsert", 1)}
    assert sorted(r.n_events for r in spark.table("out_s").collect()) == [1, 12]
    assert spark.table("out_d").count() == 12
