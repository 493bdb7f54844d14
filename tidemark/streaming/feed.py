"""The change feed as a stream: counted deliveries are kept by range of event ids, and of each range its composed patches.

A delivery that corrects an earlier one, in whatever batch, replaces it in its range, whose patches are then composed again; those of
all other ranges stay as they are. So the stream ends as the whole feed does, and a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.changefeed import compose, counted_deliveries, event_patches, in_ranges

KEYS = ["engine", "chunk_id"]
RANGE = 1 << 16
DELIVERIES, PATCHES = "deliveries", "patches"


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _folders(spark: SparkSession, root: str, prefix: str) -> dict[int, str]:
    """Subfolders named prefix=number, by number."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return {int(n.removeprefix(f"{prefix}=")): f"{root}/{n}" for n in names if n.startswith(f"{prefix}=")}


def _generations(spark: SparkSession, root: str, before: int) -> dict[int, list[int]]:
    """Of each range the batches before this one that wrote it, in order. A batch counts once its patches, written last, are complete."""
    jvm = spark.sparkContext._jvm
    out: dict[int, list[int]] = {}
    for batch, folder in sorted(_folders(spark, f"{root}/{PATCHES}", "batch").items()):
        done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if batch < before and done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            for part in _folders(spark, folder, "_range"):
                out.setdefault(part, []).append(batch)
    return out


def _latest(spark: SparkSession, root: str, what: str, known: dict[int, list[int]]) -> DataFrame | None:
    """The rows of the newest generation of each range."""
    paths = [f"{root}/{what}/batch={batches[-1]}/_range={part}" for part, batches in known.items()]
    return spark.read.parquet(*paths) if paths else None


def _delete_outdated(spark: SparkSession, root: str, known: dict[int, list[int]]) -> None:
    """Delete generations that a later one before the present batch has replaced; the present batch may yet be run again."""
    jvm = spark.sparkContext._jvm
    for part, batches in known.items():
        for batch in batches[:-1]:
            for what in (PATCHES, DELIVERIES):
                path = jvm.org.apache.hadoop.fs.Path(f"{root}/{what}/batch={batch}/_range={part}")
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def start(events: DataFrame, root: str, checkpoint: str, range_size: int = RANGE, **trigger: object) -> StreamingQuery:
    """Keep the state of a stream of events in ``root``; see ``current`` for what it says. A batch rewrites the ranges that it touches and no others.

    events: event_id, loaded_at, engine, chunk_id, op, expected_present. Rows without an id are ignored, as in a whole feed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cols = ["event_id", "loaded_at", *KEYS, "op", F.col("expected_present").cast("int").alias("expected_present")]
        new = in_ranges(batch.select(*cols), range_size)
        touched = [r["_range"] for r in new.select("_range").distinct().collect()]  # a row per range of ids in the batch
        if not touched:
            return
        known = _generations(spark, root, number)
        old = _latest(spark, root, DELIVERIES, {part: known[part] for part in touched if part in known})
        every = new if old is None else new.unionByName(in_ranges(old, range_size))
        counted = counted_deliveries(every.repartition("_range"), within=("_range",))
        counted.write.partitionBy("_range").mode("overwrite").parquet(f"{root}/{DELIVERIES}/batch={number}")
        written = in_ranges(spark.read.parquet(f"{root}/{DELIVERIES}/batch={number}").drop("_range"), range_size)
        patches = compose(event_patches(written.repartition("_range"), KEYS, ("_range",)), ["_range", *KEYS])
        patches.write.partitionBy("_range").mode("overwrite").parquet(f"{root}/{PATCHES}/batch={number}")
        _delete_outdated(spark, root, known)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, root: str) -> DataFrame:
    """(engine, chunk_id, expected_present) held after the last batch: the ranges' patches composed per key."""
    stored = _latest(spark, root, PATCHES, _generations(spark, root, 2**62))
    if stored is None:
        return spark.createDataFrame([], "engine string, chunk_id string, expected_present int")
    return compose(stored, KEYS).where("decided_held = 1").select(*KEYS, F.col("last_expected").alias("expected_present"))


def events_per_window(events: DataFrame, at: str = "applied_at", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events counted per engine, operation and time window; rows later than the watermark are left out, as a stream must."""
    stamped = events.withColumn("_at", F.col(at).cast("timestamp"))
    return (
        stamped.withWatermark("_at", late)
        .groupBy(F.window("_at", width).alias("w"), "engine", F.lower(F.trim("op")).alias("op"))
        .agg(F.count("*").alias("n_events"))
        .select(F.col("w.start").alias("window_start"), "engine", "op", "n_events")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Bursts of a commit's events: runs with no pause longer than the gap."""
    stamped = events.withColumn("_at", F.col("applied_at").cast("timestamp"))
    return (
        stamped.withWatermark("_at", late)
        .groupBy(F.session_window("_at", gap).alias("w"), "commit_sha")
        .agg(F.count("*").alias("n_events"))
        .select("commit_sha", F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), "n_events")
    )


def first_deliveries(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Each event id once, as first delivered, with state bounded by the watermark."""
    return events.withColumn("_at", F.col("loaded_at").cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(["event_id"]).drop("_at")
