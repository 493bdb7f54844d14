"""A vector store as a table: lookups by id, upserts, deletes in every engine's manner, and shards of new vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import dense_ids

# What an engine's delete does. An asynchronous one returns before the row is gone; without a vacuum or compaction its place stays taken.
DELETE_MODES = {"pgvector": ("sync", "dead_tuple"), "qdrant": ("async", "tombstone"), "chroma": ("sync", "no_compaction")}
SHARD_ROWS = 1000


def current_vectors(writes: DataFrame) -> DataFrame:
    """(chunk_id, row_seq, ...): of every id the last write; of equal numbers the greatest row. Writes without an id are ignored."""
    rest = [c for c in writes.columns if c not in ("chunk_id", "row_seq")]
    won = writes.where("chunk_id is not null").groupBy("chunk_id").agg(F.max(F.struct("row_seq", *rest)).alias("w"))
    return won.select("chunk_id", *[F.col("w")[c].alias(c) for c in ("row_seq", *rest)])


def lookup(store: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Every asked id once, with is_found and the store's row, whose fields are null where there is none.

    ids: the key; repeats and nulls are asked once and not at all. store: the key, each once. One shuffle join answers any number of ids.
    """
    asked = ids.where(F.col(key).isNotNull()).select(key).distinct()
    return asked.join(store.withColumn("is_found", F.lit(True)), key, "left").withColumn("is_found", F.coalesce("is_found", F.lit(False)))


def lookup_one(store: DataFrame, value: object, key: str = "chunk_id") -> DataFrame:
    """The row of one id, or none: an equality that reaches the scan, where files sorted by id leave one to be read."""
    return store.where(F.col(key) == F.lit(value))


def upsert_vectors(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("chunk_id",), order: str = "row_seq") -> DataFrame:
    """stored with new writes put over it: whatever their numbers, new ones come later; among them, and among stored ones, the highest counts."""
    rest = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("_batch", F.lit(0)).unionByName(new.select(*stored.columns).withColumn("_batch", F.lit(1)))
    known = both.dropna(subset=list(keys))
    won = known.groupBy(*keys).agg(F.max(F.struct("_batch", order, *[c for c in rest if c != order])).alias("w"))
    return won.select(*keys, *[F.col("w")[c].alias(c) for c in rest]).select(*stored.columns)


def delete_vectors(stored: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """stored without the rows of the ids. Unknown, repeated and null ids do nothing; neither are rows without an id deleted."""
    return stored.join(ids.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def fan_out_deletes(ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(engine, key, wait_mode, left_behind): one delete for every engine, and what it leaves in each until somebody cleans up."""
    modes = F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(w).alias("wait_mode"), F.lit(b).alias("left_behind")) for e, (w, b) in DELETE_MODES.items()])
    return ids.where(F.col(key).isNotNull()).select(key).distinct().select(key, F.explode(modes).alias("m")).select("m.engine", key, "m.wait_mode", "m.left_behind")


def soft_deleted(stored: DataFrame, deletes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """stored (engine, key, ...) with is_tombstone: rows stay and are marked, as engines keep them until a vacuum or compaction."""
    marks = deletes.select("engine", key, "left_behind").dropDuplicates(["engine", key])
    return stored.join(marks, ["engine", key], "left").withColumn("is_tombstone", F.col("left_behind").isNotNull())


def shard_numbers(new: DataFrame, order: str, rows: int = SHARD_ROWS, first: int = 0) -> DataFrame:
    """new with the shard that each row is written to: so many rows a shard in the given order, each shard a checkpoint of its own."""
    return dense_ids(new, [order], "_nth", start=0).withColumn("shard", (F.floor(F.col("_nth") / rows) + first).cast("int")).drop("_nth")


def merged_shards(shards: DataFrame, shard: Column | str = "shard") -> DataFrame:
    """(chunk_id, embedding) of all shards; of several rows of a chunk that of the highest shard."""
    rows = shards.where("chunk_id is not null").select("chunk_id", F.struct(F.col(shard) if isinstance(shard, str) else shard, "embedding").alias("s"))
    return rows.groupBy("chunk_id").agg(F.max("s").alias("s")).select("chunk_id", "s.embedding")


def storage_ratios(writes: DataFrame, live: DataFrame, dim_bytes: int = 4) -> DataFrame:
    """One row (n_writes, n_live, bytes_per_live_vector, dead_ratio): what all writes take up for each vector that is still live.

    writes: chunk_id, embedding, every write a row that stays until it is cleaned up. live: chunk_id, each once. Null where nothing is live.
    """
    n = writes.where("chunk_id is not null").groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("embedding"), F.lit(0)) * dim_bytes).alias("bytes"))
    each = n.join(live.select("chunk_id", F.lit(1).alias("live")), "chunk_id", "left")
    sums = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_writes"), F.count("live").alias("n_live"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return sums.select(
        "n_writes",
        "n_live",
        F.round(F.col("bytes") / F.nullif("n_live", F.lit(0)), 2).alias("bytes_per_live_vector"),
        F.round(1 - F.col("n_live") / F.nullif("n_writes", F.lit(0)), 6).alias("dead_ratio"),
    )
