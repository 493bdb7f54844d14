"""Writing vectors, events, shards and manifests so that a run can be repeated or resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.store import SHARD_ROWS, shard_numbers
from tidemark.session import cut_lineage
from tidemark.sources.readers import SHARD


def write_vectors(df: DataFrame, path: str, parts: int | None = None) -> None:
    """Vectors sorted by chunk id, so that the files' ranges of ids don't overlap and lookups read one of them."""
    ranged = df.repartitionByRange(parts, "chunk_id") if parts else df.repartitionByRange("chunk_id")
    ranged.sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(path)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys the table at ``path`` lacks, and return them: a second run appends nothing."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        there = None
    fresh = df.dropDuplicates(keys)
    if there is not None:
        fresh = fresh.join(there.select(*keys), keys, "left_anti")
    fresh = cut_lineage(fresh)  # what is returned must be what was written, though the table now has it
    fresh.write.mode("append").parquet(path)
    return fresh


def _known_shards(df: DataFrame, path: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.schema(SHARD).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def write_shards(df: DataFrame, path: str, manifest: str, rows: int = SHARD_ROWS) -> int:
    """Append the vectors (chunk_id, embedding) that no shard has yet, as shards of so many rows, and each shard's row to the manifest; returns how many shards.

    A run that is stopped is run again: what was written is not written again, and shards that the manifest lacks are added to it.
    """
    spark = df.sparkSession
    known = _known_shards(df, path)
    fresh = df.where("chunk_id is not null").dropDuplicates(["chunk_id"])
    first = 0
    if known is not None:
        fresh = fresh.join(known.select("chunk_id"), "chunk_id", "left_anti")
        first = (known.agg(F.max("shard")).first()[0] or 0) + 1
    made = shard_numbers(fresh.select("chunk_id", "embedding"), "chunk_id", rows, first).select("shard", "chunk_id", "embedding").to(SHARD)
    made.withColumn("part", F.col("shard")).repartition("part").write.mode("append").partitionBy("part").parquet(path)
    now = spark.read.schema(SHARD).parquet(path).groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"))
    return append_missing(now, manifest, ["shard"]).count()


def write_shard(df: DataFrame, path: str, shard: int) -> int:
    """Append vectors (chunk_id, embedding) that no shard has yet, as a shard of their own; returns how many."""
    spark = df.sparkSession
    known = _known_shards(df, path)
    fresh = df if known is None else df.join(known.select("chunk_id"), "chunk_id", "left_anti")
    fresh = fresh.select(F.lit(shard).cast("int").alias("shard"), "chunk_id", "embedding")
    fresh.to(SHARD).write.mode("overwrite").parquet(f"{path}/part={shard}")
    return spark.read.parquet(f"{path}/part={shard}").count()


def write_manifest(summary: DataFrame, path: str) -> None:
    """A summary of few rows as one JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)
