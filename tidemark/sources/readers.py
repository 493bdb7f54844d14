"""Reading page trees, change lists, vector shards and manifests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import doc_id_of
from tidemark.operators.replay import parse_name_status

SHARD = T.StructType(
    [T.StructField("shard", T.IntegerType()), T.StructField("chunk_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


def markdown_tree(spark: SparkSession, root: str, content_root: str = "content/handbook", limit: int = 0) -> DataFrame:
    """(path, doc_id, text) of every .md file below a folder, bytes that are no UTF-8 replaced.

    limit takes that many files in the order of their paths; 0 takes all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    pages = files.select(F.col("path"), _lenient(F.col("content")).alias("text"))
    pages = pages.select("path", doc_id_of(F.col("path"), content_root).alias("doc_id"), "text")
    return pages.orderBy("path").limit(limit) if limit else pages


@F.pandas_udf(T.StringType())
def _decoded(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def _lenient(content: Column) -> Column:
    """Text of bytes; only where they are no valid UTF-8 are they decoded in Python."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(_decoded(content))


def change_list(spark: SparkSession, path: str) -> DataFrame:
    """(seq, commit_sha, action, old_path, new_path) from files of lines: place in the log, commit, then a status line, tab-separated."""
    lines = spark.read.text(path)
    head = F.split("value", "\t", 3)
    rows = lines.select(F.get(head, F.lit(0)).try_cast("bigint").alias("seq"), F.get(head, F.lit(1)).alias("commit_sha"), F.get(head, F.lit(2)).alias("line"))
    return parse_name_status(rows.where("seq is not null")).drop("line")


def vector_shards(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, embedding) of all shards, of several rows for a chunk that of the highest shard."""
    rows = spark.read.schema(SHARD).parquet(path)
    return rows.where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by("embedding", "shard").alias("embedding"))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON manifest, one object or an array of them, by a given schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def page(df: DataFrame, key: str, after: str | None, size: int) -> DataFrame:
    """The next page of ids after a cursor, in order: keyset paging, which never reads what it has passed."""
    rest = df if after is None else df.where(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(size)
