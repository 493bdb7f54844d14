"""Deterministic vectors of texts, for runs without a model: hashed bags of tokens; and checks of stored vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chunker import TOKEN

DIM = 64


def _bucket(token: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def _sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(token), 9, 1), 16, 10).cast("int") < 8, 1).otherwise(-1)


def hashed_vectors(texts: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, embedding): unit vectors of signed token counts per hash bucket; a text without tokens has none.

    Equal texts should be given once, by their hash. Tokens are reduced to buckets before they move, so a long text moves ``dim`` sums.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    each = texts.select(key, F.explode(tokens).alias("t"))
    sums = each.groupBy(key, _bucket(F.col("t"), dim).alias("b")).agg(F.sum(_sign(F.col("t"))).alias("s"))
    maps = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "s"))).alias("m"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("n"))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("n")).cast("float"))
    return maps.where("n > 0").select(key, numbers.alias("embedding"))


#: Makes (text_sha256, embedding) of (text_sha256, text), each text given once; a text may have none.
Embedder = Callable[[DataFrame], DataFrame]


def by_hash(dim: int = DIM) -> Embedder:
    return lambda texts: hashed_vectors(texts, "text_sha256", "text", dim)


def embed_texts(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """(chunk_id, embedding) of chunks (chunk_id, text, text_sha256) by any embedder, each distinct text embedded once."""
    texts = chunks.where("text is not null").groupBy("text_sha256").agg(F.min("text").alias("text"))
    return chunks.select("chunk_id", "text_sha256").join(embedder(texts), "text_sha256").drop("text_sha256")


def embed_by_hash(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    return embed_texts(chunks, by_hash(dim))


def hash_mismatches(rebuilt: DataFrame, stored: DataFrame) -> DataFrame:
    """(chunk_id, problem): chunks to be embedded again whose rebuilt text (chunk_id, text) isn't the one stored (chunk_id, text_sha256).

    A repair goes ahead only if there is none.
    """
    both = rebuilt.select("chunk_id", F.sha2("text", 256).alias("now")).join(stored.select("chunk_id", F.col("text_sha256").alias("then")), "chunk_id", "left")
    problem = F.when(F.col("then").isNull(), "unknown").when(F.col("now").isNull() | (F.col("now") != F.col("then")), "changed")
    return both.select("chunk_id", problem.alias("problem")).where("problem is not null")


def verified_backfill(manifest: DataFrame, versions: DataFrame, chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """(chunk_id, embedding) of the documents of a manifest, whose texts were made again; an error if any isn't the text once stored.

    manifest: doc_id, text, one chunk a document. versions: doc_id, version_id. chunks: chunk_id, version_id, text_sha256. A document of which
    no chunk is known is a mismatch too. Nothing is embedded before all are verified.
    """
    made = manifest.join(versions.select("doc_id", "version_id"), "doc_id", "left").join(chunks.select("version_id", "chunk_id", "text_sha256"), "version_id", "left")
    now = F.sha2("text", 256)
    wrong = made.where(F.col("chunk_id").isNull() | F.col("text").isNull() | ~F.col("text_sha256").eqNullSafe(now))
    some = [r["doc_id"] for r in wrong.select("doc_id").limit(10).collect()]
    if some:
        raise ValueError(f"texts differ from those stored, as of {some}")
    return embed_texts(made.select("chunk_id", "text", "text_sha256"), embedder)
