"""The ledger: current documents, versions, chunks and what each engine is expected to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import ERASURE_SALT, salted_hash
from tidemark.functions.times import neutral
from tidemark.operators.changefeed import apply_feed, counted_deliveries

ENGINES = ("pgvector", "qdrant", "chroma")


def per_engine(df: DataFrame) -> DataFrame:
    """Each row once for every engine."""
    return df.withColumn("engine", F.explode(F.array(*[F.lit(e) for e in ENGINES])))


def current_documents(snapshots: DataFrame) -> DataFrame:
    """One row per document as upserts leave it: the first commit is kept, all else comes from the last row with a status.

    A last row without renamed_to takes an earlier one away.
    """
    at = F.struct("snapshot_at", "loaded_at")
    status = neutral("status")
    last = F.struct(
        "source_path", "last_seen_commit", status.alias("status"), F.nullif(F.trim("renamed_to"), F.lit("")).alias("renamed_to"), "is_synthetic_pii"
    )
    known = snapshots.where(F.col("doc_id").isNotNull() & status.isNotNull())
    return known.groupBy("doc_id").agg(F.min_by("first_seen_commit", at).alias("first_seen_commit"), F.max_by(last, at).alias("l")).select(
        "doc_id", "l.source_path", "first_seen_commit", "l.last_seen_commit", "l.status", "l.renamed_to", "l.is_synthetic_pii"
    )


def distinct_versions(versions: DataFrame) -> DataFrame:
    """Each version id once, as loaded last, with action and hash in one spelling."""
    body = F.struct("loaded_at", "doc_id", "commit_sha", "commit_date", F.lower("content_sha256").alias("content_sha256"), neutral("action").alias("action"))
    return versions.where("version_id is not null").groupBy("version_id").agg(F.max(body).alias("b")).select("version_id", "b.*")


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    body = F.struct("loaded_at", "doc_id", "version_id", "ordinal", "text_sha256", "token_count")
    return chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max(body).alias("b")).select("chunk_id", "b.*")


def natural_versions(versions: DataFrame) -> DataFrame:
    """Versions by their natural key, each once: document, commit, content and action."""
    return distinct_versions(versions).select("doc_id", "commit_sha", "content_sha256", "action").distinct()


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of each engine and chunk, whatever it is; one aggregate instead of a join with the greatest ids."""
    last = F.struct("event_id", neutral("op").alias("op"), "expected_present", "commit_sha", "applied_at")
    return (
        counted_deliveries(events.select("event_id", "loaded_at", "engine", "chunk_id", "op", "expected_present", "commit_sha", "applied_at"))
        .where(neutral("op").isNotNull() & F.col("engine").isNotNull() & F.col("chunk_id").isNotNull())
        .groupBy("engine", "chunk_id")
        .agg(F.max(last).alias("e"))
        .select("engine", "chunk_id", "e.*")
    )


def last_chunked(chunks: DataFrame) -> DataFrame:
    """(doc_id, last_chunked_version_id): from the chunks, so that versions without any, as deletions are, don't count."""
    return chunks.where("doc_id is not null").groupBy("doc_id").agg(F.max("version_id").alias("last_chunked_version_id"))


def chunk_lineage(chunks: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Each chunk with its version, its document's state and the version last chunked; all inner joins."""
    v = versions.select("version_id", F.col("action").alias("version_action"), F.col("commit_date").alias("version_date"))
    d = documents.select("doc_id", F.col("status").alias("doc_status"), "renamed_to", "last_seen_commit")
    last = last_chunked(chunks).join(
        versions.select(F.col("version_id").alias("last_chunked_version_id"), F.col("commit_date").alias("last_chunked_date")), "last_chunked_version_id"
    )
    return (
        chunks.select("chunk_id", "doc_id", "version_id", "ordinal", "text_sha256")
        .join(v, "version_id")
        .join(d, "doc_id")
        .join(last, "doc_id")
    )


def deleted_targets(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, last_seen_commit, last_chunked_version_id) of deleted documents that once had chunks, synthetic ones left out."""
    gone = documents.where("status = 'deleted' and coalesce(is_synthetic_pii, 0) = 0").select("doc_id", "last_seen_commit")
    return gone.join(last_chunked(chunks), "doc_id")


def hash_ranked(df: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """The n rows whose salted hash comes first: a sample that depends on the keys alone."""
    return df.orderBy(salted_hash(F.col(key), salt), key).limit(n)


def erasure_requests(documents: DataFrame, n: int, commit: Column, salt: str = ERASURE_SALT) -> DataFrame:
    """One request per engine for the first n synthetic documents by salted hash."""
    chosen = hash_ranked(documents.where("is_synthetic_pii = 1").select("doc_id"), "doc_id", salt, n)
    return per_engine(chosen).select("doc_id", commit.alias("requested_at_commit"), "engine", F.lit(1).alias("expected_absent"))


def missing_events(chunks: DataFrame, events: DataFrame, op: str = "upsert") -> DataFrame:
    """(engine, chunk_id) for which no event of the kind is logged yet: what a resumed run still has to append."""
    logged = events.where(neutral("op") == op).select("engine", "chunk_id").distinct()
    return per_engine(chunks.select("chunk_id").distinct()).select("engine", "chunk_id").join(logged, ["engine", "chunk_id"], "left_anti")


def purge(documents: DataFrame, versions: DataFrame, chunks: DataFrame, events: DataFrame, doomed: DataFrame) -> dict[str, DataFrame]:
    """The four tables without everything of the doomed documents (doc_id): events go by their chunks."""
    ids = doomed.select("doc_id").distinct()
    gone = chunks.join(ids, "doc_id", "left_semi").select("chunk_id").distinct()
    return {
        "index_events": events.join(gone, "chunk_id", "left_anti"),
        "chunks": chunks.join(ids, "doc_id", "left_anti"),
        "doc_versions": versions.join(ids, "doc_id", "left_anti"),
        "documents": documents.join(ids, "doc_id", "left_anti"),
    }


def held_chunks(events: DataFrame) -> DataFrame:
    return apply_feed(events)


def upsert(base: DataFrame, new: DataFrame, keys: list[str], order: str, keep_first: list[str] = []) -> DataFrame:  # noqa: B006
    """base with new rows put over it: per key the row last by ``order``, except keep_first, which stay as they first came."""
    rest = [c for c in base.columns if c not in (*keys, *keep_first)]
    both = base.unionByName(new.select(*base.columns))
    done = both.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), order).alias("_l"), *[F.min_by(c, order).alias(c) for c in keep_first]
    )
    return done.select(*keys, *[F.col("_l")[c].alias(c) for c in rest], *keep_first).select(*base.columns)


def insert_if_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base and those new rows whose keys it lacks, the least of several."""
    rest = [c for c in new.columns if c not in keys]
    fresh = new.join(base.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r"))
    return base.unionByName(fresh.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]))
