"""Queries of the general problems: differing copies, orphans, histories and the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import iso_micros, neutral, ntz_micros, ntz_text
from tidemark.operators.changefeed import apply_feed
from tidemark.operators.diff import Field, diff_copies
from tidemark.operators.history import attribute_history
from tidemark.operators.orphans import orphan_references, orphan_report
from tidemark.session import table

VECTOR_TOLERANCE = 0.001


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_feed(table(spark, sf_dir, "index_events"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, copy = table(spark, sf_dir, "chunk_vectors"), table(spark, sf_dir, "vector_copy")
    fields = [
        Field("doc_id"),
        Field("version_id"),
        Field("token_count"),
        Field("updated_at", ntz_micros("updated_at"), iso_micros("updated_at")),
        Field("embedding", tolerance=VECTOR_TOLERANCE),
    ]
    copies = diff_copies(stored, copy, "chunk_id", fields, "row_seq", "not_in_chunk_vectors", "not_in_vector_copy")
    events = table(spark, sf_dir, "index_events")
    held = apply_feed(events).where("engine = 'pgvector'").select("chunk_id")
    feed = diff_copies(stored.select("chunk_id"), held, "chunk_id", [], None, "not_in_chunk_vectors", "not_in_index_events")
    out = lambda df, what: df.select(F.lit(what).alias("compared_with"), "chunk_id", "difference")
    return out(copies, "vector_copy").unionByName(out(feed, "index_events"))


def p2_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences counted by kind."""
    return p2_found(spark, sf_dir).groupBy("compared_with", "difference").agg(F.count("*").alias("n_keys"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, vectors = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_vectors")
    ledger, versions = table(spark, sf_dir, "ledger_documents"), table(spark, sf_dir, "doc_versions")
    never = F.lit(None).cast("timestamp_ntz")
    status = neutral("status")
    docs = ledger.groupBy(F.col("doc_id").alias("parent_key")).agg(
        (F.max_by(status, F.when(F.col("status").isNotNull(), F.struct("snapshot_at", "loaded_at"))) == "deleted").alias("is_deleted"),
        never.alias("first_at"),
    )
    made = versions.groupBy(F.col("version_id").alias("parent_key")).agg(
        F.max(F.coalesce(neutral("action") == "delete", F.lit(False))).alias("is_deleted"), F.min("loaded_at").alias("first_at")
    )
    known = chunks.groupBy(F.col("chunk_id").alias("parent_key")).agg(F.lit(False).alias("is_deleted"), F.min("loaded_at").alias("first_at"))
    refs = lambda df, ref, at: df.select(F.col("chunk_id").alias("child_key"), F.col(ref).alias("ref"), F.col(at).alias("at"))
    return (
        orphan_references(refs(chunks, "doc_id", "loaded_at"), docs, "chunks", "doc_id")
        .unionByName(orphan_references(refs(chunks, "version_id", "loaded_at"), made, "chunks", "version_id"))
        .unionByName(orphan_references(refs(vectors, "chunk_id", "updated_at"), known, "chunk_vectors", "chunk_id"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(spark, sf_dir)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(orphans(spark, sf_dir))


def content_events(versions: DataFrame) -> DataFrame:
    """doc_versions as (entity, at, rank, value); null dates are taken from other rows of the commit.

    Only rows without a date look theirs up, so the dated bulk isn't shuffled by commit.
    """
    at = F.col("commit_date")
    action = neutral("action")
    value = F.when(action.isin("add", "update"), F.lower("content_sha256"))
    slim = versions.where(action.isin("add", "update", "delete", "rename")).select(
        "doc_id", "commit_sha", "commit_date", "version_id", value.alias("value")
    )
    dates = versions.where(at.isNotNull()).groupBy("commit_sha").agg(F.max("commit_date").alias("given"))
    undated = slim.where(at.isNull()).join(dates, "commit_sha").withColumn("commit_date", F.col("given")).drop("given")
    every = slim.where(at.isNotNull()).unionByName(undated)
    return every.select(F.col("doc_id").alias("entity"), F.col("commit_date").alias("at"), F.col("version_id").alias("rank"), "value")


def state_events(ledger: DataFrame) -> DataFrame:
    status, to = neutral("status"), F.nullif(F.trim("renamed_to"), F.lit(""))
    value = F.to_json(F.struct(status.alias("status"), F.when(to.isNotNull(), F.col("renamed_to")).alias("renamed_to")))
    return ledger.where(status.isNotNull()).select(
        F.col("doc_id").alias("entity"), F.col("snapshot_at").alias("at"), F.col("loaded_at").alias("rank"), value.alias("value")
    )


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = attribute_history(content_events(table(spark, sf_dir, "doc_versions")))
    state = attribute_history(state_events(table(spark, sf_dir, "ledger_documents")), common_snapshots=True, span="year")
    return content.withColumn("history", F.lit("content")).unionByName(state.withColumn("history", F.lit("state")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histories(spark, sf_dir).select(
        "history",
        F.col("entity").alias("doc_id"),
        ntz_text(F.col("valid_from")).alias("valid_from"),
        F.coalesce(ntz_text(F.col("valid_to")), F.lit("open")).alias("valid_to"),
    )


QUERIES = {
    "p2_found": p2_found,
    "p2_by_field": p2_by_field,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p6_found": p6_found,
}

_HELD = """
 counted AS (SELECT event_id, engine, chunk_id, lower(trim(op)) op, expected_present,
     row_number() OVER (PARTITION BY event_id ORDER BY loaded_at DESC) rn FROM index_events),
 ev AS (SELECT * FROM counted WHERE rn = 1 AND op IN ('upsert', 'delete', 'skip')),
 state AS (SELECT engine, chunk_id,
     arg_max(op, event_id) FILTER (WHERE op <> 'skip') last_op,
     arg_max(coalesce(expected_present, CASE op WHEN 'upsert' THEN 1 ELSE 0 END), event_id) expected_present
     FROM ev GROUP BY engine, chunk_id),
 held AS (SELECT engine, chunk_id, expected_present FROM state WHERE last_op = 'upsert')"""

_P2 = f"""WITH {_HELD},
 v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY row_seq DESC) rn FROM chunk_vectors) WHERE rn = 1),
 c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY row_seq DESC) rn FROM vector_copy) WHERE rn = 1),
 b AS (SELECT v.chunk_id, v.doc_id d1, c.doc_id d2, v.version_id v1, c.version_id v2, v.token_count t1, c.token_count t2,
     v.updated_at AT TIME ZONE 'UTC' u1, CAST(c.updated_at AS TIMESTAMPTZ) u2, v.embedding e1, c.embedding e2
     FROM v JOIN c USING (chunk_id))
 SELECT 'vector_copy' compared_with, chunk_id, 'not_in_vector_copy' difference FROM v WHERE chunk_id NOT IN (SELECT chunk_id FROM c)
 UNION ALL SELECT 'vector_copy', chunk_id, 'not_in_chunk_vectors' FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM v)
 UNION ALL SELECT 'vector_copy', chunk_id, 'doc_id' FROM b WHERE d1 IS DISTINCT FROM d2
 UNION ALL SELECT 'vector_copy', chunk_id, 'version_id' FROM b WHERE v1 IS DISTINCT FROM v2
 UNION ALL SELECT 'vector_copy', chunk_id, 'token_count' FROM b WHERE t1 IS DISTINCT FROM t2
 UNION ALL SELECT 'vector_copy', chunk_id, 'updated_at' FROM b WHERE u1 IS DISTINCT FROM u2
 UNION ALL SELECT 'vector_copy', chunk_id, 'embedding' FROM b WHERE (e1 IS NULL) <> (e2 IS NULL) OR len(e1) <> len(e2)
     OR (len(e1) = len(e2) AND list_max(list_transform(range(1, len(e1) + 1), lambda i: abs(e1[i]::DOUBLE - e2[i]::DOUBLE))) > {VECTOR_TOLERANCE})
 UNION ALL SELECT 'index_events', chunk_id, 'not_in_index_events' FROM (SELECT DISTINCT chunk_id FROM chunk_vectors)
     WHERE chunk_id NOT IN (SELECT chunk_id FROM held WHERE engine = 'pgvector')
 UNION ALL SELECT 'index_events', chunk_id, 'not_in_chunk_vectors' FROM held WHERE engine = 'pgvector'
     AND chunk_id NOT IN (SELECT chunk_id FROM chunk_vectors)"""

_P3 = """WITH
 docs AS (SELECT doc_id, arg_max(lower(trim(status)), (snapshot_at, loaded_at)) FILTER (WHERE status IS NOT NULL) last_status
     FROM ledger_documents GROUP BY doc_id),
 vers AS (SELECT version_id, bool_or(lower(trim(action)) = 'delete') deleted, min(loaded_at) first_at FROM doc_versions GROUP BY version_id),
 first_chunk AS (SELECT chunk_id, min(loaded_at) first_at FROM chunks GROUP BY chunk_id),
 first_vector AS (SELECT chunk_id, min(updated_at) t0 FROM chunk_vectors GROUP BY chunk_id),
 bad AS (
 SELECT 'chunks' child_table, 'doc_id' child_field, chunk_id child_key,
     CASE WHEN docs.doc_id IS NULL THEN 1 WHEN last_status = 'deleted' THEN 2 END kind, first_at t0
     FROM chunks JOIN first_chunk USING (chunk_id) LEFT JOIN docs ON docs.doc_id = chunks.doc_id WHERE chunks.doc_id IS NOT NULL
 UNION ALL SELECT 'chunks', 'version_id', chunk_id,
     CASE WHEN vers.version_id IS NULL THEN 1 WHEN deleted THEN 2 WHEN vers.first_at > first_chunk.first_at THEN 3 END, first_chunk.first_at
     FROM chunks JOIN first_chunk USING (chunk_id) LEFT JOIN vers ON vers.version_id = chunks.version_id WHERE chunks.version_id IS NOT NULL
 UNION ALL SELECT 'chunk_vectors', 'chunk_id', v.chunk_id, CASE WHEN f.chunk_id IS NULL THEN 1 WHEN f.first_at > v.t0 THEN 3 END, v.t0
     FROM first_vector v LEFT JOIN first_chunk f ON f.chunk_id = v.chunk_id),
 found AS (SELECT child_table, child_field, child_key, min(kind) k, min(t0) t0 FROM bad WHERE kind IS NOT NULL GROUP BY ALL)
 SELECT child_table, child_field, child_key, CASE k WHEN 1 THEN 'missing' WHEN 2 THEN 'deleted' ELSE 'late' END kind,
     strftime(t0, '%Y-%m') period FROM found"""

_P4 = """WITH
 sha AS (SELECT commit_sha, max(commit_date) given FROM doc_versions GROUP BY commit_sha),
 content AS (SELECT 'content' history, doc_id, coalesce(commit_date, given) t0, version_id::VARCHAR::BIGINT AS rnk,
     CASE WHEN lower(trim(action)) IN ('add', 'update') THEN lower(content_sha256) END val
     FROM doc_versions JOIN sha USING (commit_sha) WHERE lower(trim(action)) IN ('add', 'update', 'delete', 'rename')),
 state AS (SELECT 'state' history, doc_id, snapshot_at t0, epoch_us(loaded_at) rnk,
     lower(trim(status)) || '|' || coalesce(nullif(trim(renamed_to), ''), '') val FROM ledger_documents WHERE nullif(trim(status), '') IS NOT NULL),
 one AS (SELECT history, doc_id, t0, val FROM (SELECT *, row_number() OVER (PARTITION BY history, doc_id, t0 ORDER BY rnk DESC) rn
     FROM (SELECT * FROM content UNION ALL SELECT * FROM state) WHERE t0 IS NOT NULL) WHERE rn = 1),
 marked AS (SELECT *, row_number() OVER w nth, lag(val) OVER w before FROM one WINDOW w AS (PARTITION BY history, doc_id ORDER BY t0)),
 changed AS (SELECT *, lead(t0) OVER (PARTITION BY history, doc_id ORDER BY t0) until FROM marked WHERE nth = 1 OR val IS DISTINCT FROM before)
 SELECT history, doc_id, strftime(t0, '%Y-%m-%d %H:%M:%S') valid_from, coalesce(strftime(until, '%Y-%m-%d %H:%M:%S'), 'open') valid_to
 FROM changed WHERE val IS NOT NULL"""

SQL = {
    "p2_found": _P2,
    "p2_by_field": f"SELECT compared_with, difference, count(*) n_keys FROM ({_P2}) GROUP BY ALL",
    "p3_found": _P3,
    "p3_report": f"SELECT child_table, child_field, kind, period, count(*) refs FROM ({_P3}) GROUP BY ALL",
    "p4_found": _P4,
    "p6_found": f"WITH {_HELD} SELECT * FROM held",
}
