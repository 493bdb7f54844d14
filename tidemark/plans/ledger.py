"""Queries on the ledger and the audits of what the engines hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import neutral, ntz_text
from tidemark.operators import audit, ledger
from tidemark.operators.changefeed import counted_deliveries
from tidemark.operators.knn import exact_top_k
from tidemark.operators.near import near_links
from tidemark.operators.ordering import chain_ends, dense_ids
from tidemark.session import cut_lineage, table

ERASED = 40
NEAR_COPY = 0.98
STORE = "pgvector"
MOST_HITS = 10
#: Numbers of a stored vector.
DIM = 64


class Tables:
    """The ledger's tables of one data set, each in its current form."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.raw = lambda name: table(spark, sf_dir, name)
        self.documents = ledger.current_documents(self.raw("ledger_documents"))
        self.versions = ledger.distinct_versions(self.raw("doc_versions"))
        self.chunks = ledger.distinct_chunks(self.raw("chunks"))
        self.events = self.raw("index_events")

    @property
    def held(self) -> DataFrame:
        return ledger.held_chunks(self.events)

    @property
    def lineage(self) -> DataFrame:
        return ledger.chunk_lineage(self.chunks, self.versions, self.documents)

    @property
    def audited(self) -> DataFrame:
        return audit.audited(self.held, self.lineage)


def documents_upsert(spark, sf_dir):
    return Tables(spark, sf_dir).documents


def versions_numbered(spark, sf_dir):
    keys = ["doc_id", "commit_sha", "content_sha256", "action"]
    return dense_ids(ledger.natural_versions(table(spark, sf_dir, "doc_versions")), keys, "dense_id")


def latest_index_events(spark, sf_dir):
    return ledger.latest_events(table(spark, sf_dir, "index_events")).withColumn("applied_at", ntz_text(F.col("applied_at")))


def chunk_lineage(spark, sf_dir):
    dates = {c: ntz_text(F.col(c)) for c in ("version_date", "last_chunked_date")}
    return Tables(spark, sf_dir).lineage.withColumns(dates)


def deleted_doc_targets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ledger.deleted_targets(t.documents, t.chunks)


def erasure_targets(spark, sf_dir):
    return ledger.erasure_requests(Tables(spark, sf_dir).documents, ERASED, F.lit("head"))


def events_to_append(spark, sf_dir):
    return ledger.missing_events(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "index_events"))


def chunks_not_embedded(spark, sf_dir):
    stored = table(spark, sf_dir, "chunk_vectors").where("embedding is not null").select("chunk_id")
    return Tables(spark, sf_dir).chunks.select("chunk_id", "text_sha256").join(stored, "chunk_id", "left_anti")


def expected_vs_actual_drift(spark, sf_dir):
    """Chunks held though their last event says that they should be gone."""
    return Tables(spark, sf_dir).held.where("expected_present = 0").select("engine", "chunk_id")


def stale_chunks(spark, sf_dir):
    return Tables(spark, sf_dir).audited.where("is_stale").select("engine", "chunk_id")


def orphan_causes(spark, sf_dir):
    found = Tables(spark, sf_dir).audited
    return found.where("cause is not null").groupBy("engine", "cause").agg(F.count("*").alias("n_chunks"))


def exact_duplicates_held(spark, sf_dir):
    """Per engine: chunks held beyond the first of their text, texts held more than once, and chunks held."""
    found = Tables(spark, sf_dir).audited
    return found.groupBy("engine").agg(
        F.sum(F.col("is_excess").cast("int")).alias("excess"),
        F.sum(F.when(~F.col("is_excess") & (F.col("copies") > 1), 1).otherwise(0)).alias("clusters"),
        F.count("*").alias("n_held"),
    )


def venn_regions(spark, sf_dir):
    flags = Tables(spark, sf_dir).audited.withColumn("is_orphan", F.col("cause").isNotNull())
    return audit.venn(flags, ["is_stale", "is_orphan", "is_excess"], "engine")


def precision_recall(spark, sf_dir):
    """How well the orphan rule finds the chunks that the ledger no longer expects."""
    return audit.precision_recall(Tables(spark, sf_dir).audited, F.col("cause").isNotNull(), F.col("expected_present") == 0, "engine")


def engine_snapshot(spark, sf_dir):
    op = neutral("op")
    events = counted_deliveries(table(spark, sf_dir, "index_events").select("event_id", "loaded_at", "engine", "chunk_id", "op"))
    each = events.where(op.isin("upsert", "delete")).groupBy("engine", "chunk_id").agg(
        F.max_by(op, "event_id").alias("last_op"), F.max(op == "upsert").alias("ever_upserted")
    )
    return audit.tombstones(each)


def storage_persistence(spark, sf_dir):
    """Chunks of deleted documents' last versions, and how many of them each engine still holds."""
    t = Tables(spark, sf_dir)
    targets = ledger.deleted_targets(t.documents, t.chunks)
    wanted = t.chunks.join(targets.withColumnRenamed("last_chunked_version_id", "version_id"), ["doc_id", "version_id"], "left_semi").select("chunk_id")
    held = t.held.select("engine", "chunk_id", F.lit(1).alias("still"))
    each = ledger.per_engine(wanted).join(held, ["engine", "chunk_id"], "left")
    return each.groupBy("engine").agg(F.count("*").alias("n_targets"), F.count("still").alias("n_still_held"))


def rename_chain(spark, sf_dir):
    """Where each renamed document's chain of renames ends; null where it goes round."""
    renamed = Tables(spark, sf_dir).documents.where("renamed_to is not null")
    return chain_ends(renamed, "doc_id", "renamed_to")


def purge_documents(spark, sf_dir):
    """Rows left in each table once the synthetic documents are purged."""
    t = Tables(spark, sf_dir)
    left = ledger.purge(t.documents, t.versions, t.chunks, t.events, t.documents.where("is_synthetic_pii = 1"))
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def constraint_violations(spark, sf_dir):
    t = Tables(spark, sf_dir)
    raw = t.raw
    docs = audit.violations(
        raw("ledger_documents"),
        "ledger_documents",
        {"status": F.col("status").isin("live", "deleted", "renamed"), "is_synthetic_pii": F.col("is_synthetic_pii").isin(0, 1), "source_path": F.col("source_path").isNotNull()},
    )
    versions = audit.violations(raw("doc_versions"), "doc_versions", {"action": F.col("action").isin("add", "update", "delete", "rename"), "commit_date": F.col("commit_date").isNotNull()})
    events = audit.violations(
        t.events,
        "index_events",
        {"op": F.col("op").isin("upsert", "delete", "skip"), "engine": F.col("engine").isin(*ledger.ENGINES), "expected_present": F.col("expected_present").isNotNull()},
    )
    unknown = t.events.select("chunk_id").join(t.chunks.select("chunk_id"), "chunk_id", "left_anti")
    foreign = unknown.agg(F.count("*").alias("n_rows")).select(F.lit("index_events").alias("table_name"), F.lit("chunk_id").alias("rule"), "n_rows")
    return docs.unionByName(versions).unionByName(events).unionByName(foreign)


def chunks_by_version(spark, sf_dir):
    """Each version's chunks: their number, tokens, and first and last by ordinal."""
    return Tables(spark, sf_dir).chunks.where("version_id is not null").groupBy("version_id").agg(
        F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens"), F.min_by("chunk_id", F.struct("ordinal", "chunk_id")).alias("first_chunk"), F.max_by("chunk_id", F.struct("ordinal", "chunk_id")).alias("last_chunk")
    )


def events_by_commit(spark, sf_dir):
    """Events counted by commit, engine and kind; a commit that holds a tenth of all rows is reduced before it moves."""
    events = counted_deliveries(table(spark, sf_dir, "index_events").select("event_id", "loaded_at", "engine", "op", "commit_sha"))
    return events.groupBy("commit_sha", "engine", neutral("op").alias("op")).agg(F.count("*").alias("n_events"))


def status_counts(spark, sf_dir):
    return Tables(spark, sf_dir).documents.groupBy("status").agg(F.count("*").alias("n_docs"))


def near_duplicate_chunks(spark, sf_dir):
    """Stored chunks outside exact text clusters with other stored chunks at least 0.98 similar, and with how many.

    Every chunk that pgvector holds is judged. Those in exact clusters, whose text several held chunks share, aren't listed but count as others.
    """
    t = Tables(spark, sf_dir)
    held = cut_lineage(t.held.where(F.col("engine") == STORE).select("engine", "chunk_id"))
    links = near_links(t.raw("chunk_vectors").join(held.select("chunk_id"), "chunk_id", "left_semi"), NEAR_COPY)
    clustered = audit.duplicate_places(held.join(t.chunks.select("chunk_id", "text_sha256"), "chunk_id")).where("copies > 1").select("chunk_id")
    return links.where("n_links > 0").join(clustered, "chunk_id", "left_anti")


def _still_found(t: Tables, targets: DataFrame) -> DataFrame:
    """How far the chunks of targets' last chunked versions are found among what pgvector holds, by their own current vectors.

    targets: doc_id, last_chunked_version_id. A chunk that was never stored has no vector to search with and is no target.
    """
    body = F.struct("row_seq", "embedding")
    latest = t.raw("chunk_vectors").where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(body, "row_seq").alias("b"))
    rows = latest.join(t.chunks.select("chunk_id", "doc_id", "version_id", "text_sha256"), "chunk_id", "left").select("chunk_id", F.col("b.row_seq").alias("id"), "b.embedding", "doc_id", "version_id", "text_sha256")
    rows = cut_lineage(rows.join(t.held.where(F.col("engine") == STORE).select("chunk_id", F.lit(True).alias("is_held")), "chunk_id", "left"))
    held = rows.where("is_held")
    wanted = rows.join(targets.select("doc_id", F.col("last_chunked_version_id").alias("version_id")), ["doc_id", "version_id"], "left_semi")
    return audit.retrievable(wanted, exact_top_k(wanted, held, MOST_HITS, exclude_self=False, dim=DIM), held)


def deleted_retrievable(spark, sf_dir):
    """How many last chunks of deleted documents a search still finds within 5 and 10: by id, by document and by text."""
    t = Tables(spark, sf_dir)
    return _still_found(t, ledger.deleted_targets(t.documents, t.chunks))


def erased_retrievable(spark, sf_dir):
    """The same of documents whose erasure is requested."""
    t = Tables(spark, sf_dir)
    asked = ledger.erasure_requests(t.documents, ERASED, F.lit("head")).where(F.col("engine") == STORE)
    return _still_found(t, asked.select("doc_id").join(ledger.last_chunked(t.chunks), "doc_id"))


NAMES = (
    documents_upsert, versions_numbered, latest_index_events, chunk_lineage, deleted_doc_targets, erasure_targets, events_to_append, chunks_not_embedded,
    expected_vs_actual_drift, stale_chunks, orphan_causes, exact_duplicates_held, venn_regions, precision_recall, engine_snapshot, storage_persistence,
    rename_chain, purge_documents, constraint_violations, chunks_by_version, events_by_commit, status_counts, near_duplicate_chunks,
    deleted_retrievable, erased_retrievable,
)
QUERIES = {q.__name__: q for q in NAMES}

_BASE = """WITH RECURSIVE
 documents_now AS (SELECT doc_id, arg_min(first_seen_commit, (snapshot_at, loaded_at)) first_seen_commit,
     arg_max(struct_pack(source_path, last_seen_commit, status := lower(trim(status)), renamed_to := nullif(trim(renamed_to), ''), is_synthetic_pii),
         (snapshot_at, loaded_at)) l
     FROM ledger_documents WHERE nullif(trim(status), '') IS NOT NULL GROUP BY doc_id),
 docs AS (SELECT doc_id, l.source_path, first_seen_commit, l.last_seen_commit, l.status, l.renamed_to, l.is_synthetic_pii FROM documents_now),
 vers AS (SELECT * FROM (SELECT version_id, doc_id, commit_sha, commit_date, lower(content_sha256) content_sha256, lower(trim(action)) action,
     row_number() OVER (PARTITION BY version_id ORDER BY loaded_at DESC) rn FROM doc_versions) WHERE rn = 1),
 chks AS (SELECT * FROM (SELECT chunk_id, doc_id, version_id, ordinal, text_sha256, token_count,
     row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) rn FROM chunks) WHERE rn = 1),
 counted AS (SELECT * FROM (SELECT event_id, engine, chunk_id, lower(trim(op)) op, expected_present, commit_sha,
     row_number() OVER (PARTITION BY event_id ORDER BY loaded_at DESC) rn, applied_at FROM index_events) WHERE rn = 1),
 ev AS (SELECT * FROM counted WHERE op IS NOT NULL),
 state AS (SELECT engine, chunk_id, arg_max(op, event_id) FILTER (WHERE op <> 'skip') last_op, bool_or(op = 'upsert') ever,
     arg_max(coalesce(expected_present, CASE op WHEN 'upsert' THEN 1 ELSE 0 END), event_id) expected_present FROM ev GROUP BY ALL),
 held AS (SELECT engine, chunk_id, expected_present FROM state WHERE last_op = 'upsert'),
 last_chunked AS (SELECT doc_id, max(version_id) last_chunked_version_id FROM chks WHERE doc_id IS NOT NULL GROUP BY doc_id),
 lineage AS (SELECT c.doc_id, c.version_id, chunk_id, ordinal, text_sha256, v.action version_action, d.status doc_status, renamed_to, last_seen_commit,
     strftime(v.commit_date, '%Y-%m-%d %H:%M:%S') version_date, strftime(lv.commit_date, '%Y-%m-%d %H:%M:%S') last_chunked_date, l.last_chunked_version_id FROM chks c JOIN vers v USING (version_id) JOIN docs d ON d.doc_id = c.doc_id JOIN last_chunked l ON l.doc_id = c.doc_id
     JOIN vers lv ON lv.version_id = l.last_chunked_version_id),
 known AS (SELECT h.engine, h.chunk_id, h.expected_present, coalesce(doc_status = 'live' AND version_id <> last_chunked_version_id, false) is_stale,
     CASE WHEN doc_status IN ('deleted', 'renamed') THEN doc_status WHEN version_id <> last_chunked_version_id THEN 'superseded_live_doc' END cause,
     row_number() OVER (PARTITION BY engine, text_sha256 ORDER BY h.chunk_id) > 1 is_excess, count(*) OVER (PARTITION BY engine, text_sha256) copies
     FROM held h JOIN lineage USING (chunk_id)),
 engines AS (SELECT unnest(['pgvector', 'qdrant', 'chroma']) engine),
 targets AS (SELECT doc_id, last_seen_commit, last_chunked_version_id FROM docs JOIN last_chunked USING (doc_id) WHERE status = 'deleted' AND coalesce(is_synthetic_pii, 0) = 0),
 links AS (SELECT doc_id, renamed_to FROM docs WHERE renamed_to IS NOT NULL),
 walk AS (SELECT doc_id source, renamed_to at_doc, 1::BIGINT steps FROM links
     UNION ALL SELECT source, links.renamed_to, steps + 1 FROM walk JOIN links ON links.doc_id = walk.at_doc WHERE steps <= (SELECT count(*) FROM links) AND steps < 200),
 dead AS (SELECT doc_id FROM docs WHERE is_synthetic_pii = 1)
"""

_STILL_FOUND = """, pg AS (SELECT chunk_id FROM held WHERE engine = 'pgvector'),
 v AS (SELECT chunk_id, max(row_seq) id, arg_max(struct_pack(e := embedding), row_seq).e::DOUBLE[] e FROM chunk_vectors WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
 r AS (SELECT v.*, c.doc_id, c.version_id, c.text_sha256, len(e) = 64 AND list_max(list_transform(e, lambda x: abs(x))) > 0 good FROM v LEFT JOIN chks c USING (chunk_id)),
 q AS (SELECT r.* FROM r JOIN ({wanted}) w ON r.doc_id = w.doc_id AND r.version_id = w.last_chunked_version_id),
 o AS (SELECT r.* FROM r SEMI JOIN pg USING (chunk_id) WHERE good),
 hits AS (SELECT q.id qid, o.id oid, o.doc_id d, o.text_sha256 h, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.e, o.e), 6) DESC, o.id) k FROM q, o WHERE q.good),
 ranks AS (SELECT q.id, min(k) FILTER (WHERE oid = q.id) exact_id, min(k) FILTER (WHERE d = q.doc_id) doc_scoped, min(k) FILTER (WHERE h = q.text_sha256) content_scoped
     FROM q LEFT JOIN hits ON qid = q.id AND k <= 10 GROUP BY q.id),
 long AS (FROM ranks UNPIVOT INCLUDE NULLS (a FOR mode IN (exact_id, doc_scoped, content_scoped)))
 SELECT k, mode, count(*) n_targets, sum((coalesce(a, 999) <= k)::INT)::BIGINT n_found FROM long, (VALUES (5), (10)) ks(k) GROUP BY ALL"""

_SELECTS = {
    "deleted_retrievable": _STILL_FOUND.format(wanted="SELECT doc_id, last_chunked_version_id FROM targets"),
    "erased_retrievable": _STILL_FOUND.format(
        wanted=f"SELECT l.* FROM last_chunked l JOIN (SELECT doc_id FROM docs WHERE is_synthetic_pii = 1 ORDER BY sha256('pii-erasure-2.3:' || doc_id) LIMIT {ERASED}) USING (doc_id)"
    ),
    "documents_upsert": "SELECT * FROM docs",
    "versions_numbered": """SELECT *, row_number() OVER (ORDER BY doc_id, commit_sha, content_sha256, action) dense_id
        FROM (SELECT DISTINCT doc_id, commit_sha, content_sha256, action FROM vers)""",
    "latest_index_events": """SELECT engine, chunk_id, max(event_id) event_id, arg_max(op, event_id) op, arg_max(struct_pack(e := expected_present), event_id).e expected_present,
        arg_max(commit_sha, event_id) commit_sha, strftime(arg_max(struct_pack(a := applied_at), event_id).a, '%Y-%m-%d %H:%M:%S') applied_at FROM ev GROUP BY engine, chunk_id""",
    "near_duplicate_chunks": f""", pg AS (SELECT chunk_id FROM held WHERE engine = 'pgvector'),
        v AS (SELECT chunk_id, arg_max(struct_pack(e := embedding), row_seq).e::DOUBLE[] e FROM chunk_vectors SEMI JOIN pg USING (chunk_id) GROUP BY chunk_id),
        u AS (SELECT * FROM v WHERE len(e) = 64 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
        clustered AS (SELECT unnest(list(chunk_id)) chunk_id FROM pg JOIN chks USING (chunk_id) WHERE text_sha256 IS NOT NULL GROUP BY text_sha256 HAVING count(*) > 1)
        SELECT a.chunk_id, count(*) n_links FROM u a JOIN u b ON a.chunk_id <> b.chunk_id AND round(list_cosine_similarity(a.e, b.e), 6) >= {NEAR_COPY}
        WHERE a.chunk_id NOT IN (SELECT chunk_id FROM clustered) GROUP BY ALL""",
    "chunk_lineage": "SELECT * FROM lineage",
    "deleted_doc_targets": "SELECT * FROM targets",
    "erasure_targets": f"""SELECT doc_id, 'head' requested_at_commit, engine, 1 expected_absent FROM engines, (SELECT doc_id FROM docs
        WHERE is_synthetic_pii = 1 ORDER BY sha256('pii-erasure-2.3:' || doc_id) LIMIT {ERASED})""",
    "events_to_append": """SELECT engine, chunk_id FROM engines, (SELECT DISTINCT chunk_id FROM chunks)
        EXCEPT SELECT engine, chunk_id FROM index_events WHERE lower(trim(op)) = 'upsert'""",
    "chunks_not_embedded": "SELECT chunk_id, text_sha256 FROM chks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_vectors WHERE embedding IS NOT NULL)",
    "expected_vs_actual_drift": "SELECT engine, chunk_id FROM held WHERE expected_present = 0",
    "stale_chunks": "SELECT engine, chunk_id FROM known WHERE is_stale",
    "orphan_causes": "SELECT engine, cause, count(*) n_chunks FROM known WHERE cause IS NOT NULL GROUP BY ALL",
    "exact_duplicates_held": """SELECT engine, count(*) FILTER (WHERE is_excess) excess, count(*) FILTER (WHERE copies > 1 AND NOT is_excess) clusters, count(*) n_held
        FROM known GROUP BY engine""",
    "venn_regions": "SELECT engine, is_stale::INT + 2 * (cause IS NOT NULL)::INT + 4 * is_excess::INT region, count(*) n_chunks FROM known GROUP BY ALL",
    "precision_recall": """SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) recall FROM (SELECT engine,
        count(*) FILTER (WHERE cause IS NOT NULL AND expected_present = 0) tp, count(*) FILTER (WHERE cause IS NOT NULL AND expected_present <> 0) fp,
        count(*) FILTER (WHERE cause IS NULL AND expected_present = 0) fn FROM known GROUP BY engine)""",
    "engine_snapshot": """SELECT *, round(n_dead / nullif(n_live + n_dead, 0), 6) dead_ratio FROM (SELECT engine, count(*) n_chunks,
        count(*) FILTER (WHERE last_op = 'upsert') n_live, count(*) FILTER (WHERE last_op = 'delete' AND ever) n_dead
        FROM state WHERE last_op IS NOT NULL GROUP BY engine)""",
    "storage_persistence": """SELECT e.engine, count(*) n_targets, count(h.chunk_id) n_still_held FROM engines e, (SELECT chunk_id FROM chks c JOIN targets t
        ON t.doc_id = c.doc_id AND t.last_chunked_version_id = c.version_id) w LEFT JOIN held h ON h.engine = e.engine AND h.chunk_id = w.chunk_id GROUP BY e.engine""",
    "rename_chain": """SELECT source, arg_max(at_doc, steps) FILTER (WHERE NOT looped) AS "end", max(steps) FILTER (WHERE NOT looped) steps
        FROM (SELECT *, max(steps) OVER (PARTITION BY source) >= 200 OR max(steps) OVER (PARTITION BY source) > (SELECT count(*) FROM links) looped FROM walk) GROUP BY source""",
    "purge_documents": """SELECT 'documents' table_name, count(*) n_rows FROM docs WHERE doc_id NOT IN (FROM dead)
        UNION ALL SELECT 'doc_versions', count(*) FROM vers WHERE doc_id NOT IN (FROM dead)
        UNION ALL SELECT 'chunks', count(*) FROM chks WHERE doc_id IS NULL OR doc_id NOT IN (FROM dead)
        UNION ALL SELECT 'index_events', count(*) FROM index_events WHERE chunk_id NOT IN (SELECT chunk_id FROM chks WHERE doc_id IN (FROM dead))""",
    "constraint_violations": """SELECT 'ledger_documents' table_name, 'status' AS rule, count(*) n_rows FROM ledger_documents WHERE status NOT IN ('live', 'deleted', 'renamed')
        UNION ALL SELECT 'ledger_documents', 'is_synthetic_pii', count(*) FROM ledger_documents WHERE is_synthetic_pii NOT IN (0, 1)
        UNION ALL SELECT 'ledger_documents', 'source_path', count(*) FROM ledger_documents WHERE source_path IS NULL
        UNION ALL SELECT 'doc_versions', 'action', count(*) FROM doc_versions WHERE action NOT IN ('add', 'update', 'delete', 'rename')
        UNION ALL SELECT 'doc_versions', 'commit_date', count(*) FROM doc_versions WHERE commit_date IS NULL
        UNION ALL SELECT 'index_events', 'op', count(*) FROM index_events WHERE op NOT IN ('upsert', 'delete', 'skip')
        UNION ALL SELECT 'index_events', 'engine', count(*) FROM index_events WHERE engine NOT IN ('pgvector', 'qdrant', 'chroma')
        UNION ALL SELECT 'index_events', 'expected_present', count(*) FROM index_events WHERE expected_present IS NULL
        UNION ALL SELECT 'index_events', 'chunk_id', count(*) FROM index_events WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks)""",
    "chunks_by_version": """SELECT version_id, count(*) n_chunks, sum(token_count)::BIGINT tokens, arg_min(chunk_id, (ordinal, chunk_id)) first_chunk, arg_max(chunk_id, (ordinal, chunk_id)) last_chunk
        FROM chks WHERE version_id IS NOT NULL GROUP BY version_id""",
    "events_by_commit": "SELECT commit_sha, engine, op, count(*) n_events FROM counted GROUP BY ALL",
    "status_counts": "SELECT status, count(*) n_docs FROM docs GROUP BY status",
}
SQL = {name: _BASE + q for name, q in _SELECTS.items()}
