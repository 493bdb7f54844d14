"""Queries on the vector stores, and on how documents, versions and requests stand against them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import neutral, ntz_text
from tidemark.operators import audit, ledger, overlay, store
from tidemark.operators.changefeed import counted_deliveries
from tidemark.operators.knn import exact_top_k, with_empty
from tidemark.operators.ordering import dense_ids
from tidemark.operators.replay import first_commit_since, first_commits
from tidemark.plans.ledger import _BASE, DIM, ERASED, STORE, Tables
from tidemark.session import table

#: The day from which on the first commit is the baseline.
BASELINE_FROM = "2024-03-01"
FIRST_COMMITS = 50
TWENTIETH = "(row_seq div 2) % 20 = 0"
HITS = 10
STAFF = 100
SAMPLED = 200


def _stored(spark, sf_dir: str) -> DataFrame:
    return store.current_vectors(table(spark, sf_dir, "chunk_vectors"))


def _deleted_in_store(t: Tables) -> DataFrame:
    """Chunks whose last upsert or delete in the store is a delete."""
    op = neutral("op")
    events = counted_deliveries(t.events.select("event_id", "loaded_at", "engine", "chunk_id", "op"))
    last = events.where((F.col("engine") == STORE) & op.isin("upsert", "delete")).groupBy("chunk_id").agg(F.max_by(op, "event_id").alias("last_op"))
    return last.where("last_op = 'delete'").select("chunk_id")


def point_lookup(spark, sf_dir):
    """Every known chunk looked up in the store."""
    found = store.lookup(_stored(spark, sf_dir), table(spark, sf_dir, "chunks"))
    return found.select("chunk_id", "is_found", "row_seq", "token_count")


def vectors_upserted(spark, sf_dir):
    """The store once the other engine's copy has been written over it."""
    cols = ["chunk_id", "row_seq", "doc_id", "version_id", "token_count"]
    return store.upsert_vectors(table(spark, sf_dir, "chunk_vectors").select(*cols), table(spark, sf_dir, "vector_copy").select(*cols))


def vectors_deleted(spark, sf_dir):
    """The store's current rows without the chunks that were deleted from it."""
    return store.delete_vectors(_stored(spark, sf_dir), _deleted_in_store(Tables(spark, sf_dir))).select("chunk_id", "row_seq")


def delete_fan_out(spark, sf_dir):
    """The store's deletes sent to all engines: per engine how they are done, and how many chunks held there become tombstones."""
    t = Tables(spark, sf_dir)
    deletes = store.fan_out_deletes(_deleted_in_store(t))
    marked = store.soft_deleted(t.held, deletes)
    sent = deletes.groupBy("engine", "wait_mode", "left_behind").agg(F.count("*").alias("n_deletes"))
    kept = marked.groupBy("engine").agg(F.count("*").alias("n_held"), F.sum(F.col("is_tombstone").cast("int")).alias("n_tombstones"))
    return sent.join(kept, "engine")


def shard_layout(spark, sf_dir):
    """Shards to which the chunks not embedded yet are written, with their rows and range of ids."""
    stored = table(spark, sf_dir, "chunk_vectors").where("embedding is not null").select("chunk_id")
    new = Tables(spark, sf_dir).chunks.select("chunk_id").join(stored, "chunk_id", "left_anti")
    return store.shard_numbers(new, "chunk_id").groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"))


def shards_merged(spark, sf_dir):
    """The writes of the store read as shards, of which later ones win."""
    rows = table(spark, sf_dir, "chunk_vectors")
    merged = store.merged_shards(rows, F.col("row_seq").alias("shard"))
    return merged.select("chunk_id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("n_numbers"))


def storage_per_vector(spark, sf_dir):
    live = Tables(spark, sf_dir).held.where(F.col("engine") == STORE)
    return store.storage_ratios(table(spark, sf_dir, "chunk_vectors"), live)


def erasure_presence(spark, sf_dir):
    """Per request that expects absence: chunks of the document's last chunked version, and how many of them the engine still holds."""
    t = Tables(spark, sf_dir)
    asked = ledger.erasure_requests(t.documents, ERASED, F.lit("head")).where("expected_absent = 1")
    wanted = asked.join(ledger.last_chunked(t.chunks), "doc_id").withColumnRenamed("last_chunked_version_id", "version_id")
    chunks = wanted.join(t.chunks.select("doc_id", "version_id", "chunk_id"), ["doc_id", "version_id"])
    met = chunks.join(t.held.select("engine", "chunk_id", F.lit(1).alias("present")), ["engine", "chunk_id"], "left")
    return met.groupBy("doc_id", "engine").agg(F.count("*").alias("n_chunks"), F.count("present").alias("n_present"))


def max_versions(spark, sf_dir):
    """Each document's last version and the last one that was chunked, which differ where the last one is a deletion or a rename."""
    t = Tables(spark, sf_dir)
    every = t.versions.where("doc_id is not null").groupBy("doc_id").agg(F.max("version_id").alias("max_version_id"))
    return every.join(ledger.last_chunked(t.chunks), "doc_id", "full")


def chunk_places(spark, sf_dir):
    """Each version's chunks in order: their place counts from 1 and is found from one dense numbering of all chunks."""
    rows = Tables(spark, sf_dir).chunks.where("version_id is not null").select("version_id", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), "chunk_id")
    numbered = dense_ids(rows, ["version_id", "ordinal", "chunk_id"], "_id")
    first = numbered.groupBy("version_id").agg(F.min("_id").alias("_first"))
    return numbered.join(first, "version_id").select("version_id", (F.col("_id") - F.col("_first") + 1).alias("place"), "chunk_id")


def audit_percentages(spark, sf_dir):
    """The regions of the audit's flags with their part of all held chunks, in per cent."""
    flags = Tables(spark, sf_dir).audited.withColumn("is_orphan", F.col("cause").isNotNull())
    regions = audit.venn(flags, ["is_stale", "is_orphan", "is_excess"], "engine")
    totals = regions.groupBy("engine").agg(F.sum("n_chunks").alias("n_all"))
    return regions.join(totals, "engine").select("engine", "region", "n_chunks", audit.share_of(F.col("n_chunks"), F.col("n_all")).alias("percent"))


def check_precision_recall(spark, sf_dir):
    """How well checks that look at the store alone find what the ledger says is stale, orphaned or an exact duplicate.

    From the store's own fields: a chunk is stale if it has a later version of its document, orphaned if that or if no live document has its
    id, and a duplicate if an earlier chunk has an equal vector.
    """
    t = Tables(spark, sf_dir)
    held = t.held.where(F.col("engine") == STORE).select("chunk_id")
    rows = _stored(spark, sf_dir).join(held, "chunk_id", "left_semi").select("chunk_id", "doc_id", "version_id", F.md5(F.to_json(F.struct("embedding"))).alias("print"))
    newest = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("version_id").alias("newest"))
    firsts = rows.groupBy("print").agg(F.min("chunk_id").alias("first_id"))
    live = t.documents.where("status = 'live'").select("doc_id", F.lit(True).alias("is_live"))
    seen = rows.join(newest, "doc_id", "left").join(live, "doc_id", "left").join(firsts, "print")
    stale = F.coalesce(F.col("version_id") < F.col("newest"), F.lit(False))
    said = seen.select("chunk_id", stale.alias("said_stale"), (stale | F.col("is_live").isNull()).alias("said_orphan"), (F.col("chunk_id") != F.col("first_id")).alias("said_duplicate"))
    truth = t.audited.where(F.col("engine") == STORE).select("chunk_id", F.col("is_stale").alias("true_stale"), F.col("cause").isNotNull().alias("true_orphan"), F.col("is_excess").alias("true_duplicate"))
    both = said.join(truth, "chunk_id", "full").fillna(False)
    checks = F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(f"said_{c}").alias("said"), F.col(f"true_{c}").alias("true")) for c in ("stale", "orphan", "duplicate")])
    each = both.select(F.explode(checks).alias("c")).select("c.*")
    return audit.precision_recall(each, F.col("said"), F.col("true"), "check_name")


def baseline_commit(spark, sf_dir):
    """The first commit on or after the day from which the baseline counts."""
    return first_commit_since(table(spark, sf_dir, "doc_versions"), BASELINE_FROM).select("commit_sha", ntz_text(F.col("commit_date")).alias("commit_date"))


def baseline_documents(spark, sf_dir):
    """Documents first seen in the baseline's commit, with their first version there."""
    t = Tables(spark, sf_dir)
    sha = first_commit_since(t.raw("doc_versions"), BASELINE_FROM).first()["commit_sha"]
    docs = t.documents.where(F.col("first_seen_commit") == sha).select("doc_id", "status")
    first = t.versions.where(F.col("commit_sha") == sha).groupBy("doc_id").agg(F.min("version_id").alias("version_id"))
    return docs.join(first, "doc_id", "left")


def first_commit_versions(spark, sf_dir):
    """Versions made by the first commits of the log."""
    t = Tables(spark, sf_dir)
    head = first_commits(t.raw("doc_versions"), FIRST_COMMITS).select("commit_sha")
    made = t.versions.join(F.broadcast(head), "commit_sha", "left_semi")  # FIRST_COMMITS rows
    return made.groupBy("commit_sha", "action").agg(F.count("*").alias("n_versions"))


def hit_lists_of_stored(spark, sf_dir):
    """What the stored vectors of every twentieth write find; those without usable numbers have an empty list, not none."""
    rows = table(spark, sf_dir, "chunk_vectors").select(F.col("row_seq").alias("id"), "embedding")
    queries = table(spark, sf_dir, "chunk_vectors").where(TWENTIETH).select(F.col("row_seq").alias("id"), "embedding")
    lists = with_empty(queries, exact_top_k(queries, rows, HITS, dim=DIM))
    return lists.select("query_id", F.size("hits").alias("n_hits"), F.get("hits", F.lit(0))["match_id"].alias("first_match"))


def live_self_match(spark, sf_dir):
    """A sample of what the store holds, each searched with its own vector: how many find themselves among the first hits."""
    held = Tables(spark, sf_dir).held.where(F.col("engine") == STORE).select("chunk_id")
    rows = _stored(spark, sf_dir).join(held, "chunk_id", "left_semi").select(F.col("chunk_id").alias("id"), "embedding")
    usable = rows.where((F.size("embedding") == DIM) & F.exists("embedding", lambda x: x != 0))
    asked = usable.join(F.broadcast(ledger.hash_ranked(usable.select("id"), "id", "self-match", SAMPLED)), "id", "left_semi")  # SAMPLED rows
    hits = exact_top_k(asked, rows, HITS, exclude_self=False, dim=DIM)
    return hits.agg(F.countDistinct("query_id").alias("n_queries"), F.count_if(F.col("query_id") == F.col("match_id")).alias("n_found"))


def engine_counters(spark, sf_dir):
    """Per engine: chunks held, those among them that should be gone, and requests that expect absence."""
    t = Tables(spark, sf_dir)
    held = t.held.groupBy("engine").agg(F.count("*").alias("n_held"), F.count_if(F.col("expected_present") == 0).alias("n_unexpected"))
    asked = ledger.erasure_requests(t.documents, ERASED, F.lit("head")).where("expected_absent = 1").groupBy("engine").agg(F.count("*").alias("n_requests"))
    return held.join(asked, "engine", "left").fillna(0, ["n_requests"])


def chunks_inserted(spark, sf_dir):
    """The known chunks and, of the store's, those that the ledger lacks; a chunk that is there stays as it is."""
    cols = ["chunk_id", "doc_id", "version_id", "token_count"]
    return ledger.insert_if_absent(Tables(spark, sf_dir).chunks.select(*cols), _stored(spark, sf_dir).select(*cols), ["chunk_id"])


def events_appended(spark, sf_dir):
    """The upserts that no engine has logged yet, numbered after the last event."""
    t = Tables(spark, sf_dir)
    last = t.events.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
    return dense_ids(ledger.missing_events(t.raw("chunks").where("chunk_id is not null"), t.events), ["engine", "chunk_id"], "event_id", last + 1)


def pii_migration(spark, sf_dir):
    """The ledger's tables once the first synthetic document has given way to a made-up staff directory: rows of each, and those of the directory."""
    t = Tables(spark, sf_dir)
    legacy = t.documents.where("is_synthetic_pii = 1").agg(F.min("doc_id")).first()[0]
    pages = overlay.profile_pages(overlay.employees(spark, STAFF))
    out = overlay.migrate(t.documents, t.versions, t.chunks, t.events, legacy, pages, "overlay")
    key = {"index_events": "chunk_id"}
    count = lambda name, df: df.agg(F.count("*").alias("n_rows"), F.count(F.when(F.col(key.get(name, "doc_id")).startswith(overlay.FOLDER), 1)).alias("n_staff")).select(F.lit(name).alias("table_name"), "n_rows", "n_staff")
    return reduce(DataFrame.unionByName, [count(name, df) for name, df in out.items()])


NAMES = (
    point_lookup, vectors_upserted, vectors_deleted, delete_fan_out, shard_layout, shards_merged, storage_per_vector, erasure_presence, max_versions, chunk_places,
    audit_percentages, check_precision_recall, baseline_commit, baseline_documents, first_commit_versions, hit_lists_of_stored, live_self_match, engine_counters, chunks_inserted,
    events_appended, pii_migration,
)
QUERIES = {q.__name__: q for q in NAMES}

_MORE = f""",
 store AS (SELECT chunk_id, max(row_seq) row_seq, arg_max(struct_pack(d := doc_id, v := version_id, t := token_count, e := embedding), row_seq) w
     FROM chunk_vectors WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
 gone AS (SELECT chunk_id FROM state WHERE engine = 'pgvector' AND last_op = 'delete'),
 modes(engine, wait_mode, left_behind) AS (VALUES ('pgvector', 'sync', 'dead_tuple'), ('qdrant', 'async', 'tombstone'), ('chroma', 'sync', 'no_compaction')),
 commits AS (SELECT commit_sha, min(commit_date) commit_date FROM doc_versions WHERE commit_date IS NOT NULL GROUP BY commit_sha),
 base AS (SELECT * FROM commits WHERE commit_date >= TIMESTAMP '{BASELINE_FROM}' ORDER BY commit_date, commit_sha LIMIT 1),
 requests AS (SELECT doc_id FROM docs WHERE is_synthetic_pii = 1 ORDER BY sha256('pii-erasure-2.3:' || doc_id) LIMIT {ERASED}),
 legacy AS (SELECT min(doc_id) doc_id FROM docs WHERE is_synthetic_pii = 1),
 pg AS (SELECT s.* FROM store s SEMI JOIN (SELECT chunk_id FROM held WHERE engine = 'pgvector') USING (chunk_id)),
 said AS (SELECT chunk_id, coalesce(w.v < max(w.v) OVER (PARTITION BY w.d), false) AND w.d IS NOT NULL stale,
     w.d IS NULL OR w.d NOT IN (SELECT doc_id FROM docs WHERE status = 'live') dead, chunk_id <> min(chunk_id) OVER (PARTITION BY w.e) dup FROM pg),
 checked AS (SELECT coalesce(s.stale, false) s1, coalesce(k.is_stale, false) t1, coalesce(s.stale OR s.dead, false) s2, coalesce(k.cause IS NOT NULL, false) t2,
     coalesce(s.dup, false) s3, coalesce(k.is_excess, false) t3 FROM said s FULL JOIN (SELECT * FROM known WHERE engine = 'pgvector') k USING (chunk_id)),
 judged AS (SELECT 'stale' check_name, s1 s, t1 t FROM checked UNION ALL SELECT 'orphan', s2, t2 FROM checked UNION ALL SELECT 'duplicate', s3, t3 FROM checked)
"""

_SELECTS = {
    "point_lookup": "SELECT c.chunk_id, s.chunk_id IS NOT NULL is_found, row_seq, w.t token_count FROM (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) c LEFT JOIN store s USING (chunk_id)",
    "vectors_upserted": """SELECT chunk_id, w.s row_seq, w.d doc_id, w.v version_id, w.t token_count FROM (SELECT chunk_id, arg_max(struct_pack(s := row_seq, d := doc_id, v := version_id, t := token_count), (b, row_seq)) w
        FROM (SELECT 0 b, chunk_id, row_seq, doc_id, version_id, token_count FROM chunk_vectors UNION ALL SELECT 1, chunk_id, row_seq, doc_id, version_id, token_count FROM vector_copy) WHERE chunk_id IS NOT NULL GROUP BY chunk_id)""",
    "vectors_deleted": "SELECT chunk_id, row_seq FROM store WHERE chunk_id NOT IN (FROM gone)",
    "delete_fan_out": """SELECT m.*, (SELECT count(*) FROM gone) n_deletes, h.n_held, h.n_tombstones FROM modes m JOIN (SELECT engine, count(*) n_held,
        count(*) FILTER (WHERE chunk_id IN (FROM gone)) n_tombstones FROM held GROUP BY engine) h USING (engine) WHERE EXISTS (FROM gone)""",
    "shard_layout": """SELECT ((n - 1) // 1000)::INT shard, count(*) n_rows, min(chunk_id) first_id, max(chunk_id) last_id FROM (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) n FROM chks
        WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_vectors WHERE embedding IS NOT NULL AND chunk_id IS NOT NULL)) GROUP BY 1""",
    "shards_merged": "SELECT chunk_id, coalesce(len(w.e), -1)::INT n_numbers FROM store",
    "storage_per_vector": """SELECT n_writes, n_live, round(bytes / nullif(n_live, 0), 2) bytes_per_live_vector, round(1 - n_live / nullif(n_writes, 0), 6) dead_ratio FROM (SELECT count(*) n_writes,
        (SELECT count(*) FROM pg) n_live, sum(coalesce(len(embedding), 0) * 4)::DOUBLE bytes FROM chunk_vectors WHERE chunk_id IS NOT NULL)""",
    "erasure_presence": """SELECT r.doc_id, e.engine, count(*) n_chunks, count(h.chunk_id) n_present FROM requests r JOIN last_chunked l USING (doc_id)
        JOIN chks c ON c.doc_id = r.doc_id AND c.version_id = l.last_chunked_version_id CROSS JOIN engines e LEFT JOIN held h ON h.engine = e.engine AND h.chunk_id = c.chunk_id GROUP BY ALL""",
    "max_versions": """SELECT doc_id, max_version_id, last_chunked_version_id FROM (SELECT doc_id, max(version_id) max_version_id FROM vers WHERE doc_id IS NOT NULL GROUP BY doc_id) v
        FULL JOIN last_chunked USING (doc_id)""",
    "chunk_places": "SELECT version_id, row_number() OVER (PARTITION BY version_id ORDER BY coalesce(ordinal, -1), chunk_id) place, chunk_id FROM chks WHERE version_id IS NOT NULL",
    "audit_percentages": """SELECT engine, region, n_chunks, round(100 * n_chunks / sum(n_chunks) OVER (PARTITION BY engine), 2) AS "percent" FROM (
        SELECT engine, is_stale::INT + 2 * (cause IS NOT NULL)::INT + 4 * is_excess::INT region, count(*) n_chunks FROM known GROUP BY ALL)""",
    "check_precision_recall": """SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) recall FROM (SELECT check_name, count(*) FILTER (WHERE s AND t) tp,
        count(*) FILTER (WHERE s AND NOT t) fp, count(*) FILTER (WHERE t AND NOT s) fn FROM judged GROUP BY check_name)""",
    "baseline_commit": "SELECT commit_sha, strftime(commit_date, '%Y-%m-%d %H:%M:%S') commit_date FROM base",
    "baseline_documents": """SELECT d.doc_id, d.status, v.version_id FROM docs d LEFT JOIN (SELECT doc_id, min(version_id) version_id FROM vers WHERE commit_sha = (SELECT commit_sha FROM base) GROUP BY doc_id) v
        USING (doc_id) WHERE first_seen_commit = (SELECT commit_sha FROM base)""",
    "first_commit_versions": f"""SELECT commit_sha, "action", count(*) n_versions FROM vers SEMI JOIN (SELECT commit_sha FROM commits ORDER BY commit_date, commit_sha LIMIT {FIRST_COMMITS}) USING (commit_sha) GROUP BY ALL""",
    "live_self_match": f""", v AS (SELECT chunk_id, w.e::DOUBLE[] e FROM pg WHERE len(w.e) = 64 AND list_max(list_transform(w.e, lambda x: abs(x))) > 0),
        q AS (SELECT * FROM v ORDER BY sha256('self-match:' || chunk_id) LIMIT {SAMPLED}),
        hits AS (SELECT q.chunk_id q, v.chunk_id m, row_number() OVER (PARTITION BY q.chunk_id ORDER BY round(list_cosine_similarity(q.e, v.e), 6) DESC, v.chunk_id) k FROM q, v)
        SELECT count(DISTINCT q) n_queries, count(*) FILTER (WHERE q = m) n_found FROM hits WHERE k <= {HITS}""",
    "engine_counters": "SELECT engine, count(*) n_held, count(*) FILTER (WHERE expected_present = 0) n_unexpected, (SELECT count(*) FROM requests) n_requests FROM held GROUP BY engine",
    "chunks_inserted": """SELECT chunk_id, doc_id, version_id, token_count FROM chks UNION ALL SELECT chunk_id, w.d, w.v, w.t FROM store WHERE chunk_id NOT IN (SELECT chunk_id FROM chks)""",
    "events_appended": """SELECT engine, chunk_id, row_number() OVER (ORDER BY engine, chunk_id) + (SELECT coalesce(max(event_id), 0) FROM index_events) event_id FROM (SELECT engine, chunk_id
        FROM engines, (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) EXCEPT SELECT engine, chunk_id FROM index_events WHERE lower(trim(op)) = 'upsert')""",
    "pii_migration": f"""SELECT 'documents' table_name, count(*) + {STAFF} n_rows, {STAFF}::BIGINT n_staff FROM docs WHERE doc_id NOT IN (FROM legacy)
        UNION ALL SELECT 'doc_versions', count(*) + {STAFF}, {STAFF} FROM vers WHERE doc_id IS NULL OR doc_id NOT IN (FROM legacy)
        UNION ALL SELECT 'chunks', count(*) + {STAFF}, {STAFF} FROM chks WHERE doc_id IS NULL OR doc_id NOT IN (FROM legacy)
        UNION ALL SELECT 'index_events', count(*) + {3 * STAFF}, {3 * STAFF} FROM index_events WHERE chunk_id IS NULL OR chunk_id NOT IN (SELECT chunk_id FROM chks WHERE doc_id IN (FROM legacy))""",
    "hit_lists_of_stored": f""", v AS (SELECT row_seq, embedding::DOUBLE[] e FROM chunk_vectors WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
        hits AS (SELECT q.row_seq q, r.row_seq m, row_number() OVER (PARTITION BY q.row_seq ORDER BY round(list_cosine_similarity(q.e, r.e), 6) DESC, r.row_seq) k FROM v q, v r WHERE (q.row_seq // 2) % 20 = 0 AND q.row_seq <> r.row_seq)
        SELECT row_seq query_id, count(m)::INT n_hits, arg_min(m, k) first_match FROM (SELECT row_seq FROM chunk_vectors WHERE (row_seq // 2) % 20 = 0) LEFT JOIN (SELECT * FROM hits WHERE k <= {HITS}) ON q = row_seq GROUP BY row_seq""",
}
SQL = {name: _BASE + _MORE + q for name, q in _SELECTS.items()}
