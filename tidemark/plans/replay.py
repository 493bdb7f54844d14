"""Replay queries: the events table read as a change log on the pages of the corpus.

A user is a document, all live at the start. Errors delete it, purchases rename it to the user seven further on, sign-ups add it,
all else updates it; props.k and the user choose the page that is the new content. The log is written as status lines and classified from them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import replay
from tidemark.operators.ordering import dense_ids
from tidemark.operators.chunker import chunk
from tidemark.plans.corpus import _BODY, _UNITS, bodies
from tidemark.session import cut_lineage, table, texts

ERASED = 20
ERASED_AFTER = 0.9


def user_doc(user: Column) -> Column:
    """A user's document: the number with at least six digits."""
    digits = user.cast("string")
    return F.concat(F.lit("u"), F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0")))


@dataclass
class Log:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def numbers(self) -> DataFrame:
        """(doc_id, content_key): ids are sorted, not texts."""
        return dense_ids(table(self.spark, self.sf_dir, "documents").select("doc_id"), ["doc_id"], "content_key", start=0)

    @cached_property
    def stubs(self) -> DataFrame:
        """(content_key, is_stub), all that the walk asks of the pages."""
        flags = bodies(self.spark, self.sf_dir).select("doc_id", text.is_stub(F.col("body")).alias("is_stub"))
        return cut_lineage(self.numbers.join(flags, "doc_id").select("content_key", "is_stub"))  # read for the walk and for what is live at its middle

    @cached_property
    def contents(self) -> DataFrame:
        """(content_key, content_sha256)."""
        return self.numbers.join(bodies(self.spark, self.sf_dir).select("doc_id", F.sha2("body", 256).alias("content_sha256")), "doc_id").drop("doc_id")

    @cached_property
    def parts(self) -> DataFrame:
        """(content_key, ordinal, text_sha256): the pages' chunks."""
        return self.numbers.join(chunk(bodies(self.spark, self.sf_dir), "doc_id", "body").select("doc_id", "ordinal", "text_sha256"), "doc_id").drop("doc_id")

    @cached_property
    def changes(self) -> DataFrame:
        events = texts(self.spark, self.sf_dir, "events")
        pages = table(self.spark, self.sf_dir, "documents").count()
        users = (events.agg(F.max("user_id")).first()[0] or 0) + 1
        path = lambda c: F.concat(F.lit("content/handbook/"), user_doc(c), F.lit(".md"))
        kind, own = F.col("event_type"), path(F.col("user_id"))
        status = F.when(kind == "error", "D").when(kind == "purchase", "R100").when(kind == "signup", "A").otherwise("M")
        line = F.concat_ws("\t", status, own, F.when(kind == "purchase", path((F.col("user_id") + 7) % users)))
        k = F.get_json_object("props", "$.k").cast("bigint")
        lines = events.select("event_id", "ts", line.alias("line"), ((F.col("user_id") + k) % max(1, pages)).alias("content_key"))
        classified = replay.parse_name_status(lines).select(
            F.col("event_id").alias("seq"),
            F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("commit_sha"),
            "ts",
            "action",
            text.doc_id_of(F.col("old_path")).alias("old_doc"),
            text.doc_id_of(F.col("new_path")).alias("new_doc"),
            "content_key",
        )
        return cut_lineage(classified)

    @cached_property
    def t0(self) -> DataFrame:
        pages = table(self.spark, self.sf_dir, "documents").count()
        users = table(self.spark, self.sf_dir, "events").select("user_id").distinct()
        return users.select(user_doc(F.col("user_id")).alias("doc"), (F.col("user_id") % max(1, pages)).alias("content_key"))

    @cached_property
    def midpoint(self) -> DataFrame:
        return replay.midpoint_seq(self.changes.select("seq", "ts"))

    @cached_property
    def erasure(self) -> DataFrame:
        return replay.fraction_seq(self.changes.select("seq"), ERASED_AFTER)

    @cached_property
    def erased(self) -> DataFrame:
        return replay.erasure_choice(self.t0, self.erasure, ERASED)

    @cached_property
    def steps(self) -> DataFrame:
        return cut_lineage(replay.walk(self.t0, self.changes, self.stubs, self.midpoint, self.erased))

    @cached_property
    def versions(self) -> DataFrame:
        return replay.minted_versions(self.steps, self.contents)

    @cached_property
    def chunks(self) -> DataFrame:
        return cut_lineage(replay.minted_chunks(self.versions, self.parts))


def change_classify(spark, sf_dir):
    return Log(spark, sf_dir).changes.select("seq", "action", "old_doc", "new_doc", "content_key")


def midpoint_commit(spark, sf_dir):
    return Log(spark, sf_dir).midpoint


def erasure_commit(spark, sf_dir):
    return Log(spark, sf_dir).erasure


def walk_liveness(spark, sf_dir):
    return Log(spark, sf_dir).steps.where("outcome is not null").select("seq", "phase", "doc", "kind", "live_before", "outcome", "old")


def walk_counters(spark, sf_dir):
    return replay.counters(Log(spark, sf_dir).steps)


def replay_status(spark, sf_dir):
    return replay.final_status(Log(spark, sf_dir).steps)


def replay_versions(spark, sf_dir):
    return Log(spark, sf_dir).versions.select("version_id", "doc", "commit_sha", "content_sha256", "action")


def reingest_duplicates(spark, sf_dir):
    """Chunks made again by the re-ingestion, by document."""
    log = Log(spark, sf_dir)
    again = log.steps.where("outcome = 'reingest'").select("doc", "made")
    return again.join(log.chunks, ["doc", "made"]).groupBy("doc").agg(F.count("*").alias("n_chunks"))


def reingest_mapping(spark, sf_dir):
    """Each chunk made again with the chunk, of the version before, that it repeats."""
    log = Log(spark, sf_dir)
    return replay.reingest_sources(log.steps, log.chunks)


def upsert_vectors_used(spark, sf_dir):
    """Each upserted chunk with the chunk whose vector it takes: its own, or, where it was ingested again, the repeated one's."""
    log = Log(spark, sf_dir)
    ops = replay.engine_ops(log.steps, log.chunks)
    return replay.vectors_of_upserts(ops, replay.reingest_sources(log.steps, log.chunks))


def index_events_log(spark, sf_dir):
    log = Log(spark, sf_dir)
    return replay.event_log(replay.engine_ops(log.steps, log.chunks))


def replay_conservation(spark, sf_dir):
    """Per engine: chunks ever made, upserts, deletes, skips, and what is left live."""
    log = Log(spark, sf_dir)
    ops = replay.engine_ops(log.steps, log.chunks)
    n = lambda op: F.sum((F.col("op") == op).cast("int"))
    each = ops.agg(n("upsert").alias("n_upsert"), n("delete").alias("n_delete"), n("skip").alias("n_skip"))
    return each.withColumn("n_live", F.col("n_upsert") - F.col("n_delete"))


NAMES = (change_classify, midpoint_commit, erasure_commit, walk_liveness, walk_counters, replay_status, replay_versions, reingest_duplicates, reingest_mapping, upsert_vectors_used, index_events_log, replay_conservation)
QUERIES = {q.__name__: q for q in NAMES}

_B = "('0x' || substr({h}, {a}, {n}))::BIGINT % 100"


def _bucket(salt: str) -> str:
    h = f"sha256('{salt}:' || doc)"
    parts = [_B.format(h=h, a=a, n=n) for a, n in ((1, 4), (5, 15), (20, 15), (35, 15))]
    return f"(({_B.format(h=h, a=50, n=15)} + 76 * ({' + '.join(parts)})) % 100)"


_LOG = _BODY + _UNITS + rf""",
 nd AS (SELECT count(*) d FROM documents), nu AS (SELECT max(user_id) + 1 u FROM events),
 contents AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 content_key, n_words < 30 is_stub, sha256(body) content_sha256, coalesce(n_chunks, 0) n_chunks
     FROM cleaned LEFT JOIN (SELECT doc_id, count(*) n_chunks FROM win GROUP BY doc_id) USING (doc_id)),
 changes AS (SELECT event_id seq, 'c' || event_id commit_sha, ts,
     CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' WHEN 'signup' THEN 'add' ELSE 'update' END AS action,
     CASE WHEN event_type <> 'signup' THEN printf('u%06d', user_id) END old_doc,
     CASE WHEN event_type = 'purchase' THEN printf('u%06d', (user_id + 7) % u) WHEN event_type <> 'error' THEN printf('u%06d', user_id) END new_doc,
     (user_id + (props->>'$.k')::BIGINT) % d content_key FROM events, nd, nu),
 mid AS (SELECT min(seq) seq FROM changes WHERE ts >= (SELECT min(ts) + to_microseconds((epoch_us(max(ts)) - epoch_us(min(ts))) // 2) FROM changes)),
 late AS (SELECT seq FROM (SELECT seq, row_number() OVER (ORDER BY seq) - 1 i, count(*) OVER () n FROM changes) WHERE i = least(floor(n * {ERASED_AFTER})::BIGINT, n - 1)),
 t0 AS (SELECT printf('u%06d', user_id) doc, user_id % d content_key FROM (SELECT DISTINCT user_id FROM events), nd),
 made_steps AS (
     SELECT -1 seq, 0 phase, 't0' kind, 't0' commit_sha, doc, content_key, false is_stub, NULL other_doc, true live_after FROM t0
     UNION ALL SELECT seq, 0, action, commit_sha, coalesce(new_doc, old_doc), content_key, is_stub, NULL,
         CASE WHEN action IN ('add', 'update') AND NOT is_stub THEN true WHEN action = 'add' THEN NULL ELSE false END
         FROM changes JOIN contents USING (content_key) WHERE action <> 'rename'
     UNION ALL SELECT seq, 0, 'rename_out', commit_sha, old_doc, content_key, is_stub, new_doc, false FROM changes JOIN contents USING (content_key) WHERE action = 'rename'
     UNION ALL SELECT seq, 1, 'rename_in', commit_sha, new_doc, content_key, is_stub, old_doc, CASE WHEN NOT is_stub THEN true END
         FROM changes JOIN contents USING (content_key) WHERE action = 'rename'),
 again AS (SELECT doc, arg_max(live_after, (seq, phase)) FILTER (WHERE live_after IS NOT NULL) live, arg_max(content_key, (seq, phase)) FILTER (WHERE live_after) content_key
     FROM made_steps WHERE seq <= (SELECT seq FROM mid) GROUP BY doc),
 all_steps AS (SELECT * FROM made_steps
     UNION ALL SELECT (SELECT seq FROM mid), 2, 'reingest', (SELECT 'c' || seq FROM mid) || '::reingest', doc, content_key, false, NULL, true FROM again WHERE live
     UNION ALL SELECT (SELECT seq FROM late), 3, 'erase', 'erasure', doc, NULL, false, NULL, false
         FROM (SELECT doc FROM t0 ORDER BY sha256('pii-erasure-2.3:' || doc) LIMIT {ERASED})),
 seen AS (SELECT *, CASE WHEN live_after THEN CASE WHEN seq < 0 THEN -1 ELSE seq * 4 + phase END END made,
     coalesce(last_value(live_after IGNORE NULLS) OVER w, false) live_before,
     last_value(CASE WHEN live_after THEN CASE WHEN seq < 0 THEN -1 ELSE seq * 4 + phase END END IGNORE NULLS) OVER w prior
     FROM all_steps WINDOW w AS (PARTITION BY doc ORDER BY seq, phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 steps AS (SELECT *, CASE WHEN live_before THEN prior END old, CASE
     WHEN kind IN ('t0', 'reingest') THEN kind
     WHEN kind = 'add' AND NOT is_stub THEN 'add'
     WHEN kind = 'update' AND is_stub AND live_before THEN 'delete'
     WHEN kind = 'update' AND NOT is_stub AND live_before THEN CASE WHEN {_bucket('mode-a-update')} < 50 THEN 'update_buggy' ELSE 'update_correct' END
     WHEN kind = 'update' AND NOT is_stub THEN 'add_from_stub'
     WHEN kind = 'delete' AND live_before THEN 'delete'
     WHEN kind = 'rename_out' AND live_before THEN CASE WHEN {_bucket('mode-d-rename')} < 50 THEN 'rename_buggy' ELSE 'rename_correct' END
     WHEN kind = 'rename_out' THEN 'rename_degraded_to_add'
     WHEN kind = 'rename_in' AND NOT is_stub THEN 'rename_in'
     WHEN kind = 'erase' AND live_before THEN 'erase' END outcome FROM seen),
 numbered AS (SELECT s.seq, s.phase, s.doc, s.commit_sha, row_number() OVER (ORDER BY s.seq, s.phase, s.doc) version_id, made, s.content_key,
     CASE WHEN outcome = 'delete' THEN sha256('DELETED:' || doc || ':' || commit_sha)
          WHEN outcome IN ('rename_buggy', 'rename_correct') THEN sha256('RENAMED:' || doc || '->' || other_doc || ':' || commit_sha) ELSE content_sha256 END content_sha256,
     CASE WHEN outcome = 'delete' THEN 'delete' WHEN outcome IN ('rename_buggy', 'rename_correct', 'rename_in') THEN 'rename'
          WHEN outcome IN ('update_buggy', 'update_correct') THEN 'update' ELSE 'add' END AS action
     FROM steps s LEFT JOIN contents USING (content_key) WHERE made IS NOT NULL OR outcome IN ('delete', 'rename_buggy', 'rename_correct')),
 parts AS (SELECT doc, version_id, made, unnest(range(0, n_chunks)) ordinal FROM numbered JOIN contents USING (content_key) WHERE made IS NOT NULL),
 chks AS (SELECT doc, made, ordinal, printf('%s::v%d::%04d', doc, version_id, ordinal) chunk_id FROM parts),
 ops AS (SELECT seq, phase, 'upsert' op, chunk_id, 1 expected_present FROM steps JOIN chks USING (doc, made)
     UNION ALL SELECT seq, phase, CASE WHEN outcome IN ('update_buggy', 'rename_buggy') THEN 'skip' ELSE 'delete' END, chunk_id, 0
     FROM steps s JOIN chks c ON c.doc = s.doc AND c.made = s.old
     WHERE outcome IN ('update_buggy', 'rename_buggy', 'update_correct', 'rename_correct', 'delete', 'erase'))
"""

_SELECTS = {
    "change_classify": "SELECT seq, action, old_doc, new_doc, content_key FROM changes",
    "midpoint_commit": "SELECT seq FROM mid",
    "erasure_commit": "SELECT seq FROM late",
    "walk_liveness": "SELECT seq, phase, doc, kind, live_before, outcome, old FROM steps WHERE outcome IS NOT NULL",
    "walk_counters": "SELECT outcome, count(*) n FROM steps WHERE outcome IS NOT NULL AND outcome NOT IN ('t0', 'rename_in') GROUP BY outcome",
    "replay_status": """SELECT doc, arg_max(st, (seq, phase)) status, arg_max(struct_pack(r := CASE WHEN st = 'renamed' THEN other_doc END), (seq, phase)).r renamed_to
        FROM (SELECT *, CASE WHEN kind = 'erase' OR outcome = 'delete' THEN 'deleted' WHEN outcome IN ('rename_buggy', 'rename_correct') THEN 'renamed'
        WHEN outcome <> 'rename_degraded_to_add' THEN 'live' END st FROM steps) WHERE st IS NOT NULL GROUP BY doc""",
    "replay_versions": "SELECT version_id, doc, commit_sha, content_sha256, action FROM numbered",
    "reingest_duplicates": "SELECT doc, count(*) n_chunks FROM steps JOIN chks USING (doc, made) WHERE outcome = 'reingest' GROUP BY doc",
    "reingest_mapping": """SELECT n.chunk_id, o.chunk_id source_chunk_id FROM steps s JOIN chks n ON n.doc = s.doc AND n.made = s.made JOIN chks o ON o.doc = s.doc AND o.made = s.old AND o.ordinal = n.ordinal
        WHERE outcome = 'reingest'""",
    "upsert_vectors_used": """SELECT ops.chunk_id, coalesce(o.chunk_id, ops.chunk_id) vector_id FROM ops LEFT JOIN (steps s JOIN chks n ON n.doc = s.doc AND n.made = s.made AND outcome = 'reingest'
        JOIN chks o ON o.doc = s.doc AND o.made = s.old AND o.ordinal = n.ordinal) ON n.chunk_id = ops.chunk_id WHERE op = 'upsert'""",
    "index_events_log": """SELECT row_number() OVER (ORDER BY r, k, seq, phase, chunk_id) event_id, engine, chunk_id, op, expected_present
        FROM (SELECT *, CASE op WHEN 'upsert' THEN 0 WHEN 'delete' THEN 1 ELSE 2 END k FROM ops), (VALUES (0, 'pgvector'), (1, 'qdrant'), (2, 'chroma')) e(r, engine)""",
    "replay_conservation": """SELECT count(*) FILTER (WHERE op = 'upsert') n_upsert, count(*) FILTER (WHERE op = 'delete') n_delete, count(*) FILTER (WHERE op = 'skip') n_skip,
        count(*) FILTER (WHERE op = 'upsert') - count(*) FILTER (WHERE op = 'delete') n_live FROM ops""",
}
SQL = {name: _LOG + q for name, q in _SELECTS.items()}
