"""Replaying an ordered change log: liveness, versions, re-ingestion, erasure and the events that engines should see.

The walk is no loop: whether a document is live before a change is the last liveness that an earlier change of it set,
and the version that a change supersedes is the last one made before it. Both are carried forward within each
document, in spans, so that one document with a great part of all changes is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import ERASURE_SALT, RENAME_SALT, UPDATE_SALT, chunk_id, deletion_marker, in_bucket, rename_marker
from tidemark.operators.ledger import ENGINES, hash_ranked
from tidemark.operators.ordering import carry_forward, dense_ids

# Order of what happens at one place of the log.
OUT, IN, REINGEST, ERASE = 0, 1, 2, 3
ORDER = ["seq", "phase"]


def parse_name_status(lines: DataFrame, line: str = "line", suffix: str = ".md") -> DataFrame:
    """lines with action, old_path and new_path, from tab-separated status lines as version control prints them.

    A added, M updated, D deleted; a rename is one if both sides have the suffix, an add or a delete if only
    the new or the old one has. Other statuses, and paths without the suffix, give no row.
    """
    part = F.split(line, "\t")
    status, a, b = F.substring(F.get(part, F.lit(0)), 1, 1), F.get(part, F.lit(1)), F.get(part, F.lit(2))
    fits = lambda c: F.coalesce(c.endswith(suffix), F.lit(False))
    action = (
        F.when((status == "A") & fits(a), "add")
        .when((status == "M") & fits(a), "update")
        .when((status == "D") & fits(a), "delete")
        .when((status == "R") & fits(a) & fits(b), "rename")
        .when((status == "R") & fits(b), "add")
        .when((status == "R") & fits(a), "delete")
    )
    renamed = status == "R"
    out = lines.withColumn("action", action).where("action is not null")
    old = F.when(F.col("action").isin("update", "delete", "rename"), a)
    new = F.when(F.col("action").isin("add", "update", "rename"), F.when(renamed, b).otherwise(a))
    return out.withColumn("old_path", old).withColumn("new_path", new)


def first_at_or_after(log: DataFrame, at: Column) -> DataFrame:
    """One row (seq): the first place of the log at or after an instant, else the last; no row for an empty log."""
    found = log.agg(F.min(F.when(F.col("ts") >= at, F.col("seq"))).alias("hit"), F.max("seq").alias("last"))
    return found.where("last is not null").select(F.coalesce("hit", "last").alias("seq"))


def commits_of(versions: DataFrame) -> DataFrame:
    """(commit_sha, commit_date): every commit once, at its earliest date; commits without a date have no place in the log."""
    dated = versions.where("commit_sha is not null and commit_date is not null")
    return dated.groupBy("commit_sha").agg(F.min("commit_date").alias("commit_date"))


def first_commit_since(versions: DataFrame, day: str) -> DataFrame:
    """One row (commit_sha, commit_date): the first commit on or after a day, of several at one time the least. Without one there is no baseline: an error."""
    found = commits_of(versions).where(F.col("commit_date") >= F.lit(day).cast("timestamp_ntz"))
    first = found.agg(F.min(F.struct("commit_date", "commit_sha")).alias("c")).where("c is not null").select("c.commit_sha", "c.commit_date")
    if not first.take(1):
        raise ValueError(f"no commit on or after {day}")
    return first


def first_commits(versions: DataFrame, n: int) -> DataFrame:
    """The first n commits of the log, in the order of their dates."""
    return commits_of(versions).orderBy("commit_date", "commit_sha").limit(n)


def midpoint_seq(log: DataFrame) -> DataFrame:
    """One row (seq): the first place at or after the middle of the log's time."""
    ends = log.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")).select(
        F.expr("timestampadd(MICROSECOND, timestampdiff(MICROSECOND, t0, t1) div 2, t0)").alias("mid")
    )
    return first_at_or_after(log, F.lit(ends.first()["mid"]).cast("timestamp_ntz"))


def fraction_seq(log: DataFrame, fraction: float) -> DataFrame:
    """One row (seq): the place with index min(int(n * fraction), n - 1)."""
    n = log.count()
    numbered = dense_ids(log.select("seq"), ["seq"], "_i", start=0)
    return numbered.where(F.col("_i") == min(int(n * fraction), n - 1)).select("seq")


def expand(changes: DataFrame, contents: DataFrame) -> DataFrame:
    """Each change as what it does to single documents; a rename does one thing to either side.

    changes: seq, commit_sha, action, old_doc, new_doc, content_key. contents: content_key, is_stub.
    Rows: seq, phase, doc, commit_sha, kind, content_key, is_stub, other_doc, live_after (null: unchanged).
    """
    stubs = contents.select("content_key", "is_stub")
    c = changes.join(stubs, "content_key", "left")
    side = lambda phase, kind, doc, other: F.struct(F.lit(phase).alias("phase"), kind.alias("kind"), doc.alias("doc"), other.alias("other_doc"))
    renamed = F.col("action") == "rename"
    one = side(OUT, F.col("action"), F.coalesce("new_doc", "old_doc"), F.lit(None).cast("string"))
    two = F.array(side(OUT, F.lit("rename_out"), F.col("old_doc"), F.col("new_doc")), side(IN, F.lit("rename_in"), F.col("new_doc"), F.col("old_doc")))
    each = c.select("seq", "commit_sha", "content_key", "is_stub", F.explode(F.when(renamed, two).otherwise(F.array(one))).alias("e")).select(
        "seq", "commit_sha", "content_key", F.coalesce("is_stub", F.lit(False)).alias("is_stub"), "e.*"
    )
    makes = F.col("kind").isin("add", "update", "rename_in")
    live = F.when(makes & ~F.col("is_stub"), True).when(F.col("kind").isin("add", "rename_in"), None).otherwise(False)
    return each.where("doc is not null").withColumn("live_after", live)


def outcome() -> Column:
    """What a change came to, given live_before; null for nothing."""
    live, stub, kind = F.coalesce("live_before", F.lit(False)), F.col("is_stub"), F.col("kind")
    buggy = lambda salt, name: F.when(in_bucket(F.col("doc"), salt), f"{name}_buggy").otherwise(f"{name}_correct")
    return (
        F.when((kind == "t0"), "t0")
        .when((kind == "add") & ~stub, "add")
        .when((kind == "update") & stub & live, "delete")
        .when((kind == "update") & ~stub & live, buggy(UPDATE_SALT, "update"))
        .when((kind == "update") & ~stub, "add_from_stub")
        .when((kind == "delete") & live, "delete")
        .when((kind == "rename_out") & live, buggy(RENAME_SALT, "rename"))
        .when(kind == "rename_out", "rename_degraded_to_add")
        .when((kind == "rename_in") & ~stub, "rename_in")
        .when(kind == "reingest", "reingest")
        .when((kind == "erase") & live, "erase")
    )


def walk(t0: DataFrame, changes: DataFrame, contents: DataFrame, reingest: DataFrame | None = None, erase: DataFrame | None = None) -> DataFrame:
    """Every step of every document with live_before, outcome, and the version made (made) or superseded (old).

    t0: doc, content_key: the documents live before the log. reingest: one row (seq): after that place every live
    document is ingested again. erase: (seq, doc) to be erased after everything else at that place.
    A version is named by the step that made it, as seq * 4 + phase; T0 versions are -1. Seqs count from 0.
    """
    initial = t0.select(
        F.lit(-1).cast("bigint").alias("seq"), F.lit("t0").alias("commit_sha"), "content_key", F.lit(False).alias("is_stub"),
        F.lit(OUT).alias("phase"), F.lit("t0").alias("kind"), "doc", F.lit(None).cast("string").alias("other_doc"), F.lit(True).alias("live_after"),
    )
    steps = initial.unionByName(expand(changes, contents).withColumn("seq", F.col("seq").cast("bigint")))
    at = reingest.select("seq").first() if reingest is not None else None
    if at is not None:
        then = F.when(F.col("live_after").isNotNull(), F.struct(*ORDER))
        content = F.when(F.col("live_after"), F.struct(*ORDER))
        live = (
            steps.where(F.col("seq") <= at["seq"])
            .groupBy("doc")
            .agg(F.max_by("live_after", then).alias("live"), F.max_by("content_key", content).alias("content_key"))
            .where("live")
        )
        sha = changes.where(F.col("seq") == at["seq"]).agg(F.max("commit_sha")).first()[0]
        again = live.select(
            F.lit(at["seq"]).cast("bigint").alias("seq"), F.lit(f"{sha}::reingest").alias("commit_sha"), "content_key", F.lit(False).alias("is_stub"),
            F.lit(REINGEST).alias("phase"), F.lit("reingest").alias("kind"), "doc", F.lit(None).cast("string").alias("other_doc"), F.lit(True).alias("live_after"),
        )
        steps = steps.unionByName(again)
    if erase is not None:
        gone = erase.select(
            F.col("seq").cast("bigint").alias("seq"), F.lit("erasure").alias("commit_sha"), F.lit(None).cast(contents.schema["content_key"].dataType).alias("content_key"), F.lit(False).alias("is_stub"),
            F.lit(ERASE).alias("phase"), F.lit("erase").alias("kind"), "doc", F.lit(None).cast("string").alias("other_doc"), F.lit(False).alias("live_after"),
        )
        steps = steps.unionByName(gone)
    made = F.when(F.col("live_after"), F.when(F.col("seq") < 0, F.lit(-1)).otherwise(F.col("seq") * 4 + F.col("phase")))
    named = steps.withColumn("made", made.cast("bigint")).withColumn("made_content", F.when(F.col("made").isNotNull(), F.struct("made", "content_key")))
    seen = carry_forward(named, "doc", "seq", ORDER, {"live_before": "live_after", "_old": "made_content"})
    return seen.withColumn("outcome", outcome()).select(
        "seq", "phase", "doc", "commit_sha", "kind", "content_key", "other_doc", F.coalesce("live_before", F.lit(False)).alias("live_before"), "live_after", "outcome", "made",
        F.when(F.coalesce("live_before", F.lit(False)), F.col("_old")["made"]).alias("old"), F.when(F.coalesce("live_before", F.lit(False)), F.col("_old")["content_key"]).alias("old_content"),
    )


def counters(steps: DataFrame) -> DataFrame:
    """(outcome, n): how often each thing happened. The new side of a rename isn't counted apart."""
    return steps.where("outcome is not null and outcome not in ('t0', 'rename_in')").groupBy("outcome").agg(F.count("*").alias("n"))


def final_status(steps: DataFrame) -> DataFrame:
    """(doc, status, renamed_to) after the whole log."""
    at = F.struct(*ORDER)
    status = (
        F.when(F.col("outcome").isin("delete", "erase"), "deleted")
        .when(F.col("outcome").isin("rename_buggy", "rename_correct"), "renamed")
        .when(F.col("outcome").isNotNull() & (F.col("outcome") != "rename_degraded_to_add"), "live")
    )
    # an erased document counts as deleted even if it was not live
    status = F.when(F.col("kind") == "erase", "deleted").otherwise(status)
    state = F.struct(status.alias("status"), F.when(status == "renamed", F.col("other_doc")).alias("renamed_to"))
    done = steps.groupBy("doc").agg(F.max_by(state, F.when(status.isNotNull(), at)).alias("s")).where("s is not null")
    return done.select("doc", "s.status", "s.renamed_to")


def minted_versions(steps: DataFrame, contents: DataFrame) -> DataFrame:
    """Versions in the order of the log, those at T0 first by document: version_id, doc, commit_sha, content_sha256, action, made, content_key.

    Deletions and renames get marker versions of their own, without content.
    """
    o = F.col("outcome")
    marker = o.isin("delete", "rename_buggy", "rename_correct")
    rows = steps.where(F.col("made").isNotNull() | marker).join(contents.select("content_key", "content_sha256"), "content_key", "left")
    action = (
        F.when(o == "delete", "delete")
        .when(o.isin("rename_buggy", "rename_correct"), "rename")
        .when(o.isin("update_buggy", "update_correct"), "update")
        .when((o == "rename_in"), "rename")
        .otherwise("add")
    )
    sha = (
        F.when(o == "delete", deletion_marker(F.col("doc"), F.col("commit_sha")))
        .when(o.isin("rename_buggy", "rename_correct"), rename_marker(F.col("doc"), F.col("other_doc"), F.col("commit_sha")))
        .otherwise(F.col("content_sha256"))
    )
    kept = rows.select(
        "seq", "phase", "doc", "commit_sha", sha.alias("content_sha256"), action.alias("action"), F.when(~marker, F.col("made")).alias("made"), F.when(~marker, F.col("content_key")).alias("content_key")
    )
    return dense_ids(kept, ["seq", "phase", "doc"], "version_id").drop("seq", "phase")


def minted_chunks(versions: DataFrame, parts: DataFrame) -> DataFrame:
    """Chunk rows of all versions with content: chunk_id, doc, version_id, ordinal, text_sha256, made. parts: content_key, ordinal, text_sha256."""
    own = versions.where("content_key is not null").select("doc", "version_id", "made", "content_key").join(parts, "content_key")
    return own.select(chunk_id(F.col("doc"), F.col("version_id"), F.col("ordinal")).alias("chunk_id"), "doc", "version_id", "ordinal", "text_sha256", "made")


def reingest_sources(steps: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, source_chunk_id): each chunk made by a re-ingestion and the one of the version before with its place, whose text and vector it repeats."""
    again = steps.where("outcome = 'reingest' and old is not null").select("doc", "made", "old")
    new = again.join(chunks.select("doc", "made", "ordinal", "chunk_id"), ["doc", "made"])
    before = chunks.select("doc", F.col("made").alias("old"), "ordinal", F.col("chunk_id").alias("source_chunk_id"))
    return new.join(before, ["doc", "old", "ordinal"]).select("chunk_id", "source_chunk_id")


def vectors_of_upserts(ops: DataFrame, sources: DataFrame) -> DataFrame:
    """(chunk_id, vector_id): the chunk whose vector each upsert stores, the source's for a chunk ingested again, so that nothing is embedded twice."""
    return ops.where("op = 'upsert'").select("chunk_id").join(sources, "chunk_id", "left").select("chunk_id", F.coalesce("source_chunk_id", "chunk_id").alias("vector_id"))


def engine_ops(steps: DataFrame, chunks: DataFrame) -> DataFrame:
    """(seq, phase, op, chunk_id, expected_present): every new chunk is upserted; a superseded one is deleted, or skipped in the buggy bucket.

    A document added or ingested again while live leaves its old chunks without any event.
    """
    o = F.col("outcome")
    new = steps.where("made is not null").select("seq", "phase", "doc", "made")
    upserts = new.join(chunks, ["doc", "made"]).select("seq", "phase", F.lit("upsert").alias("op"), "chunk_id", F.lit(1).alias("expected_present"))
    fate = F.when(o.isin("update_buggy", "rename_buggy"), "skip").when(o.isin("update_correct", "rename_correct", "delete", "erase"), "delete")
    old = steps.withColumn("op", fate).where("op is not null and old is not null").select("seq", "phase", "doc", F.col("old").alias("made"), "op")
    others = old.join(chunks, ["doc", "made"]).select("seq", "phase", "op", "chunk_id", F.lit(0).alias("expected_present"))
    return upserts.unionByName(others)


def event_log(ops: DataFrame) -> DataFrame:
    """The ops of all engines with event ids: engine by engine, upserts before deletes before skips, each in the order of the log.

    All engines get the same ops, so these are sorted and numbered once, and an engine's ids begin where those of the one before end.
    """
    kind = F.when(F.col("op") == "upsert", 0).when(F.col("op") == "delete", 1).otherwise(2)
    numbered = dense_ids(ops.withColumn("kind", kind), ["kind", "seq", "phase", "chunk_id"], "_id")
    each = numbered.agg(F.max("_id")).first()[0] or 0
    engines = F.array(*[F.struct(F.lit(i * each).cast("bigint").alias("before"), F.lit(e).alias("engine")) for i, e in enumerate(ENGINES)])
    sent = numbered.select("_id", "chunk_id", "op", "expected_present", F.explode(engines).alias("e"))
    return sent.select((F.col("_id") + F.col("e.before")).alias("event_id"), "e.engine", "chunk_id", "op", "expected_present")


def erasure_choice(docs: DataFrame, at: DataFrame, n: int, salt: str = ERASURE_SALT) -> DataFrame:
    """(seq, doc): the n documents first by salted hash, to be erased at the given place."""
    place = at.select("seq").first()
    chosen = hash_ranked(docs.select("doc"), "doc", salt, n)
    return chosen.withColumn("seq", F.lit(place["seq"] if place else None).cast("bigint")).where("seq is not null")
