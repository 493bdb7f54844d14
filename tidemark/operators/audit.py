"""Audit findings on what an index holds: stale, orphaned and duplicated chunks, drift, and how these overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_stale() -> Column:
    """The document lives on in a later version."""
    return (F.col("doc_status") == "live") & (F.col("version_id") != F.col("last_chunked_version_id"))


def orphan_cause() -> Column:
    """Why a held chunk shouldn't be there; null if it should."""
    return (
        F.when(F.col("doc_status") == "deleted", "deleted")
        .when(F.col("doc_status") == "renamed", "renamed")
        .when(is_stale(), "superseded_live_doc")
    )


def duplicate_places(held: DataFrame) -> DataFrame:
    """held (engine, chunk_id, text_sha256) with is_excess: every chunk of an engine's equal texts but the first by id.

    One aggregate finds the first of every text, and a join marks it, so a text that a third of all chunks share is split like any hot key.
    """
    firsts = held.groupBy("engine", "text_sha256").agg(F.min("chunk_id").alias("first_id"), F.count("*").alias("copies"))
    return held.join(firsts, ["engine", "text_sha256"]).withColumn("is_excess", F.col("chunk_id") != F.col("first_id"))


def audited(held: DataFrame, lineage: DataFrame) -> DataFrame:
    """Held chunks that the ledger knows, each with the flags of all checks."""
    known = duplicate_places(held.join(lineage, "chunk_id"))
    return known.select(
        "engine",
        "chunk_id",
        "expected_present",
        F.coalesce(is_stale(), F.lit(False)).alias("is_stale"),
        orphan_cause().alias("cause"),
        "is_excess",
        "copies",
    )


def venn(flags: DataFrame, names: list[str], by: str) -> DataFrame:
    """Counts of every combination of flags, as a bit mask in the order of the names; 0 passes all checks."""
    mask = sum((F.col(n).cast("int") * (1 << i) for i, n in enumerate(names)), F.lit(0))
    return flags.groupBy(by, mask.alias("region")).agg(F.count("*").alias("n_chunks"))


def share_of(part: Column, whole: Column) -> Column:
    return F.round(100 * part / F.nullif(whole, F.lit(0)), 2)


def precision_recall(flags: DataFrame, flagged: Column, true: Column, by: str) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    each = flags.groupBy(by).agg(n(flagged & true).alias("tp"), n(flagged & ~true).alias("fp"), n(~flagged & true).alias("fn"))
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 6)
    return each.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


def canonical(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tombstones(events: DataFrame) -> DataFrame:
    """Per engine: chunks ever upserted, held, deleted and the dead share. events: engine, chunk_id, last_op, ever_upserted."""
    held = F.sum(F.when(F.col("last_op") == "upsert", 1).otherwise(0))
    dead = F.sum(F.when((F.col("last_op") == "delete") & F.col("ever_upserted"), 1).otherwise(0))
    each = events.groupBy("engine").agg(F.count("*").alias("n_chunks"), held.alias("n_live"), dead.alias("n_dead"))
    return each.withColumn("dead_ratio", F.round(F.col("n_dead") / F.nullif(F.col("n_live") + F.col("n_dead"), F.lit(0)), 6))


def violations(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """(table_name, rule, n_rows): how many rows break each rule, in one pass; a rule is broken where its condition is false."""
    counts = df.agg(*[F.count(F.when(~F.coalesce(c, F.lit(True)), 1)).alias(f"r{i}") for i, c in enumerate(rules.values())])
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n_rows")) for i, name in enumerate(rules)]
    return counts.select(F.explode(F.array(*pairs)).alias("p")).select(F.lit(table).alias("table_name"), "p.rule", "p.n_rows")


def retrievable(targets: DataFrame, hits: DataFrame, stored: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(k, mode, n_targets, n_found): how many targets a search finds within the first k hits.

    targets: id, doc_id, text_sha256. hits: query_id, rank, match_id. stored: id, doc_id, text_sha256. Modes: 'exact_id' the target itself,
    'doc_scoped' any row of its document, 'content_scoped' any row of the same text.
    """
    t = targets.select(F.col("id").alias("query_id"), F.col("doc_id").alias("t_doc"), F.col("text_sha256").alias("t_text"))
    met = hits.join(stored.select(F.col("id").alias("match_id"), "doc_id", "text_sha256"), "match_id")
    each = t.join(met, "query_id", "left")
    first = lambda c: F.min(F.when(c, F.col("rank")))
    ranks = each.groupBy("query_id").agg(
        first(F.col("match_id") == F.col("query_id")).alias("exact_id"), first(F.col("doc_id") == F.col("t_doc")).alias("doc_scoped"), first(F.col("text_sha256") == F.col("t_text")).alias("content_scoped")
    )
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("at")) for m in ("exact_id", "doc_scoped", "content_scoped")])
    long = ranks.select(F.explode(modes).alias("m")).select("m.*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return long.groupBy("k", "mode").agg(F.count("*").alias("n_targets"), F.sum((F.coalesce("at", F.lit(1 << 30)) <= F.col("k")).cast("int")).alias("n_found"))
