"""Applying a feed of inserts, updates and deletes by composing patches.

One event is a function on the state of its key. Functions of this kind compose:
a composed patch needs only the last event that decides whether the key is held
and the last event of all. Composition is associative, so any grouping of the
ordered events gives the same patch: events are composed within ranges of their
ids first, on any number of tasks even for one hot key, and then the ranges'
patches are composed per key. The base table, if any, is the patch that comes
before all events.

Events move twice: once to the task of their range, where repeats of an id meet
as well, and once, composed, to that of their key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import neutral

BEFORE_ALL = -(2**63)
PATCH = ("decided_id", "decided_held", "last_id", "last_expected")


def counted_deliveries(events: DataFrame, id_col: str = "event_id", version: str = "loaded_at", within: tuple[str, ...] = ()) -> DataFrame:
    """One row per event id, the one delivered last; equal times fall to the greatest remaining fields.

    Rows without an id have no place in the order and are ignored. Extra columns are kept. within: columns that follow from the id.
    """
    rest = [c for c in events.columns if c not in (id_col, version, *within)]
    body = F.struct(version, *rest)
    won = events.where(F.col(id_col).isNotNull()).groupBy(*within, id_col).agg(F.max(body).alias("_won"))
    return won.select(*within, id_col, *[F.col("_won")[c].alias(c) for c in (version, *rest)])


def in_ranges(events: DataFrame, range_size: int) -> DataFrame:
    """Events with the number of their range of ids (_range)."""
    return events.where("event_id is not null").withColumn("_range", F.floor(F.col("event_id") / F.lit(range_size)).cast("bigint"))


def event_patches(events: DataFrame, keys: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """Each event as a patch. An event without an operation, or an unknown one, has none; nor has a null key."""
    op = neutral("op")
    decides = op.isin("upsert", "delete")
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return events.where(known & op.isin("upsert", "delete", "skip")).select(
        *within,
        *keys,
        F.when(decides, F.col("event_id")).alias("decided_id"),
        F.when(decides, (op == "upsert").cast("int")).alias("decided_held"),
        F.col("event_id").alias("last_id"),
        F.coalesce(F.col("expected_present").cast("int"), (op == "upsert").cast("int")).alias("last_expected"),
    )


def compose(patches: DataFrame, keys: list[str]) -> DataFrame:
    """The composition of all patches of each group; all parts are fixed-width, so it runs as a hash aggregate."""
    return patches.groupBy(*keys).agg(
        F.max("decided_id").alias("decided_id"),
        F.max_by("decided_held", "decided_id").alias("decided_held"),
        F.max("last_id").alias("last_id"),
        F.max_by("last_expected", "last_id").alias("last_expected"),
    )


def apply_feed(
    events: DataFrame,
    keys: tuple[str, ...] = ("engine", "chunk_id"),
    base: DataFrame | None = None,
    range_size: int = 4096,
) -> DataFrame:
    """The current state: keys and ``expected_present`` of every key held once all events have taken effect.

    events: event_id, op, expected_present, loaded_at and the keys, in any order and with repeats.
    base: the keys and expected_present held before the feed.
    range_size: how many consecutive ids make one range chunk.
    Repeated deliveries count once; a null or blank op is no event; a null expected_present
    means 1 for an upsert and 0 otherwise; an empty feed returns the base; other columns are not used.
    """
    keys = list(keys)
    wanted = events.select("event_id", "loaded_at", *keys, "op", F.col("expected_present").cast("int").alias("expected_present"))
    placed = in_ranges(wanted, range_size).repartition("_range")
    patches = event_patches(counted_deliveries(placed, within=("_range",)), keys, ("_range",))
    chunks = compose(patches, ["_range", *keys]).drop("_range")
    if base is not None:
        before = F.lit(BEFORE_ALL).cast("bigint")
        known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
        chunks = chunks.unionByName(
            base.where(known).select(
                *keys,
                before.alias("decided_id"),
                F.lit(1).alias("decided_held"),
                before.alias("last_id"),
                F.coalesce(F.col("expected_present").cast("int"), F.lit(1)).alias("last_expected"),
            )
        )
    done = compose(chunks, keys)
    return done.where("decided_held = 1").select(*keys, F.col("last_expected").alias("expected_present"))
