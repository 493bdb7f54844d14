"""Full history of changing attributes, from updates or periodic snapshots, by presence bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Snapshots per bitmap word: two bits of a bigint stay free, so that no addition below can overflow.
BITS = 62
ALL = (1 << BITS) - 1
#: Calendar spans, each a part of the one before, and rows of an entity's span beyond which it is parted further.
SPANS = ("year", "month", "day", "hour", "minute", "second")
SPAN_ROWS = 1_000_000
#: Most common snapshots whose numbers are broadcast; more are joined by shuffle.
MOST_SNAPSHOTS = 1_000_000


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))


def _carried(v: Column, present: Column) -> Column:
    """v with each bit carried on through the absent snapshots above it.

    Adding the lowest bit of a run of absent snapshots to the run ripples through exactly
    that run, so one addition carries every value of the word at once.
    """
    absent = present.bitwiseXOR(F.lit(ALL).cast("bigint"))
    first = F.shiftleft(v, 1).bitwiseAND(absent)
    return v.bitwiseOR((absent + first).bitwiseXOR(absent).bitwiseAND(absent))


def in_spans(events: DataFrame, span: str, most: int) -> DataFrame:
    """events with the start of their calendar span; an entity's spans with more rows than ``most`` are parted by the next finer unit, as often as need be."""
    spanned = events.withColumn("span", F.date_trunc(span, "at"))
    for finer in SPANS[SPANS.index(span) + 1 :]:
        full = spanned.groupBy("entity", "span").count().where(F.col("count") > most).select("entity", "span", F.lit(True).alias("_full"))
        if not full.take(1):
            break
        full = F.broadcast(cut_lineage(full))  # one row for each ``most`` rows, at most
        spanned = spanned.join(full, ["entity", "span"], "left").withColumn("span", F.when(F.col("_full"), F.date_trunc(finer, "at")).otherwise(F.col("span"))).drop("_full")
    return spanned


def presence_bitmaps(spanned: DataFrame, common_snapshots: bool) -> DataFrame:
    """(entity, span, word, value, bits, times): the snapshots of a word at which the entity had the value.

    Snapshots are numbered within calendar spans, so that numbering and all later steps of one hot entity
    are spread over its spans. With common_snapshots all entities share one numbering, and an
    entity absent from a snapshot has no bit there; otherwise each entity's own events are its snapshots.
    """
    if common_snapshots:
        known = spanned.select("span", "at").distinct()
        slots = known.withColumn("slot", F.row_number().over(Window.partitionBy("span").orderBy("at")) - 1)
        # few snapshots hold all rows, so a shuffle by snapshot would be all hot keys
        spanned = spanned.join(F.broadcast(slots) if known.count() <= MOST_SNAPSHOTS else slots, ["span", "at"])
    else:
        spanned = spanned.withColumn("slot", F.row_number().over(Window.partitionBy("entity", "span").orderBy("at")) - 1)
    bit = F.col("slot") % BITS
    return spanned.groupBy("entity", "span", F.floor(F.col("slot") / BITS).alias("word"), "value").agg(
        F.bit_or(_bit(bit)).alias("bits"),
        F.map_from_entries(F.collect_list(F.struct(bit.cast("int"), "at"))).alias("times"),  # at most BITS entries
    )


def attribute_history(events: DataFrame, common_snapshots: bool = False, span: str = "month", span_rows: int = SPAN_ROWS) -> DataFrame:
    """Rows (entity, value, valid_from, valid_to): every longest period with one value; valid_to null is open.

    events: entity, at (timestamp), rank (orders rows of one instant, the highest counts), value (string;
    null ends a period without starting one). Rows with a null entity or at are ignored, repeated rows
    count once, a value restated changes nothing, and an instant's overruled values last no time
    and so give no period. Nothing comes of empty input; other columns are not used.

    Common snapshots are few and share one numbering, so their spans aren't parted by size.

    One hash aggregate makes a bitmap per entity, span and value. Runs of consecutive bits, carried over
    the snapshots from which the entity is absent, are its periods within a word. Per span only the first and
    last runs matter to its neighbours; one row per entity and span settles what continues across the border.
    """
    known = events.where(F.col("entity").isNotNull() & F.col("at").isNotNull()).select("entity", "at", "rank", "value")
    known = known.withColumn("span", F.date_trunc(span, "at")) if common_snapshots else in_spans(known, span, span_rows)
    one = (
        known.groupBy("entity", "at", "span")
        .agg(F.max(F.struct("rank", F.col("value").isNotNull().alias("given"), "value"))["value"].alias("value"))
    )
    words = presence_bitmaps(one, common_snapshots)
    present = F.bit_or("bits").over(Window.partitionBy("entity", "span", "word"))
    carried = words.withColumn("run", _carried(F.col("bits"), present))
    starts = F.col("run").bitwiseAND(F.bitwise_not(F.shiftleft("run", 1)))
    begun = carried.withColumn("starts", starts).select(
        "entity",
        "span",
        "value",
        F.explode(F.map_values(F.map_filter("times", lambda b, _: F.col("starts").bitwiseAND(_bit(b)) != 0))).alias("at"),
    )
    within = Window.partitionBy("entity", "span").orderBy("at")
    runs = (
        begun.withColumn("nth", F.row_number().over(within))
        .withColumn("before", F.lag("value").over(within))
        .where((F.col("nth") == 1) | ~F.col("value").eqNullSafe(F.col("before")))
        .withColumn("next_at", F.lead("at").over(within))
    )
    spans = runs.groupBy("entity", "span").agg(
        F.min(F.struct("at", "value")).alias("first"), F.max(F.struct("at", "value")).alias("last"), F.min("next_at").alias("second_at")
    )
    onward = Window.partitionBy("entity").orderBy("span")
    spans = spans.withColumn("prior", F.lag("last").over(onward))
    goes_on = F.col("prior").isNotNull() & F.col("prior")["value"].eqNullSafe(F.col("first")["value"])
    spans = spans.withColumn("goes_on", goes_on).withColumn("change_at", F.when(F.col("goes_on"), F.col("second_at")).otherwise(F.col("first")["at"]))
    later = Window.partitionBy("entity").orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    borders = spans.withColumn("after_at", F.min("change_at").over(later)).select("entity", "span", "goes_on", "after_at")
    whole = runs.join(borders, ["entity", "span"])
    return (
        whole.where(F.col("value").isNotNull() & ~((F.col("nth") == 1) & F.col("goes_on")))
        .select("entity", "value", F.col("at").alias("valid_from"), F.coalesce("next_at", "after_at").alias("valid_to"))
    )
