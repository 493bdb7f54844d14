"""References to records that do not exist, are deleted or came later."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Most words of 64 bits of one filter: what is broadcast at once stays below some 40 MB. More parents take more filters, one after another.
MOST_WORDS = 1 << 22
BITS_PER_KEY = 12
#: Words that stand together in one row of a filter.
ROW_WORDS = 64


def _mask(key: Column) -> Column:
    """Four of the 64 bits of a key's word, from a second hash."""
    h = F.xxhash64(key, F.lit("mask"))
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def filter_shape(parents: int) -> tuple[int, int]:
    """(filters, rows of each) for so many parents."""
    words = max(1, math.ceil(parents * BITS_PER_KEY / 64))
    filters = -(-words // MOST_WORDS)
    return filters, -(-words // (filters * ROW_WORDS))


def _placed(df: DataFrame, key: str, filters: int, rows: int) -> DataFrame:
    """df with the filter, the row in it and the word in the row that a key's hash names."""
    word = F.pmod(F.xxhash64(F.col(key)), F.lit(filters * rows * ROW_WORDS))
    at = df.withColumn("_w", word)
    return at.withColumns({"_filter": F.expr(f"_w div {rows * ROW_WORDS}"), "_row": F.expr(f"_w div {ROW_WORDS}"), "_at": (F.col("_w") % ROW_WORDS).cast("int")}).drop("_w")


def bloom_filters(parents: DataFrame, key: str, filters: int, rows: int) -> DataFrame:
    """Blocked Bloom filters as a table (_filter, _row, _bits): each key sets four bits in the one word that its hash names.

    Words are packed ``ROW_WORDS`` to a row, so the table is hardly larger than its bits.
    """
    words = _placed(parents, key, filters, rows).groupBy("_filter", "_row", "_at").agg(F.bit_or(_mask(F.col(key))).alias("_word"))
    packed = words.groupBy("_filter", "_row").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_word"))).alias("m"))  # ROW_WORDS at most
    bits = F.transform(F.sequence(F.lit(0), F.lit(ROW_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint")))
    return packed.select("_filter", "_row", bits.alias("_bits"))


def probed(children: DataFrame, ref: str, parents: DataFrame, key: str, count: int) -> DataFrame:
    """children with ``maybe``: false where the filters prove that the reference has no parent.

    Parents beyond what one filter holds are shared out by hash among several of the same size; each child asks the one filter that could
    hold its reference, and the filters are broadcast in turn, never together.
    """
    filters, rows = filter_shape(count)
    mask = _mask(F.col(ref))
    maybe = F.coalesce(F.get("_bits", F.col("_at")).bitwiseAND(mask) == mask, F.lit(False))
    asked = lambda df, bits: df.join(F.broadcast(bits.drop("_filter")), "_row", "left").withColumn("maybe", maybe).drop("_filter", "_row", "_at", "_bits")
    placed, bits = _placed(children, ref, filters, rows), bloom_filters(parents, key, filters, rows)
    if filters == 1:
        return asked(placed, bits)
    placed, bits = cut_lineage(placed), cut_lineage(bits)
    parts = [cut_lineage(asked(placed.where(F.col("_filter") == i), bits.where(F.col("_filter") == i))) for i in range(filters)]
    return reduce(DataFrame.unionByName, parts)


def orphan_references(children: DataFrame, parents: DataFrame, child_table: str, child_field: str) -> DataFrame:
    """Rows (child_table, child_field, child_key, kind, period), one per bad reference.

    children: child_key, ref, at (timestamp; null ref is no reference, but its time counts for the key).
    parents: parent_key (each once), is_deleted (boolean), first_at (timestamp or null: never late).
    kind is the first that applies of 'missing', 'deleted' and 'late' over the rows of a child key;
    period is the month of the key's earliest time. Null child or parent keys are ignored; empty
    parents make every reference 'missing'; empty children give no rows.

    Children are reduced to one row per key and reference before anything is joined. The filter of
    parent keys proves most dangling references by themselves; only rows that it lets
    through take part in the exact join, whose hot parents adaptive execution splits, as the parent side is unique.
    """
    slim = (
        children.where(F.col("child_key").isNotNull())
        .groupBy("child_key", "ref")
        .agg(F.min("at").alias("at"))
    )
    parents = parents.where(F.col("parent_key").isNotNull()).select("parent_key", "is_deleted", "first_at")
    count = parents.count()
    none = slim.where(F.col("ref").isNull())
    asked = probed(slim.where(F.col("ref").isNotNull()), "ref", parents, "parent_key", count)
    surely, maybe = asked.where(~F.col("maybe")), asked.where("maybe")
    facts = lambda df, missing, deleted, first: df.select("child_key", "at", missing.alias("missing"), deleted.alias("deleted"), first.alias("first_at"))
    never = F.lit(None).cast("timestamp_ntz")
    exact = maybe.join(parents, maybe["ref"] == parents["parent_key"], "left")
    checked = facts(exact, F.col("parent_key").isNull(), F.coalesce("is_deleted", F.lit(False)), F.col("first_at"))
    checked = checked.unionByName(facts(none, F.lit(False), F.lit(False), never)).unionByName(facts(surely, F.lit(True), F.lit(False), never))
    per_key = checked.groupBy("child_key").agg(
        F.max("missing").alias("missing"), F.max("deleted").alias("deleted"), F.max("first_at").alias("first_at"), F.min("at").alias("at")
    )
    kind = F.when(F.col("missing"), "missing").when(F.col("deleted"), "deleted").when(F.col("first_at") > F.col("at"), "late")
    return per_key.select(
        F.lit(child_table).alias("child_table"),
        F.lit(child_field).alias("child_field"),
        "child_key",
        kind.alias("kind"),
        F.date_format("at", "yyyy-MM").alias("period"),
    ).where(F.col("kind").isNotNull())


def orphan_report(found: DataFrame) -> DataFrame:
    """Bad references counted per table, field, kind and month."""
    return found.groupBy("child_table", "child_field", "kind", "period").agg(F.count("*").alias("refs"))
