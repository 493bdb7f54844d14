"""Order-dependent building blocks that never put one key, or everything, on one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def dense_ids(df: DataFrame, order: list[Column | str], name: str, start: int = 1) -> DataFrame:
    """df with consecutive numbers in the given order, which should be total.

    Rows are range-partitioned and sorted once; a row's number is its place in its partition plus the sizes of the
    partitions before. Only one row per partition is ever looked at together.
    """
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    marked = placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = marked.join(F.broadcast(before.drop("_n")), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_at") + start).drop("_part", "_at", "_before")


def carry_forward(df: DataFrame, key: str, seq: str, order: list[str], values: dict[str, str], span: int = 1 << 16) -> DataFrame:
    """df with, for each name: value column in ``values``, the last non-null value in earlier rows of the key.

    order begins with seq, a number, and is total within a key. Rows are looked at in spans of ``span`` numbers, on as
    many tasks as there are spans even for one hot key; one row per key and span carries values over the borders.
    """
    spanned = df.withColumn("_span", F.floor(F.col(seq) / span))
    prior = Window.partitionBy(key, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = spanned.withColumns({f"_local_{n}": F.last(v, ignorenulls=True).over(prior) for n, v in values.items()})
    at = F.struct(*order)
    ends = spanned.groupBy(key, "_span").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(f"_end_{n}") for n, v in values.items()])
    over = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_span", *[F.last(f"_end_{n}", ignorenulls=True).over(over).alias(f"_carried_{n}") for n in values])
    joined = local.join(carried, [key, "_span"])
    filled = joined.withColumns({n: F.coalesce(f"_local_{n}", f"_carried_{n}") for n in values})
    return filled.drop("_span", *[f"_{w}_{n}" for n in values for w in ("local", "carried")])


def chain_ends(links: DataFrame, source: str, target: str, most_rounds: int = 40) -> DataFrame:
    """(source, end, steps): where the chain of links from each source ends, by pointer doubling.

    links: each source once. A chain that runs into a cycle has no end: its end is null and its steps are those
    that were followed. The number of rounds is the logarithm of the longest chain.
    """
    found = cut_lineage(
        links.where(F.col(source).isNotNull() & F.col(target).isNotNull())
        .groupBy(F.col(source).alias("source"))
        .agg(F.max(target).alias("end"))
        .withColumn("steps", F.lit(1).cast("bigint"))
    )
    for _ in range(most_rounds):
        then = found.select(F.col("source").alias("end"), F.col("end").alias("further"), F.col("steps").alias("more"))
        longer = cut_lineage(
            found.join(then, "end", "left").select(
                "source", F.coalesce("further", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved")
            )
        )
        found = longer.drop("moved")
        # a chain longer than there are links goes round
        left = longer.where("moved").agg(F.count("*").alias("n"), F.min("steps").alias("least")).first()
        if not left["n"] or left["least"] > longer.count():
            break
    open_ended = found.join(found.select(F.col("source").alias("end")), "end", "left_semi").select("source").withColumn("cyclic", F.lit(True))
    return found.join(open_ended, "source", "left").select(
        "source", F.when(F.col("cyclic").isNull(), F.col("end")).alias("end"), F.when(F.col("cyclic").isNull(), F.col("steps")).alias("steps")
    )
