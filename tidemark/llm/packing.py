"""Filling fixed-capacity containers: non-negative least squares on the histogram of lengths.

Only the histogram, whose size is fixed by the capacity, is looked at as a whole. Which containers are made
and how often is decided on it; every item then finds its container by its rank within its length, on
as many tasks as there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most length bins of a container. Lengths are rounded up to whole bins while planning, so that every planned container fits.
BINS = 512
#: Items ranked together, about: a bin with more of them is salted by its size, so that one with a third of all items is no hot key.
RANKED_TOGETHER = 100_000


def shallow_combinations(top: int, depth: int = 3) -> np.ndarray:
    """Columns of bin counts: every multiset of up to ``depth`` bins that fills a container of ``top`` bins exactly."""
    found = [[top]]
    found += [[a, top - a] for a in range((top + 1) // 2, top)]
    if depth >= 3:
        found += [[a, b, top - a - b] for a in range(-(-top // 3), top - 1) for b in range(-(-(top - a) // 2), min(a, top - a - 1) + 1)]
    m = np.zeros((top, len(found)))
    for j, bins in enumerate(found):
        for b in bins:
            m[b - 1, j] += 1
    return m


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-2, rounds: int = 4000) -> np.ndarray:
    """x >= 0 that minimises |ax - b|, by the active-set method; equations are only set up for the columns in use.

    It ends when no column would gain more than ``tolerance`` of the largest gain there was; the rounding afterwards loses more.
    """
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = tolerance * max(1e-9, np.abs(a.T @ b).max())
    for _ in range(rounds):
        at = np.flatnonzero(free)
        gain = a.T @ (b - a[:, at] @ x[at])
        gain[at] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= slack:
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            own = a[:, at]
            s = np.linalg.solve(own.T @ own + 1e-9 * np.eye(len(at)), own.T @ b)
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = (x[at][low] / np.maximum(x[at][low] - s[low], 1e-30)).min()
            x[at] += step * (s - x[at])
            free[at[(x[at] <= 1e-12) | (low & (x[at] <= 1e-9))]] = False
            x[~free] = 0
    return x


def plan_containers(histogram: dict[int, int], top: int) -> list[tuple[dict[int, int], int]]:
    """(bins of a container, how many such containers) that use up the histogram exactly.

    Repeat counts come from the least-squares solution rounded down; what that leaves over is packed greedily,
    the largest remaining bin first and then the largest that still fits. Every greedy step uses up a bin
    or a pattern, so the number of steps depends on the number of bins alone.
    """
    left = np.zeros(top + 1, np.int64)
    for b, n in histogram.items():
        left[b] = n
    plan: list[tuple[dict[int, int], int]] = []

    def take(bins: dict[int, int], most: int) -> None:
        n = min([most, *(int(left[b]) // k for b, k in bins.items())])
        if n > 0:
            for b, k in bins.items():
                left[b] -= n * k
            plan.append((bins, n))

    combos = shallow_combinations(top)
    repeats = np.floor(non_negative_least_squares(combos, left[1:].astype(float)) + 1e-6)
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j] < 1:
            break
        take({int(b) + 1: int(combos[b, j]) for b in np.flatnonzero(combos[:, j])}, int(repeats[j]))
    while left.any():
        room, bins = top, {}
        for b in np.flatnonzero(left)[::-1]:
            k = min(room // int(b), int(left[b]))
            if k:
                bins[int(b)] = k
                room -= k * int(b)
        take(bins, int(left.max()))
    return plan


def pieces_of(sizes: DataFrame, capacity: int) -> DataFrame:
    """(item, piece, tokens): one piece per item, and pieces of full capacity and a rest for one that exceeds it."""
    n = F.col("tokens")
    last = F.greatest(F.ceil(n / capacity).cast("int") - 1, F.lit(0))
    part = F.least(F.lit(capacity), n - F.col("piece") * capacity)
    return sizes.select("item", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "item", "piece", part.cast("int").alias("tokens")
    )


def pack(sizes: DataFrame, capacity: int = 2048, ranked_together: int = RANKED_TOGETHER) -> DataFrame:
    """Rows (item, piece, tokens, container): every item once, whole unless it exceeds the capacity by itself.

    sizes: item (unique, any type), tokens. Null or negative sizes count as 0 and empty items are placed too.
    No container holds more than the capacity, whether or not that is a multiple of the bins' width; a piece that is longer
    than all whole bins together has a container of its own. Which of several equally long items goes where follows
    from the items' hashes alone. Empty input gives no rows; other columns are not used.
    """
    if capacity < 1:
        raise ValueError("a container must hold a token")
    spark = sizes.sparkSession
    width = -(-capacity // BINS)
    top = capacity // width
    alone = top + 1
    clean = sizes.select("item", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("tokens"))
    length = F.least(F.lit(alone), F.greatest(F.lit(1), F.ceil(F.col("tokens") / width))).cast("int")
    pieces = pieces_of(clean, capacity).withColumn("bin", length)
    histogram = {r["bin"]: r["n"] for r in pieces.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # a row per bin
    if not histogram:
        return pieces.select("item", "piece", "tokens", F.lit(0).cast("bigint").alias("container"))
    salts = F.create_map(*[F.lit(x) for b, n in histogram.items() for x in (b, -(-n // ranked_together))])
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("item", "piece"), salts[F.col("bin")]))
    counts = pieces.groupBy("bin", "salt").agg(F.count("*").alias("n")).collect()  # a row per bin and some ``ranked_together`` items
    offsets, seen = [], dict.fromkeys(histogram, 0)
    for r in sorted(counts):
        offsets.append((r["bin"], r["salt"], seen[r["bin"]]))
        seen[r["bin"]] += r["n"]
    slots, used, container = [], dict.fromkeys(histogram, 0), 0
    lone = histogram.pop(alone, 0)
    for bins, n in [*plan_containers(histogram, top), *[({alone: 1}, lone)] * (lone > 0)]:
        for b, k in bins.items():
            slots.append((b, used[b], used[b] + n * k, k, container))
            used[b] += n * k
        container += n
    starts = spark.createDataFrame(offsets, "bin int, salt bigint, before bigint")
    places = spark.createDataFrame(slots, "bin int, lo bigint, hi bigint, per bigint, base bigint")
    rank = F.row_number().over(Window.partitionBy("bin", "salt").orderBy(F.xxhash64("item", "piece"), "item", "piece")) - 1
    ranked = pieces.withColumn("rank", rank).join(F.broadcast(starts), ["bin", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    within: Column = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(F.broadcast(places.withColumnRenamed("bin", "_bin")), (F.col("bin") == F.col("_bin")) & within)
    return placed.select("item", "piece", "tokens", (F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).cast("bigint").alias("container"))
