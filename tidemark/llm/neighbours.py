"""The most similar stored vectors of every vector, by inverted multi-indexes.

A vector travels to the group of the centroid nearest to it, and as a guest to the few groups whose centroids are hardly farther.
Each group holds an inverted multi-index of its own rows: the two halves of a vector are quantised apart, so that few centroids make many
cells; a query, member or guest, visits the cells, pairs of centroids, in the order of their summed distances, and its candidates are reranked
by exact similarity. Groups are kept to a size by counting all rows, not by a guess, so the indexes are as fine for any number of vectors.

Equal vectors are one class with one representative in the index; whoever is similar to it is similar to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIM = 64
#: Rows, at most about so many, to which the groups' centroids are fitted. Every row is indexed.
SAMPLE = 32_768
#: A smaller sample of raw rows is drawn again, from the usable vectors alone.
LEAST_SAMPLE = 1024
#: Rows aimed at for a group, and those beyond which it is split, or its guests shared out.
GROUP_ROWS = 8192
FULL_GROUP = 4 * GROUP_ROWS
#: Most groups that are fitted at once; splitting makes more.
MOST_GROUPS = 4096
SPLIT_ROUNDS = 4
#: Groups to which a vector travels at most, its own included, and how much farther than the nearest one a group may be, in squared distance.
ROUTES = 6
ROUTE_MARGIN = 0.06
#: Cells that a query visits at most in a group, and how much farther than the nearest one a cell may be, in squared distance.
VISITS = 32
MARGIN = 0.3
#: Root of the rows expected in a cell. A cell with more than FULL_CELL gets an index of its own.
ROOT_OF_CELL = 8.0
FULL_CELL = 2048
#: Rows of a group to which its codebooks are fitted, and pairs held until the best of each query are picked.
FIT_ROWS = 16_384
HELD_PAIRS = 1 << 22


@dataclass
class Index:
    """Codebooks of both halves; cells that are too full lead on to finer ones."""

    first: np.ndarray
    second: np.ndarray
    base: int  # number of the first cell
    finer: dict[int, Index] = field(default_factory=dict)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances but for what is the same for all centroids."""
    return (centroids**2).sum(1) - 2 * (x @ centroids.T)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([nearest(x[b : b + 4096], c).argmin(1) for b in range(0, len(x), 4096)])
        total, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def half_cells(index: Index, unit: np.ndarray) -> np.ndarray:
    half = DIM // 2
    return nearest(unit[:, :half], index.first).argmin(1) * len(index.second) + nearest(unit[:, half:], index.second).argmin(1)


def fit(unit: np.ndarray, rng: np.random.Generator, taken: list[int], depth: int = 0) -> Index:
    """An index of these rows. taken: cells numbered so far."""
    half = DIM // 2
    drawn = unit if len(unit) <= FIT_ROWS else unit[rng.choice(len(unit), FIT_ROWS, replace=False)]
    k = int(max(1, len(unit) ** 0.5 / ROOT_OF_CELL))
    index = Index(k_means(drawn[:, :half], k, rng), k_means(drawn[:, half:], k, rng), taken[0])
    taken[0] += len(index.first) * len(index.second)
    cell = half_cells(index, unit)
    for c, n in zip(*np.unique(cell, return_counts=True), strict=True):
        if FULL_CELL < n < len(unit) and depth < 8:
            index.finer[int(c)] = fit(unit[cell == c], rng, taken, depth + 1)
    return index


def own_cells(index: Index, unit: np.ndarray) -> np.ndarray:
    """The cell in which each row is stored."""
    cell = half_cells(index, unit)
    out = index.base + cell
    for c, finer in index.finer.items():
        inside = cell == c
        out[inside] = own_cells(finer, unit[inside])
    return out


def cells_by_heap(a: list[float], b: list[float], most: int) -> list[tuple[int, int]]:
    """Pairs of places in two ascending lists in the order of their sums, as far as the margin."""
    farthest = a[0] + b[0] + MARGIN
    heap, out = [(a[0] + b[0], 0, 0)], []
    while len(out) < most and heap and heap[0][0] <= farthest:
        _, i, j = heappop(heap)
        out.append((i, j))
        if j + 1 < len(b):
            heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def visits(index: Index, unit: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all cells that the rows visit."""
    half, width = DIM // 2, len(index.second)
    lists = []
    for x, c in ((unit[:, :half], index.first), (unit[:, half:], index.second)):
        d = nearest(x, c)
        m = min(most, d.shape[1])
        top = np.argpartition(d, m - 1, axis=1)[:, :m]
        kept = np.take_along_axis(d, top, 1)
        order = np.argsort(kept, axis=1, kind="stable")
        lists += [np.take_along_axis(top, order, 1).tolist(), np.take_along_axis(kept, order, 1).tolist()]
    rows, cells, deeper = [], [], {}
    for row, (ti, di, tj, dj) in enumerate(zip(*lists, strict=True)):
        for i, j in cells_by_heap(di, dj, most):
            cell = ti[i] * width + tj[j]
            if cell in index.finer:
                deeper.setdefault(cell, []).append(row)
            else:
                rows.append(row)
                cells.append(index.base + cell)
    parts = [(np.array(rows, np.int64), np.array(cells, np.int64))]
    for cell, who in deeper.items():
        inner, c = visits(index.finer[cell], unit[who], most)
        parts.append((np.array(who, np.int64)[inner], c))
    return np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts])


def routes(unit: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, group, whether the row is stored there) of all groups to which the rows travel."""
    out = []
    for b in range(0, len(unit), 4096):
        d = nearest(unit[b : b + 4096], centroids)
        m = min(ROUTES, d.shape[1])
        top = np.argpartition(d, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(d, top, 1)
        least = near.min(1, keepdims=True)
        row, at = np.nonzero(near <= least + ROUTE_MARGIN)
        out.append((row + b, top[row, at], at == near.argmin(1)[row]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def unit_rows(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return wide / np.sqrt((wide**2).sum(1))[:, None]


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float32)


def to_unit(vectors: pd.Series) -> np.ndarray:
    return unit_rows(matrix(vectors)).astype(np.float32)


ROUTED = "slot int, cls bigint, name string, vector binary, is_entry boolean, is_query boolean"


def search_group(pdf: pd.DataFrame, keep: int, least: float, most: int) -> pd.DataFrame:
    """(a, b, similarity): the ``keep`` most similar entries of each query among the cells that it visits in this group's index."""
    x = np.frombuffer(b"".join(pdf.vector), np.float32).reshape(-1, DIM)
    wide = unit_rows(x)
    unit = wide.astype(np.float32)
    entry, query = np.flatnonzero(pdf.is_entry), np.flatnonzero(pdf.is_query)
    nothing = pd.DataFrame({"a": [], "b": [], "similarity": []}).astype({"a": np.int64, "b": np.int64})
    if not len(entry) or not len(query):
        return nothing
    rank = np.empty(len(pdf), np.int64)
    rank[np.argsort(pdf.name.to_numpy(object), kind="stable")] = np.arange(len(pdf))  # by code points, as UTF-8 bytes compare
    index = fit(unit[entry], np.random.default_rng(7), [0])
    own = own_cells(index, unit[entry])
    order = np.argsort(own, kind="stable")
    entry, own = entry[order], own[order]
    held, size, step = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0, 8192

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, sim = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((rank[b], -sim, a))
        a, b, sim = a[order], b[order], sim[order]
        good = np.arange(len(a)) - np.searchsorted(a, a) < keep
        return a[good], b[good], sim[good]

    for q in range(0, len(query), step):
        asking = query[q : q + step]
        who, cell = visits(index, unit[asking], most)
        by_cell = np.argsort(cell, kind="stable")
        who, cell = asking[who[by_cell]], cell[by_cell]
        met, first = np.unique(cell, return_index=True)
        lo, hi = np.searchsorted(own, met), np.searchsorted(own, met, "right")
        for begin, end, l, h in zip(first.tolist(), [*first[1:].tolist(), len(cell)], lo.tolist(), hi.tolist(), strict=True):
            if l == h:
                continue
            near = unit[who[begin:end]] @ unit[entry[l:h]].T  # all that visit a cell with all that lie in it
            i, j = np.nonzero(near >= least - 1e-4)
            a, b = who[begin + i], entry[l + j]
            sim = np.round(np.einsum("nd,nd->n", wide[a], wide[b]), 6)
            good = (sim >= least) & (a != b)
            held.append((a[good], b[good], sim[good]))
            size += len(a)
            if size > HELD_PAIRS:
                held = [best()]
                size = len(held[0][0])
    a, b, sim = best()
    cls = pdf.cls.to_numpy()
    return pd.DataFrame({"a": cls[a], "b": cls[b], "similarity": sim})


def is_usable(e: Column) -> Column:
    sound = (F.size(e) == DIM) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)) & F.exists(e, lambda x: x != 0)
    return e.isNotNull() & sound


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(chunk_id, embedding, cls): the current vector of each id, if it has 64 numbers that are not all zero."""
    e = F.col("embedding")
    latest = vectors.where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by("embedding", "row_seq").alias("embedding"))
    return latest.where(is_usable(e)).withColumn("cls", F.xxhash64("embedding"))


def groups_of(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes stored in each group, classes that are its guests), about, over all rows (cls, embedding), of which several may be of one class."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                row, group, own = routes(to_unit(pdf.embedding), held.value)
                cls = pdf.cls.to_numpy()[row]
                yield pd.DataFrame({"grp": group, "own": own, "cls": cls}).drop_duplicates()

    sent = rows.select("cls", "embedding").mapInPandas(assign, "grp int, own boolean, cls bigint")
    n = sent.groupBy("grp", "own").agg(F.approx_count_distinct("cls").alias("n")).toPandas()  # two rows per group
    out = np.zeros((2, len(centroids)), np.int64)
    out[n.own.astype(int), n.grp] = n.n
    return out[1], out[0]


def balanced_groups(rows: DataFrame, centroids: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, parts among which each group's guests are shared out): groups that hold too many classes are split until none does.

    A full group's centroid gives way to several, fitted to a new bounded sample of the rows in full groups.
    """
    spark = rows.sparkSession
    for attempt in range(SPLIT_ROUNDS + 1):
        own, guests = groups_of(rows, centroids)
        full = np.flatnonzero(own > FULL_GROUP)
        if not len(full) or attempt == SPLIT_ROUNDS:
            break
        held = spark.sparkContext.broadcast((centroids, full))
        share = min(1.0, SAMPLE / own[full].sum())
        drawn = rows.where(F.pmod(F.xxhash64("cls", F.lit(f"split {attempt}")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

        def inside(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    group = nearest(to_unit(pdf.embedding), held.value[0]).argmin(1)
                    kept = np.isin(group, held.value[1])
                    yield pd.DataFrame({"grp": group[kept], "cls": pdf.cls.to_numpy()[kept], "embedding": pdf.embedding.to_numpy()[kept]})

        some = drawn.select("cls", "embedding").mapInPandas(inside, "grp int, cls bigint, embedding array<float>").dropDuplicates(["cls"]).toPandas()  # about SAMPLE rows
        made = [np.delete(centroids, full, axis=0)]
        for g in full:
            x = some.embedding[some.grp == g]
            k = min(len(x), -(-int(own[g]) // GROUP_ROWS))
            made.append(k_means(to_unit(x), k, rng) if k > 1 else centroids[g : g + 1])
        centroids = np.concatenate(made)
    return centroids, np.maximum(1, -(-guests // FULL_GROUP))


def top_similar(vectors: DataFrame, k: int = 5, least: float = -1.0, visited: int = VISITS) -> DataFrame:
    """Rows (chunk_id, place, other, similarity): of every usable vector the k most similar others, at least ``least`` similar.

    vectors: chunk_id, row_seq (of several rows of an id the highest counts), embedding. Similarity is the cosine
    rounded to 6 decimals; equal ones rank by chunk_id. Vectors that are null, zero, not of 64 numbers or hold
    nulls or NaN take no part. Empty input gives no rows; other columns are not used.

    Approximate in one way only: a neighbour is not found if neither side travels to the other's group and visits its cell there.
    Equal vectors are told by a 64-bit hash. Of a class, however large, only its first k + 1 ids can be among
    anyone's k most similar, so only those are looked at as neighbours, and every member gets its own list.
    """
    spark = vectors.sparkSession
    known = usable_vectors(vectors)
    members = known.select("cls", "chunk_id")
    heads = members.withColumn("nth", F.row_number().over(Window.partitionBy("cls").orderBy("chunk_id"))).where(F.col("nth") <= k + 1).drop("nth")
    firsts = members.groupBy("cls").agg(F.min("chunk_id").alias("chunk_id"))
    classes = known.join(firsts.select("chunk_id"), "chunk_id", "left_semi").select("cls", F.col("chunk_id").alias("name_"), "embedding")
    # what only fits and counts reads the raw table, so that nothing is shuffled for it
    raw = vectors.where(F.col("chunk_id").isNotNull() & is_usable(F.col("embedding"))).select(F.xxhash64("embedding").alias("cls"), "embedding")
    rows = vectors.count()
    part = lambda share: F.pmod(F.xxhash64("cls", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))
    draw = lambda share: raw.where(part(share)).dropDuplicates(["cls"]).select("embedding").toPandas().embedding  # about SAMPLE rows
    sample = draw(min(1.0, SAMPLE / max(1, rows)))
    if len(sample) < LEAST_SAMPLE and rows > SAMPLE:
        rows = raw.agg(F.approx_count_distinct("cls")).first()[0]
        sample = draw(min(1.0, max(SAMPLE, LEAST_SAMPLE) / max(1, rows)))
    if not len(sample):
        return spark.createDataFrame([], "chunk_id string, place int, other string, similarity double")
    rng = np.random.default_rng(7)
    count = int(np.clip(rows // GROUP_ROWS, 1, min(MOST_GROUPS, len(sample))))
    centroids = k_means(to_unit(sample), count, rng)
    centroids, parts = balanced_groups(raw, centroids, rng) if count > 1 else (centroids, np.ones(1, np.int64))
    before = np.cumsum(parts) - parts
    shared = spark.sparkContext.broadcast((centroids, parts, before))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, parts, before = shared.value
        for whole in batches:
            for at in range(0, len(whole), 4096):
                pdf = whole[at : at + 4096]
                raw = matrix(pdf.embedding)
                row, group, own = routes(unit_rows(raw).astype(np.float32), centroids)
                cls, names = pdf.cls.to_numpy(), pdf.name_.to_numpy()
                asked = cls[row] % parts[group]  # the part of the group in which a row is a query; it is an entry in all
                copies = np.where(own, parts[group], 1)
                row, group, own, asked = (np.repeat(c, copies) for c in (row, group, own, asked))
                nth = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                part = np.where(own, nth, asked)
                yield pd.DataFrame(
                    {
                        "slot": before[group] + part,
                        "cls": cls[row],
                        "name": np.where(own, names[row], ""),
                        "vector": [raw[r].tobytes() for r in row],
                        "is_entry": own,
                        "is_query": part == asked,
                    }
                )

    tasks = int(min(2 * parts.sum(), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 200)))  # not merged by size, as time goes by pairs
    groups = classes.mapInPandas(route, ROUTED).repartition(tasks, "slot").groupBy("slot")
    found = groups.applyInPandas(lambda pdf: search_group(pdf, k + 1, least, visited), "a bigint, b bigint, similarity double")
    itself = firsts.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("similarity"))
    ways = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = found.select(F.explode(ways).alias("w"), "similarity").select("w.a", "w.b", "similarity").distinct().unionByName(itself)
    by_rank = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "other")
    near = (
        both.join(heads.select(F.col("cls").alias("b"), F.col("chunk_id").alias("other")), "b")
        .withColumn("nth", F.row_number().over(by_rank))
        .where(F.col("nth") <= k + 1)
    )
    lists = near.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("nth", "other", "similarity"))).alias("near"))  # k + 1 at most
    own = members.join(lists, members["cls"] == lists["a"])
    others = F.slice(F.filter("near", lambda x: x["other"] != F.col("chunk_id")), 1, k)
    return own.select("chunk_id", F.posexplode(others).alias("place", "x")).select(
        "chunk_id", (F.col("place") + 1).alias("place"), F.col("x.other").alias("other"), F.col("x.similarity").alias("similarity")
    )


def similar_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b, each pair once, of which one side lists the other with enough similarity."""
    near = neighbours.where(F.col("similarity") >= least)
    return near.select(F.least("chunk_id", "other").alias("chunk_id_a"), F.greatest("chunk_id", "other").alias("chunk_id_b")).distinct()
