"""All pairs of vectors of at least some similarity, exactly, counted per vector.

Vectors go to the cell of their nearest centroid. The segment between two of a pair in different cells crosses the
plane halfway between the two centroids, so one of them lies within half the pair's greatest distance of it. A vector
therefore also visits every cell to whose plane it is as near as that, and no pair is lost. No cell is too large for a task: the rows of a
full one are parted by their hashes, and each two parts are compared by a task of their own.

Equal vectors are one class, compared once and counted with all its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Rows, at most about so many, to which the centroids are fitted. Every row is compared.
SAMPLE = 16_384
#: Rows aimed at for a cell, most cells, and rows, visitors included, beyond which a cell's rows are parted and its parts compared two by two.
CELL_ROWS = 4096
MOST_CELLS = 2048
FULL_CELL = 32_768
#: Similarities computed at once.
PAIRS = 1 << 22


def sound_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """(chunk_id, embedding, cls): the current vector of each id, if it has ``dim`` finite numbers that are not all zero."""
    e = F.col("embedding")
    latest = vectors.where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by("embedding", "row_seq").alias("embedding"))
    finite = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return latest.where(e.isNotNull() & (F.size(e) == dim) & finite & F.exists(e, lambda x: x != 0)).withColumn("cls", F.xxhash64("embedding"))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.sqrt((x**2).sum(1))[:, None]


def centroids_of(x: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    c = x[np.random.default_rng(11).choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(1) - 2 * x[b : b + 4096] @ c.T).argmin(1) for b in range(0, len(x), 4096)])
        total, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return np.unique(c, axis=0)


def cells_of(x: np.ndarray, centroids: np.ndarray, apart: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
    """(own cell, matrix of the cells that each row is in or visits). apart: distances of the centroids."""
    d = (centroids**2).sum(1) - 2 * x @ centroids.T
    own = d.argmin(1)
    # the difference is twice the distance to the plane times that of the centroids
    at = d - np.take_along_axis(d, own[:, None], 1) <= 2 * half * apart[own] + 1e-9
    return own, at


def near_links(vectors: DataFrame, least: float, dim: int = 64) -> DataFrame:
    """Rows (chunk_id, n_links): every id with a usable vector, and how many other ids have one at least ``least`` similar.

    vectors: chunk_id, row_seq (of several rows of an id the highest counts), embedding. Similarity is the cosine
    rounded to 6 decimals. Nothing is approximate, but that equal vectors are told by a 64-bit hash. Vectors that
    are null, zero, not finite or not of ``dim`` numbers take no part. Empty input gives no rows.
    """
    spark = vectors.sparkSession
    known = sound_vectors(vectors, dim)
    classes = cut_lineage(known.groupBy("cls").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n")))
    count = classes.count()
    if not count:
        return known.select("chunk_id", F.lit(0).cast("bigint").alias("n_links"))
    part = F.pmod(F.xxhash64("cls", F.lit("sample")), F.lit(1 << 20)) < max(1, int(min(1.0, SAMPLE / count) * (1 << 20)))
    drawn = classes.where(part).select("embedding").toPandas().embedding  # about SAMPLE rows
    cells = int(np.clip(count // CELL_ROWS, 1, MOST_CELLS))
    found = centroids_of(unit_rows(drawn), cells) if cells > 1 and len(drawn) else np.zeros((1, dim))
    shared = spark.sparkContext.broadcast((found, np.stack([np.sqrt(((found - c) ** 2).sum(1)) for c in found])))
    half = np.sqrt(max(0.0, 2 - 2 * (least - 1e-6))) / 2

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            if len(whole):
                at = sum(cells_of(unit_rows(whole.embedding[b : b + 1024]), *shared.value, half)[1].sum(0) for b in range(0, len(whole), 1024))
                yield pd.DataFrame({"cell": np.flatnonzero(at), "n": at[at > 0]})

    # a row per cell
    sizes_of = classes.select("embedding").mapInPandas(places, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    parts_of = np.ones(len(found), np.int64)
    parts_of[sizes_of.cell] = -(-sizes_of.n.to_numpy() // FULL_CELL)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for b in range(0, len(whole), 1024):
                pdf = whole[b : b + 1024]
                own, at = cells_of(unit_rows(pdf.embedding), *shared.value, half)
                row, cell = np.nonzero(at)
                visited = [np.flatnonzero(a) for a in at]
                cls, parts = pdf.cls.to_numpy(), parts_of[cell]
                copies = np.repeat(np.arange(len(row)), parts)  # with every part of its cell
                other = np.arange(len(copies)) - np.repeat(np.cumsum(parts) - parts, parts)
                row, cell = row[copies], cell[copies]
                part = cls[row] % parts_of[cell]
                yield pd.DataFrame(
                    {
                        "cell": cell,
                        "low": np.minimum(part, other),
                        "high": np.maximum(part, other),
                        "is_low": part <= other,
                        "home": own[row],
                        "cls": cls[row],
                        "n": pdf.n.to_numpy()[row],
                        "embedding": pdf.embedding.to_numpy()[row],
                        "visited": [visited[r] if own[r] == c else [] for r, c in zip(row, cell, strict=True)],
                    }
                )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        """Per class the links counted in this cell, between two of its parts or within one: among its own rows, and between these and visitors.

        A pair that meets in both its cells counts in the lower one.
        """
        cell, home, n = int(pdf.cell.iloc[0]), pdf.home.to_numpy(), pdf.n.to_numpy()
        x, links = unit_rows(pdf.embedding), np.zeros(len(pdf), np.int64)
        mine, low, one_part = home == cell, pdf.is_low.to_numpy(), pdf.low.iloc[0] == pdf.high.iloc[0]
        visits = np.zeros((len(pdf), len(shared.value[0])), bool)
        for i in np.flatnonzero(mine):
            visits[i, pdf.visited.iloc[i]] = True

        def compare(rows: np.ndarray, own: np.ndarray, same: bool, guests: bool) -> None:
            step = max(1, PAIRS // max(1, len(own)))
            for b in range(0, len(rows), step):
                r = rows[b : b + step]
                near = np.round(x[r] @ x[own].T, 6) >= least
                if same:
                    near[np.arange(len(r)), b + np.arange(len(r))] = False
                else:
                    if guests:
                        near &= (home[r] > cell)[:, None] | ~visits[own][:, home[r]].T
                    links[own] += n[r] @ near
                links[r] += near @ n[own]

        if one_part:
            compare(np.flatnonzero(mine), np.flatnonzero(mine), same=True, guests=False)
            compare(np.flatnonzero(~mine), np.flatnonzero(mine), same=False, guests=True)
        else:
            compare(np.flatnonzero(mine & low), np.flatnonzero(mine & ~low), same=False, guests=False)
            compare(np.flatnonzero(~mine & low), np.flatnonzero(mine & ~low), same=False, guests=True)
            compare(np.flatnonzero(~mine & ~low), np.flatnonzero(mine & low), same=False, guests=True)
        return pd.DataFrame({"cls": pdf.cls, "links": links})[links > 0]

    sent = classes.mapInPandas(route, "cell bigint, low bigint, high bigint, is_low boolean, home bigint, cls bigint, n bigint, embedding array<float>, visited array<bigint>")
    links = sent.groupBy("cell", "low", "high").applyInPandas(search, "cls bigint, links bigint").groupBy("cls").agg(F.sum("links").alias("links"))
    sizes = classes.select("cls", (F.col("n") - 1).alias("same")).join(links, "cls", "left")
    return known.select("chunk_id", "cls").join(sizes, "cls").select("chunk_id", (F.col("same") + F.coalesce("links", F.lit(0))).alias("n_links"))
