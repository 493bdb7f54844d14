"""Exact nearest neighbours of a stated set of queries among all rows, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries held by every task at once; more are answered in further passes.
QUERY_BLOCK = 20_000
#: Similarities computed at once.
CELLS = 1 << 22


def unit(rows: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, which rows have one): null and zero vectors and those not of ``dim`` numbers have none."""
    sizes = rows.map(lambda v: -1 if v is None else len(v)).to_numpy()
    good = sizes == dim
    x = np.stack(rows[good].to_numpy()).astype(np.float64) if good.any() else np.zeros((0, dim))
    length = np.sqrt((x**2).sum(1))
    sound = np.isfinite(length) & (length > 0)
    good[np.flatnonzero(good)[~sound]] = False
    return x[sound] / length[sound, None], good


def usual_length(rows: DataFrame) -> int:
    """The most common length of all vectors that have numbers, the greatest of several; 1 if there are none."""
    lengths = rows.where("id is not null").groupBy(F.size("embedding").alias("dim")).count().where("dim > 0")
    most = lengths.agg(F.max(F.struct("count", "dim")).alias("m")).select("m.dim").first()
    return most.dim or 1


def best_of_each(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest numbers of each row, of equal ones the first; -inf is none. Only what reaches the k-th number is sorted."""
    kth = np.partition(sim, sim.shape[1] - k, axis=1)[:, [sim.shape[1] - k]] if sim.shape[1] > k else -np.inf
    row, col = np.nonzero((sim >= kth) & (sim > -np.inf))
    order = np.lexsort((col, -sim[row, col], row))
    row, col = row[order], col[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first]


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int, exclude_self: bool = True, dim: int | None = None) -> DataFrame:
    """Rows (query_id, rank, match_id, similarity): the k rows most similar to each query, by cosine.

    queries and rows: id, embedding. Similarity is rounded to 6 decimals and equal ones rank by id. exclude_self leaves out
    the row with the query's own id. Vectors that are null, zero or not finite, or not of ``dim`` numbers, match nothing
    and are matched by nothing. Without dim it is the length that most of all rows have. Empty input gives no rows.

    Every task compares its rows with a block of queries and keeps only the k best of each; these meet per query.
    Queries beyond a block take another pass over the rows, so what is broadcast has a bound.
    """
    spark = rows.sparkSession
    asked = queries.where("id is not null and embedding is not null").select("id", "embedding")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    dim = dim or usual_length(rows)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"query_id {id_type}, match_id {id_type}, similarity double"
    best = None
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()  # about QUERY_BLOCK rows
        q, good = unit(held.embedding, dim) if len(held) else (np.zeros((0, dim)), np.zeros(0, bool))
        block = spark.sparkContext.broadcast((held.id.to_numpy()[good], q))

        def search(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            ids, q = block.value
            for pdf in batches:
                x, sound = unit(pdf.embedding, dim)
                own = pdf.id.to_numpy()[sound]
                if not len(own) or not len(ids):
                    continue
                order = np.argsort(own, kind="stable")
                x, own = x[order], own[order]
                step = max(1, CELLS // len(own))
                for at in range(0, len(ids), step):
                    sim = np.round(q[at : at + step] @ x.T, 6)
                    if exclude_self:
                        sim[ids[at : at + step, None] == own[None, :]] = -np.inf
                    row, col = best_of_each(sim, k)
                    yield pd.DataFrame({"query_id": ids[at + row], "match_id": own[col], "similarity": sim[row, col]})

        part = rows.where("id is not null").select("id", "embedding").mapInPandas(search, schema)
        best = part if best is None else best.unionByName(part)
    ranked = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "match_id")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "match_id", "similarity")


def with_empty(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, hits): an array of (rank, match_id, similarity) for every query, empty for one without hits."""
    lists = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "match_id", "similarity"))).alias("hits"))
    none = F.array().cast("array<struct<rank:int,match_id:string,similarity:double>>")
    joined = queries.select(F.col("id").alias("query_id")).join(lists, "query_id", "left")
    return joined.select("query_id", F.coalesce(F.col("hits").cast(none_type(hits)), none.cast(none_type(hits))).alias("hits"))


def none_type(hits: DataFrame) -> str:
    return f"array<struct<rank:int,match_id:{hits.schema['match_id'].dataType.simpleString()},similarity:double>>"
