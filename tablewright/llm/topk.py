"""Exact top-k inner products: tiles of queries and candidates, partial selection, merged lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

QUERY_BLOCK = 8192  # queries that go out to the tasks together
TILE_CELLS = 1 << 21  # scores held at once
EXACT = 2.0**53  # whole numbers below it are exact as doubles


def whole(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(vector: str) -> Column:
    """A vector that is there and holds finite components only."""
    fits = F.forall(
        F.col(vector),
        lambda x: F.coalesce(
            ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)
        ),
    )
    return F.coalesce(fits, F.lit(False))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows, padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    at = np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else np.zeros(0, int)
    out[np.repeat(np.arange(len(sizes)), sizes), at.astype(int)] = flat
    return out


def products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole-number inner products, candidates by queries; exact, clipped to 64 bits."""
    if not c.size or not q.size:
        return np.zeros((len(c), len(q)), np.int64)
    most = max(abs(int(c.min())), int(c.max())) * max(abs(int(q.min())), int(q.max()))
    if most * c.shape[1] < EXACT:
        return (c.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    exact = c.astype(object) @ q.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best rows: high scores first, then small ids."""
    order = np.lexsort((vec, ~score, query))
    q = query[order]
    first = np.append(True, q[1:] != q[:-1]) if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else q
    return order[np.arange(len(q)) - start < k]


def _search(ids: np.ndarray, queries: np.ndarray, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # place of the query, score, vec_id
        step = max(1, TILE_CELLS // max(1, len(ids)))
        for batch in batches:
            vecs = batch.column("vec_id").to_numpy()
            block = matrix(batch.column("v"), queries.shape[1])
            for at in range(0, len(vecs), step):
                vec, tile = vecs[at : at + step], block[at : at + step]
                score = products(tile, queries)
                own = vec[:, None] == ids[None, :]
                score_k = np.where(own, np.iinfo(np.int64).min, score)
                least = (
                    np.partition(score_k, len(vec) - k, axis=0)[len(vec) - k]
                    if len(vec) > k
                    else np.full(len(ids), np.iinfo(np.int64).min)
                )
                row, col = np.nonzero((score >= least[None, :]) & ~own)
                held = [
                    np.concatenate(x)
                    for x in zip(held, (col, score[row, col], vec[row]), strict=True)
                ]
                keep = best(*held, k)
                held = [x[keep] for x in held]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[held[0]]), pa.array(held[2]), pa.array(held[1])],
                names=["query_id", "vec_id", "score"],
            )

    return search


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The k rows of highest inner product for each query row: query_id, rank, vec_id, score.

    Components become floor(scale * x); scores are exact whole numbers.  Every usable row is a
    candidate except rows with the query's own id; ties go to the smaller id.  Queries go out in
    blocks of at most about QUERY_BLOCK, each a broadcast of bounded size; every task streams its
    shard of candidates through matrix products tile by tile and keeps k rows per query.  The lists
    of the tasks are merged in two levels, so no query's lists meet in one task at once.

    Rows whose id is NULL, or whose vector is NULL or holds NULL or non-finite components, take no
    part.  Vectors of unequal length are compared as if the shorter ended in zeros; the empty vector
    scores 0.  A repeated query id counts once (its smallest vector); repeated candidates count as
    often as they occur.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("x"),
        is_query.alias("asks"),
    ).filter(usable("x") & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", whole("x", scale).alias("v"), "asks")
    asked = rows.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    size = rows.agg(F.max(F.size("v")).alias("w"), F.count_if("asks").alias("n")).first()
    width, blocks = size["w"] or 0, -(-(size["n"] or 0) // QUERY_BLOCK) or 1
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        block = part.toArrow().combine_chunks()
        ids = block.column("vec_id").to_numpy().astype(np.int64)
        queries = (
            matrix(pa.concat_arrays(block.column("v").chunks), width)
            if len(ids)
            else np.zeros((0, width), np.int64)
        )
        lists = rows.select("vec_id", "v").mapInArrow(
            _search(ids, queries, k), "query_id long, vec_id long, score long"
        )
        found = lists if found is None else found.unionByName(lists)
    best_first = [F.col("score").desc(), F.col("vec_id")]
    fan = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    merged = found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(fan)))
    for keys in (["query_id", "group"], ["query_id"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first))
        merged = merged.withColumn("rank", rank).filter(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
