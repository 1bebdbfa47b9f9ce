"""Near-copies of vectors through a pivot-permutation index, verified by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import settled
from tablewright.llm.links import components
from tablewright.llm.tiles import bounds, roots, runs
from tablewright.llm.topk import matrix, usable

PIVOTS = 256
SAMPLE = 4096  # rows the pivots are picked from
NEAREST = 6  # pivots that describe a vector
SHARED = 2  # of them that two vectors must share to be compared
BLOCK = 1024  # vectors of a pivot's list that a tile takes from either side
APART = 0.7  # cosine that two pivots stay under


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, largest component 1/2 to 1: no square overflows or vanishes, and
    cosines of vectors of ordinary size do not change by a bit."""
    if not x.size:
        return x
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def spread_out(sample: np.ndarray, count: int, apart: float = APART) -> np.ndarray:
    """Unit vectors of the sample, in its order, none near an earlier one."""
    sample = scaled(sample)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen = np.zeros((0, sample.shape[1]))
    for row in unit:
        if len(chosen) == count:
            break
        if not len(chosen) or (chosen @ row).max() < apart:
            chosen = np.vstack([chosen, row])
    return chosen


def _describe(pivots: np.ndarray, nearest: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = scaled(matrix(b.column("x"), pivots.shape[1]).astype(np.float64))
            near = x @ pivots.T  # the order of one vector's pivots does not depend on its length
            m = min(nearest, len(pivots))
            order = np.argpartition(-near, m - 1, axis=1)[:, :m] if m else near.astype(int)
            order = np.sort(order, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("rep"), b.column("copies"),
                    pa.array([r.tobytes() for r in x], pa.binary()),
                    pa.array(list(order), pa.list_(pa.int32())),
                ],
                names=["rep", "copies", "x", "near"],
            )

    return describe


def _verify(threshold: float, shared: int, pivots: int):
    def tile(t: pa.Table, pivot: int, i: int, j: int) -> tuple:
        x = np.frombuffer(b"".join(t.column("x").to_pylist())).reshape(t.num_rows, -1)
        near = t.column("near").combine_chunks()
        member = np.zeros((t.num_rows, pivots), np.float32)
        sizes = np.diff(near.offsets.to_numpy())
        member[np.repeat(np.arange(t.num_rows), sizes), near.flatten().to_numpy()] = 1
        block = t.column("block").to_numpy()
        lower = member[:, :pivot]
        found = (member @ member.T >= shared) & (lower @ lower.T == 0)  # in its first list only
        found &= np.triu(np.ones(found.shape, bool), 1)
        if i != j:
            found &= block[:, None] != block[None, :]
        length = np.linalg.norm(x, axis=1)
        a, b = np.nonzero(found & (x @ x.T / (length[:, None] * length[None, :]) >= threshold))
        copies = t.column("copies").to_numpy()
        links = np.bincount(a, copies[b], t.num_rows) + np.bincount(b, copies[a], t.num_rows)
        rep = t.column("rep").to_numpy()
        order = np.argsort(rep, kind="stable")
        place = np.argsort(order, kind="stable")
        root = rep[order][roots(len(rep), place[a], place[b])][place]
        some = links > 0
        return rep[some], root[some], links[some].astype(np.int64)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["pivot", "i", "j"]):
            keys = [t.column(k).to_numpy() for k in ("pivot", "i", "j")]
            ends = bounds(*keys)
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                if e - s < 2:
                    continue
                rep, root, links = tile(t.slice(s, e - s), *(int(k[s]) for k in keys))
                if len(rep):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rep), pa.array(root), pa.array(links)], names=["a", "b", "links"]
                    )

    return verify


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
    vector_col: str = "embedding", pivots: int = PIVOTS, nearest: int = NEAREST,
    shared: int = SHARED, block: int = BLOCK,
) -> DataFrame:
    """id, n_links, component_id and kept of each row, linked by cosine >= threshold.

    Pivots are picked from SAMPLE rows (by hash of the id), each apart from the others.  A vector is
    described by its nearest pivots and stands in their inverted lists; two vectors that share
    enough pivots are compared, once, in the first list they share.  Where the sample lies so close
    together that it gives too few pivots to tell vectors apart, one list holds all of them and all
    pairs are compared: more work, no link lost.  A list is cut into blocks and
    each pair of blocks is one tile, so a large list, or a large group of near copies, is spread
    over tasks.  A tile counts shared pivots and cosines by matrix products and returns link counts
    and one star per connected group, never pairs.  Equal vectors are compared once and counted as
    often as they occur.  Vectors may be as long or short as doubles go.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing and
    are their own component; rows with a NULL id have no component.  Vectors of unequal length are
    compared as if the shorter ended in zeros.  Rows that repeat an id give equal rows and count
    once (by the smallest of their vectors).  An empty table gives no rows.
    """
    base = vectors.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(vector_col).cast("array<double>").alias("x"),
    )
    sound = usable("x") & F.exists("x", lambda v: v != 0) & F.col("id").isNotNull()
    rows = base.filter(sound).groupBy("id").agg(F.min("x").alias("x"))
    same = settled(
        rows.groupBy("x").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors"
    )
    width = same.agg(F.max(F.size("x"))).first()[0] or 1
    picked = same.select("rep", "x").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE)
    sample = picked.toArrow().combine_chunks().column("x")
    sample = pa.concat_arrays(sample.chunks or [pa.array([], pa.list_(pa.float64()))])
    chosen = spread_out(matrix(sample, width), pivots)
    nearest = min(nearest, len(chosen))
    shared = min(shared, nearest)
    if len(chosen) and 2 * nearest - len(chosen) >= shared:  # any two vectors share enough
        chosen, nearest, shared = chosen[:1], 1, 1
    lists = settled(
        same.mapInArrow(
            _describe(chosen, nearest), "rep long, copies long, x binary, near array<int>"
        ),
        "pivots",
    )
    in_list = lists.withColumn("pivot", F.explode("near"))
    counts = {r["pivot"]: r["count"] for r in in_list.groupBy("pivot").count().collect()}
    parts = [-(-counts.get(p, 1) // block) for p in range(len(chosen))] or [1]
    tiles = (
        in_list.withColumn("parts", F.array(*(F.lit(n) for n in parts))[F.col("pivot")])
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            "block", "rep", "copies", "x", "near",
        )
        .repartition("pivot", "i", "j")
        .sortWithinPartitions("pivot", "i", "j")
    )
    found = settled(
        tiles.mapInArrow(
            _verify(threshold, shared, len(chosen)), "a long, b long, links long"
        ),
        "near",
    )
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    classes = (
        same.join(links, "rep", "left")
        .join(groups, "rep", "left")
        .select(
            "x", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = rows.join(classes, "x").select("id", "n_links", "component_id")
    return base.select("id").join(linked, "id", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component_id", "id")).alias("kept"),
    )

