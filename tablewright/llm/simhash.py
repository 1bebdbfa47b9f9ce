"""SimHash fingerprints and their near-copies by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_digest

from tablewright.llm.common import settled
from tablewright.llm.links import components
from tablewright.llm.tiles import bounds, roots, runs

BITS = 64
SEED = 42
BLOCK = 2048  # fingerprints with one part value that a tile takes from either side
PAIRS = 1 << 21  # comparisons held at once
BROADCAST_ROWS = 50_000  # heavy part values, at 20 bytes each
PAIR_COST = 0.02  # of a comparison, against one probe row through the shuffle


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of a text's word shingles as a signed number; 0 where there is no word."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    k = min(words, len(parts))
    starts = np.append(0, ends[:-1] + 1)[: len(parts) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        digests = b"".join(
            [xxh64_digest(joined[s:e], SEED)
             for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)]
        )
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (as a signed long) of each document, from its whole text."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(fps, pa.int64())], names=["id", "fp"]
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(mark, "id long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, bit 0 the lowest."""
    return np.unpackbits(
        np.ascontiguousarray(fp, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
    )


def part_value(fp: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of a part, packed."""
    out = np.zeros(len(fp), np.int64)
    for at, bit in enumerate(part):
        out |= ((fp >> bit) & 1) << at
    return out


def group_bits(together: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Bits in `parts` parts of even width, correlated bits in one part.

    together[i, j] counts the fingerprints with bits i and j set.  A part starts with the strongest
    pair of free bits and takes the bit of strongest mean correlation with it until it is full.
    """
    p = np.diag(together) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((together / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, -1.0)
    free, out = list(range(BITS)), []
    for n in range(parts):
        width = BITS // parts + (n < BITS % parts)
        at = np.unravel_index(np.argmax(tie[np.ix_(free, free)]), (len(free), len(free)))
        part = [free[i] for i in dict.fromkeys(at)]
        free = [b for b in free if b not in part]
        while len(part) < width:
            nearest = max(free, key=lambda b: (tie[b, part].mean(), -b))
            part.append(nearest)
            free.remove(nearest)
        out.append(sorted(part[:width]))
        free = sorted([*free, *part[width:]])
    return out


def growth(p: np.ndarray, most: int) -> list[float]:
    """How the candidates of a part grow with its threshold, from 0 to `most` bits.

    Two values meet in all bits with some chance; letting a bit differ multiplies that chance by
    2p(1-p) over p^2+(1-p)^2.
    """
    ratio = 2 * p * (1 - p) / (p**2 + (1 - p) ** 2)
    poly = np.zeros(most + 1)
    poly[0] = 1
    for r in ratio:
        poly[1:] += r * poly[:-1].copy()
    return np.cumsum(poly).tolist()


def allocate(cost: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds, -1 (not probed) or more, of least total cost; (t + 1) sum up to distance + 1.

    cost[i][t] is the cost of part i at threshold t.  With such thresholds two fingerprints within
    the distance are within its threshold in at least one part.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (sofar, chosen) in best.items():
            for t in range(-1, min(len(part) - 1, distance - used) + 1):
                new = (sofar + (part[t] if t >= 0 else 0.0), [*chosen, t])
                if used + t + 1 not in step or new < step[used + t + 1]:
                    step[used + t + 1] = new
        best = step
    return best[distance + 1]


def _together(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often each pair of bits is set, over all fingerprints."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for b in batches:
            bits = _bits(b.column("fp").to_numpy()).astype(np.float64)
            total += bits.T @ bits
            n += len(bits)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(x.ravel(), last).astype(np.int64))
             for x, last in ((i, -1), (j, -1), (total, n))],
            names=["i", "j", "n"],
        )

    out, total = np.zeros((BITS, BITS)), 0
    counted = fps.select("fp").mapInArrow(count, "i long, j long, n long")
    for r in counted.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 4,097 rows
        if r["i"] < 0:
            total = r["n"]
        else:
            out[r["i"], r["j"]] = r["n"]
    return out, total


def _emit(parts: list[tuple[int, list[int], int]]):
    """(part, key, fp, own): a fingerprint's own value of each part and its neighbours within reach."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            for part, bits, reach in parts:
                value = part_value(fp, bits)
                for t in range(reach + 1):
                    for flip in combinations(range(len(bits)), t):
                        key = value ^ sum(1 << f for f in flip)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(fp), part, np.int32)), pa.array(key),
                                pa.array(fp), pa.array(np.full(len(fp), t == 0)),
                            ],
                            names=["part", "key", "fp", "own"],
                        )

    return emit


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= distance


def _verify(distance: int):
    def links(fp: np.ndarray, left: np.ndarray, right: np.ndarray, ends: np.ndarray):
        """Pairs of places (left role, right role of one run) within the distance."""
        order = np.lexsort((~left, np.repeat(np.arange(len(ends) - 1), np.diff(ends))))
        n_left = np.add.reduceat(left.astype(np.int64), ends[:-1])
        by_right = np.lexsort((~right, np.repeat(np.arange(len(ends) - 1), np.diff(ends))))
        n_right = np.add.reduceat(right.astype(np.int64), ends[:-1])
        pairs = np.where(n_left * n_right > 1, n_left * n_right, 0)
        some = np.flatnonzero(pairs)
        for at in some[pairs[some] > PAIRS]:
            step = max(1, PAIRS // int(n_right[at]))
            r = by_right[ends[at] : ends[at] + n_right[at]]
            for s in range(0, int(n_left[at]), step):
                one = order[ends[at] + s : ends[at] + min(s + step, int(n_left[at]))]
                a, b = np.nonzero(_near(fp[one][:, None], fp[r][None, :], distance))
                yield one[a], r[b]
        some = some[pairs[some] <= PAIRS]
        cuts = np.cumsum(pairs[some]) // PAIRS
        for c in np.unique(cuts):
            g = some[cuts == c]
            run = np.repeat(g, pairs[g])
            within = np.arange(len(run)) - np.repeat(np.cumsum(pairs[g]) - pairs[g], pairs[g])
            a = order[ends[run] + within // n_right[run]]
            b = by_right[ends[run] + within % n_right[run]]
            near = _near(fp[a], fp[b], distance)
            yield a[near], b[near]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["part", "key", "tile"]):
            fp, role = t.column("fp").to_numpy(), t.column("role").to_numpy()
            ends = bounds(*(t.column(k).to_numpy() for k in ("part", "key", "tile")))
            nodes, place = np.unique(fp, return_inverse=True)
            root = np.arange(len(nodes))
            for a, b in links(fp, (role & 1) > 0, (role & 2) > 0, ends):
                a, b = root[place[a]], root[place[b]]
                root = roots(len(nodes), a, b)[root]
            moved = root != np.arange(len(nodes))
            if moved.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"]
                )

    return verify


def plan(fps: DataFrame, distance: int) -> tuple[list[tuple[int, list[int], int]], DataFrame]:
    """(number, bits, threshold) of each part that is probed, and the fingerprints per own value."""
    together, total = _together(fps)
    p = np.diag(together) / max(total, 1)
    tried = {m: group_bits(together, total, m) for m in (2, 3, 4)}
    named = [(100 * m + n, bits, 0) for m, groups in tried.items() for n, bits in enumerate(groups)]
    values = (
        fps.select("fp").mapInArrow(_emit(named), "part int, key long, fp long, own boolean")
        .groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    )
    values = settled(values, "values")
    meet = {
        r["part"]: r["pairs"]
        for r in values.groupBy("part").agg(F.sum(F.expr("n * double(n)")).alias("pairs")).collect()
    }
    choices = []
    for m, groups in tried.items():
        cost = []
        for n, bits in enumerate(groups):
            grown = growth(p[bits], distance)
            balls = np.cumsum([comb(len(bits), t) for t in range(distance + 1)])
            pairs = meet.get(100 * m + n, 0.0)
            cost.append(
                [float(total * balls[t] + PAIR_COST * pairs * grown[t]) for t in range(distance + 1)]
            )
        choices.append((*allocate(cost, distance), m))
    _, reach, m = min(choices)
    parts = [(100 * m + n, bits, t) for n, (bits, t) in enumerate(zip(tried[m], reach, strict=True))]
    return [x for x in parts if x[2] >= 0], values


def near_fingerprints(fps: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """(node, component) of distinct fingerprints that links of `distance` bits tie to a smaller one.

    Bits that go together share a part; thresholds per part, and the number of parts, are the ones
    of least estimated work by dynamic programming on counts over all fingerprints.  Every
    fingerprint is listed under its own part values and probes the values within the threshold;
    whoever meets there is compared.  A frequent value is cut into a grid of tiles.  Tiles return
    one star per connected group instead of pairs.
    """
    parts, values = plan(fps, distance)
    heavy = values.filter(
        F.col("part").isin([x[0] for x in parts]) & (F.col("n") > block)
    ).select("part", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    if heavy.count() <= BROADCAST_ROWS:
        heavy = F.broadcast(heavy)
    met = fps.select("fp").mapInArrow(_emit(parts), "part int, key long, fp long, own boolean")
    a = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    b = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    steps = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = F.transform(
        steps, lambda j: F.struct((a * F.col("blocks") + j).alias("tile"), F.lit(1).alias("role"))
    )
    right = F.transform(
        steps, lambda i: F.struct((i * F.col("blocks") + b).alias("tile"), F.lit(2).alias("role"))
    )
    single = F.array(F.struct(
        F.lit(0).alias("tile"), F.when(F.col("own"), F.lit(3)).otherwise(F.lit(2)).alias("role")
    ))
    spots = (
        F.when(F.col("blocks").isNull(), single)
        .when(F.col("own"), F.concat(left, right))
        .otherwise(right)
    )
    tiles = (
        met.join(heavy, ["part", "key"], "left")
        .select("part", "key", "fp", F.explode(spots).alias("spot"))
        .select("part", "key", "spot.tile", "fp", "spot.role")
        .repartition("part", "key", "tile")
        .sortWithinPartitions("part", "key", "tile")
    )
    return components(tiles.mapInArrow(_verify(distance), "a long, b long"))


def simhash_groups(
    docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id of each document.

    Fingerprints of four-word shingles, repeats included, from whole texts; a text of fewer words is
    one shingle, NULL and empty texts have fingerprint zero and link like any other.  Documents
    whose fingerprints are within the distance, directly or through others, share the smallest id as
    component.  Equal fingerprints are compared once.  Rows that repeat an id give a row each; a
    NULL id is no component of its own (NULL unless a document with an id is reached).  An empty
    table gives no rows.
    """
    marked = settled(fingerprints(docs, id_col, text_col), "fingerprints")
    same = settled(marked.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    near = near_fingerprints(same.select("fp"), distance).withColumnRenamed("node", "fp")
    classes = settled(
        same.join(near, "fp", "left").withColumn("root", F.coalesce("component", "fp")), "roots"
    )
    smallest = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    grouped = classes.join(smallest, "root").select("fp", "component_id")
    return marked.join(grouped, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(docs: DataFrame, distance: int = 4) -> DataFrame:
    """One document of each group of near-copies stays: that of the smallest id, all its columns.

    Of rows that repeat an id one stays.  Rows with a NULL id stay.
    """
    kept = (
        simhash_groups(docs, distance)
        .filter("doc_id = component_id")
        .select("doc_id")
        .distinct()
    )
    stay = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    stay = stay.dropDuplicates(["doc_id"]).select(docs.columns)
    return stay.unionByName(docs.filter("doc_id IS NULL"))
