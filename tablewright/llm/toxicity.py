"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM on their features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import settled
from tablewright.llm.language import logistic

SUBSEQUENCE = 3  # characters of a subsequence
REACH = 8  # characters that it spans at most
DECAY = 0.7  # weight of each character it spans
ALPHABET = 64
LONGEST = 24  # longer units are cut into overlapping ones
LANDMARKS = 128
SAMPLE = 4000  # labelled documents per class that the SVM learns from
CALIBRATION = 2000  # further ones per class that the score is calibrated on
WITNESS_DOCS = 3  # toxic documents that must hold a witness
CHANCE = 0.1  # expected number of units that look like witnesses by chance
WITNESS_RATE = 8.0  # times as often as in clean documents
WITNESS_PURITY = 0.8  # share of the documents with a witness that are toxic
UNITS = 6000  # clean units that the SVM learns from
DISGUISED = 200  # witness units that the SVM also learns in other writings
CACHE = 400_000  # distinct units a task remembers
STEMS = (4, 5)
CUTOFF = 0.7


# ------------------------------------------------------------------ kernel


def _code(c: str) -> int:
    """Letters as 1..63, others 0; a-z have codes of their own, other letters share the rest."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + (ord(c) * 2654435761 >> 7) % (ALPHABET - 27) if c.isalpha() else 0


class Codes(dict):
    def __missing__(self, c: str) -> int:
        self[c] = _code(c)
        return self[c]


CODES = Codes()


@lru_cache(maxsize=64)
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences within reach in a unit of this length, and their weights."""
    at = [
        (i, i + j, i + k)
        for i in range(length)
        for j, k in combinations(range(1, min(REACH, length - i)), SUBSEQUENCE - 1)
    ]
    at = np.array(at, np.int64).reshape(-1, SUBSEQUENCE)
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of the subsequences of units of one length, a row each.

    Equal subsequences of a unit are added up in one place, the others weigh 0.  Signs and digits
    take part in no subsequence but widen the span of those around them.
    """
    at, weight = _places(codes.shape[1])
    a, b, c = (codes[:, at[:, k]].astype(np.int32) for k in range(SUBSEQUENCE))
    key = (a * ALPHABET + b) * ALPHABET + c
    w = np.where((a > 0) & (b > 0) & (c > 0), weight, np.float32(0))
    order = np.argsort(key, axis=1)
    key, w = np.take_along_axis(key, order, 1), np.take_along_axis(w, order, 1)
    if key.shape[1]:
        new = np.ones(key.shape, bool)
        new[:, 1:] = key[:, 1:] != key[:, :-1]
        flat = np.flatnonzero(new.ravel())
        sums = np.zeros(key.size, np.float32)
        sums[flat] = np.add.reduceat(w.ravel(), flat)
        w = sums.reshape(key.shape)
    return key, w


def by_length(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the units of each length, and their codes."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for s in range(0, len(at), 4096):
            part = at[s : s + 4096]
            flat = [CODES[c] for i in part for c in units[i]]
            yield part, np.array(flat, np.int64).reshape(len(part), n)


def listed(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, key and weight of every subsequence of the units, each unit of length 1."""
    rows, keys, weights = [], [], []
    for at, codes in by_length(units):
        key, w = subsequences(codes)
        w = w / np.maximum(np.sqrt((w * w).sum(axis=1, keepdims=True)), 1e-12)
        i, j = np.nonzero(w)
        rows.append(at[i])
        keys.append(key[i, j])
        weights.append(w[i, j])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(weights)


@dataclass
class Marks:
    """Explicit kernel features of a few units, over the subsequences that any of them holds."""

    keys: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, units: list[str]) -> Marks:
        row, key, weight = listed(units)
        keys, place = np.unique(key, return_inverse=True)
        out = np.zeros((len(units), len(keys)), np.float32)
        out[row, place] = weight
        return cls(keys, out)


def kernel(units: list[str], marks: Marks) -> np.ndarray:
    """Normalised kernel of units against marks."""
    out = np.zeros((len(units), len(marks.rows)), np.float32)
    if not len(marks.keys):
        return out
    for s in range(0, len(units), 512):
        row, key, weight = listed(units[s : s + 512])
        place = np.minimum(np.searchsorted(marks.keys, key), len(marks.keys) - 1)
        hit = marks.keys[place] == key
        part = np.zeros((len(units[s : s + 512]), len(marks.keys)), np.float32)
        part[row[hit], place[hit]] = weight[hit]
        out[s : s + 512] = part @ marks.rows.T
    return out


# ------------------------------------------------------------------ units


def pieces(unit: str) -> list[str]:
    """A long unit as overlapping windows."""
    if len(unit) <= LONGEST:
        return [unit]
    return [unit[s : s + LONGEST] for s in range(0, len(unit) - LONGEST // 2, LONGEST // 2)]


def letters(unit: str) -> str:
    """The unit without signs and digits."""
    return unit if unit.isalpha() else "".join(filter(str.isalpha, unit))


def units_of(text: str | None) -> set[str]:
    """Distinct units of a text: words with their signs, and letters that stand alone, joined."""
    words = (text or "").lower().split()
    out = set(words)
    alone = [i for i, w in enumerate(words) if len(w) == 1]
    if len(alone) > 2:
        run = [alone[0]]
        for i in [*alone[1:], -1]:
            if i == run[-1] + 1:
                run.append(i)
            else:
                if len(run) > 2:
                    out.update(pieces("".join(words[k] for k in run)))
                run = [i]
    return out


# ------------------------------------------------------------------ model


@dataclass
class Model:
    """The SVM as one weight per subsequence, and the calibration of a document's best unit.

    `own` are witness words, by their letters, and what each adds to its decision: a feature of the
    word alone, for words that share their subsequences with clean ones.
    """

    weight: np.ndarray
    bias: float
    slope: np.ndarray
    own: dict[str, float]

    def decide(self, units: list[str]) -> np.ndarray:
        """The SVM's decision for each unit; that of its worst window for a long one."""
        parts = [pieces(u) for u in units]
        flat = [p for x in parts for p in x]
        f = np.full(len(flat), self.bias, np.float32)
        for at, codes in by_length(flat):
            key, w = subsequences(codes)
            length = np.sqrt((w * w).sum(axis=1))
            f[at] += (w * self.weight[key]).sum(axis=1) / np.maximum(length, 1e-12)
        if self.own:
            f += np.fromiter((self.own.get(letters(p), 0.0) for p in flat), np.float32, len(flat))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(sizes) - sizes
        return np.maximum.reduceat(f, starts) if len(f) else f

    def probability(self, best: np.ndarray) -> np.ndarray:
        x = np.stack([best, np.ones(len(best))], axis=1)
        return 1 / (1 + np.exp(-np.clip(x @ self.slope, -30, 30)))


class Scorer:
    """A model with the decisions on the units met so far."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, float] = {}

    def best(self, texts: list[str | None]) -> np.ndarray:
        """The highest decision among the units of each text; the bias where there is none."""
        split = [units_of(t) for t in texts]
        distinct = set().union(*split) if split else set()
        new = list(distinct.difference(self.known))
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, list(distinct)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.known.update(zip(part, self.model.decide(part).tolist(), strict=True))
        known = self.known.__getitem__
        return np.array([max(map(known, u), default=self.model.bias) for u in split])


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """A linear SVM with squared hinge loss by Newton steps on the rows within the margin."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        inside = 1 - y * (x @ w) > 0
        a = x[inside]
        bend = (a * cost[inside][:, None]).T @ a + ridge * np.eye(len(w))
        new = np.linalg.solve(bend, (a * (cost * y)[inside][:, None]).sum(axis=0))
        if np.abs(new - w).max() < 1e-7:
            break
        w = w + 0.8 * (new - w)
    return w


def fit(
    positive: list[str], negative: list[str], written: list[str] = (), landmarks: int = LANDMARKS
) -> tuple[np.ndarray, float]:
    """Weight per subsequence and bias of the SVM; `written` are further positive units.

    Landmarks are the first positive units and others spread over both classes.  With K the kernel among landmarks, a unit's Nyström
    features are K^-1/2 times its kernel with them.  A linear function of these is a weighted sum of
    kernels with landmarks, hence of the unit's own subsequences, which is how it is stored.
    """
    half = landmarks // 2
    chosen = [*positive[: half // 2], *spread(positive[half // 2 :], half - half // 2)]
    chosen += spread(negative, landmarks - half)
    positive = [*positive, *written]
    marks = Marks.of(chosen)
    values, vectors = np.linalg.eigh((marks.rows @ marks.rows.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = np.concatenate([kernel(positive, marks), kernel(negative, marks)]).astype(np.float64) @ root
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    cost = np.where(y > 0, 4.0 * len(y) / max(len(positive), 1), 4.0 * len(y) / max(len(negative), 1)) / 10
    w = squared_hinge(x, y, cost)
    weight = np.zeros(ALPHABET**SUBSEQUENCE, np.float32)
    weight[marks.keys] = marks.rows.T @ (root @ w[:-1])
    return weight, float(w[-1])


def disguises(unit: str) -> list[str]:
    """Other writings of a unit: gapped, and with a character put in, doubled or covered."""
    half = len(unit) // 2
    return [
        ".".join(unit), f"{unit[:half]}-{unit[half:]}", f"{unit[:half]}*{unit[half + 1 :]}",
        f"{unit[:half]}{unit[half]}{unit[half:]}", f"{unit[: half + 1]}x{unit[half + 1 :]}",
    ] if unit else []


def spread(units: list[str], count: int) -> list[str]:
    """Units picked one after the other, each the farthest from those picked."""
    pool = units[: 8 * count]
    if len(pool) <= count or not count:
        return pool
    picked = [0]
    marks = Marks.of(pool).rows
    near = marks @ marks[0]
    while len(picked) < count:
        at = int(np.argmin(near))
        picked.append(at)
        near = np.maximum(near, marks @ marks[at])
    return [pool[i] for i in picked]


def _counts(docs: DataFrame) -> DataFrame:
    """unit or stem, and the number of toxic and of clean documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for label, text in zip(b.column("toxic").to_pylist(), b.column("text"), strict=True):
                units = {u for u in units_of(text.as_py()) if 3 <= len(u) <= LONGEST and u.isalpha()}
                stems = {f"{u[:n]}*" for u in units for n in STEMS if len(u) > n}
                seen[label].update(units | stems)
            names = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_pydict(
                {
                    "unit": pa.array(names, pa.string()),
                    "toxic": pa.array([seen[1][u] for u in names], pa.int64()),
                    "clean": pa.array([seen[0][u] for u in names], pa.int64()),
                }
            )

    return docs.mapInArrow(count, "unit string, toxic long, clean long").groupBy("unit").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def chance(toxic: Column, clean: Column, share: float) -> Column:
    """Log of a Chernoff bound on as many toxic ones or more, if toxic are `share` of all documents.

    For counts whose toxic share is at least `share`.
    """
    n = toxic + clean
    some = F.when(clean > 0, clean * F.log(clean / (n * (1 - share)))).otherwise(0.0)
    return -(toxic * F.log(toxic / (n * share)) + some)


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE,
          calibration: int = CALIBRATION) -> Model | None:
    """The model, from labelled documents where `learn` holds.

    Per class the first `sample` documents by a hash of the id teach the SVM and the next
    `calibration` ones its scale: whole texts, a bounded number of them.  A label holds for a whole
    document, so its witnesses are found first: units, or stems of units, that far more toxic
    documents hold than clean ones, more than chance explains over all units tested.  The units of clean documents are the other class.  Witnesses
    whose stem clean documents hold as well do not teach subsequences; like every witness word they
    get what their decision lacks to the median of the taught units as a weight of their own, and the clean words of
    their stem are counter-examples.  None where a class has no documents or there is no witness.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .filter(learn).withColumn("draw", F.xxhash64("doc_id", F.lit(4)))
    )
    picked = None
    for label in (0, 1):
        part = (
            known.filter(F.col("toxic") == label).orderBy("draw", "doc_id")
            .limit(sample + calibration).select("doc_id", "toxic", "draw")
        )
        picked = part if picked is None else picked.unionByName(part)
    rows = picked.toArrow()  # at most 2 * (sample + calibration) ids
    role = {}
    for label in (0, 1):
        at = np.flatnonzero(rows.column("toxic").to_numpy() == label)
        order = at[np.lexsort((rows.column("doc_id").to_numpy()[at], rows.column("draw").to_numpy()[at]))]
        ids = rows.column("doc_id").to_numpy()[order].tolist()
        cut = min(sample, -(-2 * len(ids) // 3))
        role.update({i: (i, label, n >= cut) for n, i in enumerate(ids)})
    if len({x[1] for x in role.values()}) < 2:
        return None
    spark = docs.sparkSession
    chosen = spark.createDataFrame(list(role.values()), "doc_id long, toxic int, held boolean")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    counts = settled(_counts(texts.filter(~F.col("held")).select("toxic", "text")), "units")
    n_toxic = sum(x[1] == 1 and not x[2] for x in role.values())
    n_clean = sum(x[1] == 0 and not x[2] for x in role.values())
    rate = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    often_toxic = counts.filter(F.col("toxic") >= WITNESS_DOCS)
    share = n_toxic / (n_toxic + n_clean)
    found = often_toxic.filter(
        (chance(F.col("toxic"), F.col("clean"), share) <= np.log(CHANCE / max(often_toxic.count(), 1)))
        & (rate >= WITNESS_RATE)
        & (F.col("toxic") >= WITNESS_PURITY * (F.col("toxic") + F.col("clean")))
    ).orderBy(F.col("toxic").desc(), "unit").limit(UNITS)
    witness = [r["unit"] for r in found.collect()]
    stems = {u[:-1] for u in witness if u.endswith("*")}
    clean = counts.filter((F.col("clean") > 0) & ~F.col("unit").endswith("*"))
    often = clean.orderBy(F.col("clean").desc(), "unit").limit(UNITS // 3)
    any_ = clean.orderBy(F.xxhash64("unit"), "unit").limit(UNITS)
    starts = F.lit(False)
    for n in STEMS:
        part = [x for x in stems if len(x) == n]
        starts = starts | F.substring("unit", 1, n).isin(part) if part else starts
    alike = counts.filter(starts & ~F.col("unit").endswith("*"))
    more = alike.filter("toxic > 0 AND clean = 0").orderBy(F.col("toxic").desc(), "unit")
    words = [u for u in witness if not u.endswith("*")]
    begun = {u[:n] for u in words for n in STEMS if len(u) > n}
    mixed = counts.filter(F.col("unit").isin([f"{x}*" for x in sorted(begun)])).filter(
        F.col("toxic") < WITNESS_PURITY * (F.col("toxic") + F.col("clean"))
    )
    impure = {r["unit"][:-1] for r in mixed.collect()}  # stems that clean documents hold as well
    for n in STEMS:
        part = [x for x in sorted(impure) if len(x) == n]
        starts = starts | F.substring("unit", 1, n).isin(part) if part else starts
    hard = counts.filter(starts & ~F.col("unit").endswith("*") & (F.col("clean") > F.col("toxic")))
    hard = hard.orderBy(F.col("clean").desc(), "unit")
    positive = [u for u in words if not any(u[:n] in impure for n in STEMS if len(u) > n)]
    positive += [r["unit"] for r in more.limit(UNITS // 3).collect()]
    positive = list(dict.fromkeys(positive or words))
    taken = {*positive, *words}
    negative = [r["unit"] for part in (hard.limit(UNITS // 3), often, any_) for r in part.collect()]
    negative = [u for u in dict.fromkeys(negative) if u not in taken]
    if not positive or not negative:
        return None
    written = [v for u in positive[:DISGUISED] for v in disguises(u)]
    weight, bias = fit(positive, negative, written)
    model = Model(weight, bias, np.array([4.0, 0.0]), {})
    level = max(1.0, float(np.median(model.decide(positive))))
    model.own = {u: level - float(f) for u, f in zip(words, model.decide(words), strict=True) if f < level}
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(tool.best(b.column("text").to_pylist())), b.column("toxic")],
                names=["best", "toxic"],
            )

    held = texts.filter("held").select("text", "toxic").mapInArrow(judge, "best double, toxic int")
    scored = held.toArrow()
    best, toxic = scored.column("best").to_numpy(), scored.column("toxic").to_numpy()
    if len(set(toxic.tolist())) == 2:
        slope = logistic(np.stack([best, np.ones(len(best))], axis=1), toxic.astype(float))
        if slope[0] > 0:
            model.slope = slope
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows with `score` (0 to 1) and `predicted` (1 from CUTOFF on).

    The score is the calibrated decision of the SVM on the most toxic unit of the whole text.  NULL
    and empty texts have the score of a text without a unit; without a model all scores are 0.
    Columns of these names are replaced; all others, and repeated rows, stay.
    """
    names = ["score", "predicted"]
    rest = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Scorer(shared.value) if shared.value else None
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                texts = b.column(text_col).to_pylist()
                p = tool.model.probability(tool.best(texts)) if tool else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in rest), pa.array(p), pa.array((p >= CUTOFF).astype(np.int32))],
                    names=[*rest, *names],
                )

    rows = docs.select(rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(mark, f"{schema}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents not predicted toxic, with their own columns."""
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    text = docs.columns.index("text")
    kept = score(docs.select(*own), model, f"c{text}").filter("predicted = 0")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
