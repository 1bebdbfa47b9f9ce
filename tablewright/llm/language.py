"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

ORDER = 5  # characters of an n-gram
SAMPLE = 1500  # documents per language that the models learn from
CALIBRATION = 500  # further documents per language that the score is calibrated on
PRECISION = 0.98  # of accepted predictions on the calibration documents
CACHE = 400_000  # distinct words a task remembers
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
START, END = 2, 3  # code points that no word holds


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case; signs that only stand for numbers (½, ², Ⅷ) are no letters."""
    found = WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


# ------------------------------------------------------------------ n-grams of words


@dataclass
class Grams:
    """The symbols of words and the hash of the n-gram that ends at each, by n."""

    word: np.ndarray  # word of each symbol
    offset: np.ndarray  # place of the symbol in its word, the start sign at 0
    hashes: list[np.ndarray] = field(default_factory=list)  # [n-1]; 0 where the word is too short


def grams(words: list[str], order: int = ORDER) -> Grams:
    """Hashes of all n-grams of `<start>word<end>`, rolled from one order to the next."""
    text = "".join(f"{chr(START)}{w}{chr(END)}" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    offset = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    out = Grams(word, offset)
    rolled, factor = mixed.copy(), np.uint64(1)
    out.hashes.append(rolled.copy())
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            factor = factor * BASE
            longer = rolled.copy()
            longer[n - 1 :] += mixed[: len(mixed) - n + 1] * factor
            rolled = longer
            out.hashes.append(np.where(offset >= n - 1, rolled, np.uint64(0)))
    return out


def _sum_by(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, weights, len(found))


@dataclass
class Level:
    """One order of one language: sorted n-gram hashes with counts, sorted contexts with totals."""

    gram: np.ndarray
    count: np.ndarray
    context: np.ndarray
    total: np.ndarray
    back: np.ndarray  # weight of the lower order after a context
    discount: float


def levels(words: dict[str, int], order: int = ORDER) -> list[Level]:
    """Kneser-Ney counts: raw at the highest order, of distinct left neighbours below it.

    An n-gram that begins with the word's start has no left neighbour and keeps its raw count.
    """
    g = grams(list(words), order)
    freq = np.fromiter(words.values(), np.float64, len(words))[g.word]
    out = []
    for n in range(1, order + 1):
        own = (g.offset >= max(n - 1, 1))
        context = np.concatenate([np.zeros(1, np.uint64), g.hashes[n - 2][:-1]]) if n > 1 else None
        if n == order:
            use, weight = own, freq
        else:
            longer = own & (g.offset >= n)
            at = np.flatnonzero(longer)
            _, first = np.unique(g.hashes[n][at], return_index=True)  # distinct left extensions
            use = np.zeros(len(own), bool)
            use[at[first]] = True
            weight = np.where(use, 1.0, freq)
            if n > 1:
                use |= own & (g.offset == n - 1)
        gram, count = _sum_by(g.hashes[n - 1][use], weight[use])
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = float(once / (once + 2 * twice)) if once and once + 2 * twice else 0.5
        discount = min(max(discount, 0.1), 0.95)
        if n == 1:
            total = count.sum()
            out.append(
                Level(gram, count, np.zeros(1, np.uint64), np.array([total]),
                      np.array([discount * len(gram) / max(total, 1)]), discount)
            )
            continue
        _, first = np.unique(g.hashes[n - 1][use], return_index=True)
        after = context[use][first]  # the context of each n-gram, in the order of `gram`
        name, total = _sum_by(after, count)
        kinds = _sum_by(after, np.minimum(count, discount))[1]
        out.append(Level(gram, count, name, total, kinds / total, discount))
    return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


class Models:
    """All languages in shared sorted hash arrays, one column of probabilities per language.

    `gram[n]` holds the n-grams that any language has seen and the interpolated probability of each
    language there; `back[n]` the contexts and each language's weight of the lower order.  Where no
    language knows an n-gram, the lower order is weighed down by its context, as interpolation says.
    """

    def __init__(self, words: dict[str, dict[str, int]], order: int = ORDER) -> None:
        self.names = sorted(words)
        self.order = order
        per = [levels(words[k], order) for k in self.names]
        alphabet = np.unique(np.concatenate([p[0].gram for p in per]))
        g = grams(list({w for k in self.names for w in words[k]}), order)
        self.back: list[tuple[np.ndarray, np.ndarray]] = []
        self.gram: list[tuple[np.ndarray, np.ndarray]] = []
        floor = 1.0 / (len(alphabet) + 1)
        self.unseen = np.array([p[0].back[0] * floor for p in per])
        for n in range(1, order + 1):
            own = np.flatnonzero(g.offset >= max(n - 1, 1))
            keys, first = np.unique(g.hashes[n - 1][own], return_index=True)
            at = own[first]
            contexts = np.unique(np.concatenate([p[n - 1].context for p in per]))
            back = np.ones((len(contexts), len(per)))
            for k, p in enumerate(per):
                where, hit = _find(p[n - 1].context, contexts)
                back[hit, k] = p[n - 1].back[where[hit]]
            prob = np.zeros((len(keys), len(per)))
            context = g.hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
            if n == 1:
                lower = np.full((len(keys), len(per)), floor)
            else:
                where, _ = _find(self.gram[-1][0], g.hashes[n - 2][at])
                lower = self.gram[-1][1][where]
            spot, hit = _find(contexts, context)
            prob = np.where(hit[:, None], back[spot], 1.0) * lower
            for k, p in enumerate(per):
                where, seen = _find(p[n - 1].gram, keys)
                spot, _ = _find(p[n - 1].context, context)
                more = np.maximum(p[n - 1].count[where] - p[n - 1].discount, 0) / p[n - 1].total[spot]
                prob[seen, k] += more[seen]
            self.back.append((contexts, back))
            self.gram.append((keys, prob))
        self.gram = [(k, p.astype(np.float32)) for k, p in self.gram]
        self.back = [(k, p.astype(np.float32)) for k, p in self.back]

    def score(self, words: list[str]) -> np.ndarray:
        """Per word: the sum of log probabilities per language, and the number of symbols."""
        out = np.zeros((len(words), len(self.names) + 1), np.float32)
        if not words:
            return out
        g = grams(words, self.order)
        told = np.flatnonzero(g.offset >= 1)
        keys, prob = self.gram[0]
        where, hit = _find(keys, g.hashes[0][told])
        p = np.where(hit[:, None], prob[where], self.unseen.astype(np.float32))
        for n in range(2, self.order + 1):
            able = g.offset[told] >= n - 1
            at = told[able]
            keys, prob = self.gram[n - 1]
            where, hit = _find(keys, g.hashes[n - 1][at])
            contexts, back = self.back[n - 1]
            rest = np.flatnonzero(~hit)
            spot, known = _find(contexts, g.hashes[n - 2][at[rest] - 1])
            new = p[able]
            new[rest] *= np.where(known[:, None], back[spot], np.float32(1))
            new[hit] = prob[where[hit]]
            p[able] = new
        logs = np.log(np.maximum(p, 1e-30))
        for k in range(len(self.names)):
            out[:, k] = np.bincount(g.word[told], logs[:, k], len(words))
        out[:, -1] = np.bincount(g.word[told], minlength=len(words))
        return out


class Judge:
    """Models with the scores of the words met so far."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, len(models.names) + 1), np.float32)

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """Per text: sums of log probabilities per language, and the number of symbols."""
        split = [words_of(t) for t in texts]
        distinct = set().union(*split) if split else set()
        new = list(distinct.difference(self.place))
        if len(self.place) + len(new) > CACHE:
            self.place, self.table, new = {}, self.table[:0], list(distinct)
        if new:
            parts = [self.models.score(new[at : at + 20_000]) for at in range(0, len(new), 20_000)]
            self.place.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, *parts])
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, words in enumerate(split):
            if words:
                at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                out[i] = self.table[at].sum(axis=0, dtype=np.float64)
        return out


def margins(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its lead over the next in bits a symbol, and the number of symbols."""
    n = np.maximum(sums[:, -1], 1)
    entropy = -sums[:, :-1] / n[:, None] / np.log(2)
    best = entropy.argmin(axis=1)
    two = np.sort(entropy, axis=1)[:, :2]
    lead = two[:, 1] - two[:, 0] if two.shape[1] > 1 else np.full(len(n), 1.0)
    return best, lead, sums[:, -1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _features(lead: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([lead, lead * np.sqrt(n), np.ones(len(n))], axis=1)


@dataclass
class Classifier:
    models: Models
    weights: np.ndarray
    threshold: float  # score from which a prediction is accepted

    def confidence(self, lead: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(lead, n) @ self.weights, -30, 30)))


def _word_counts(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                seen.update((lang, w) for w in words_of(text.as_py()))
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([k[0] for k in seen], pa.string()),
                    "word": pa.array([k[1] for k in seen], pa.string()),
                    "n": pa.array(list(seen.values()), pa.int64()),
                }
            )

    return docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")
    )


def train(
    docs: DataFrame, learn: Column, sample: int = SAMPLE, calibration: int = CALIBRATION,
    order: int = ORDER,
) -> Classifier | None:
    """Models per language and their calibration, from documents where `learn` holds.

    Per language, the first `sample` documents by a hash of the id teach the models and the next
    `calibration` ones the score: whole texts, a bounded number of them.  None without any.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = rows.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part"))
    for keys in (["lang", "part"], ["lang"]):  # a language may hold most rows: first in its parts
        by_hash = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id")
        picked = picked.withColumn("nth", F.row_number().over(by_hash))
        picked = picked.filter(F.col("nth") <= sample + calibration)
    picked = picked.select("doc_id", "lang", "nth")
    texts = rows.select("doc_id", "lang", "text").join(
        F.broadcast(picked), ["doc_id", "lang"]  # at most sample + calibration rows per language
    )
    counted = _word_counts(texts.filter(F.col("nth") <= sample).select("lang", "text")).toArrow()
    words: dict[str, dict[str, int]] = {}
    for lang, word, n in zip(*(counted.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        words.setdefault(lang, {})[word] = n
    if not words:
        return None
    models = Models(words, order)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Judge(shared.value)
        names = np.array(tool.models.names, dtype=object)
        for b in batches:
            best, lead, n = margins(tool.sums(b.column("text").to_pylist()))
            right = names[best] == np.array(b.column("lang").to_pylist(), dtype=object)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lead), pa.array(n), pa.array(right.astype(float))],
                names=["lead", "n", "right"],
            )

    held = texts.filter(F.col("nth") > sample).select("lang", "text")
    judged = held.mapInArrow(judge, "lead double, n double, right double").toArrow()
    lead, n, right = (judged.column(c).to_numpy() for c in ("lead", "n", "right"))
    if not len(lead):
        return Classifier(models, np.array([2.0, 0.5, 0.0]), 0.5)
    weights = logistic(_features(lead, n), right)
    out = Classifier(models, weights, 0.0)
    order_by = np.argsort(-out.confidence(lead, n), kind="stable")
    hits = np.cumsum(right[order_by]) / np.arange(1, len(right) + 1)
    enough = np.flatnonzero(hits >= PRECISION)
    out.threshold = float(out.confidence(lead, n)[order_by][enough[-1]]) if len(enough) else 1.0
    return out


def identify(docs: DataFrame, classifier: Classifier | None, text_col: str = "text") -> DataFrame:
    """The rows with `lang_pred`, `score`, `accepted` and `entropy` (bits a symbol).

    The language of lowest cross-entropy per symbol over the whole text; score is the calibrated
    chance that it is right, accepted says whether the score reaches the calibrated threshold.
    NULL texts, texts without a letter, and all texts where nothing was learned give `und`, score 0,
    not accepted.  Texts that mix languages get the one that fits the whole best; ties go to the
    first name.  Columns of these names are replaced; all others, and repeated rows, stay.
    """
    names = ["lang_pred", "score", "accepted", "entropy"]
    rest = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tool = Judge(model.models) if model else None
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                texts = b.column(text_col).to_pylist()
                if tool is None:
                    pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                    entropy = np.zeros(len(texts))
                else:
                    sums = tool.sums(texts)
                    best, lead, n = margins(sums)
                    some = n > 0
                    pred = [
                        model.models.names[k] if s else UNKNOWN for k, s in zip(best, some, strict=True)
                    ]
                    score = np.where(some, model.confidence(lead, n), 0.0)
                    entropy = -sums[np.arange(len(best)), best] / np.maximum(n, 1) / np.log(2)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c) for c in rest), pa.array(pred, pa.string()), pa.array(score),
                        pa.array(score >= (model.threshold if model else 2.0)) , pa.array(entropy),
                    ],
                    names=[*rest, *names],
                )

    rows = docs.select(rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(
        mark, f"{schema}, lang_pred string, score double, accepted boolean, entropy double"
    )
