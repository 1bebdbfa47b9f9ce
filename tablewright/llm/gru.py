"""A gated recurrent language model over words, trained in numpy on the cluster.

The network reads words of a bounded vocabulary; its output softmax is factored into classes of words, the
last class holding all words beyond the vocabulary.  Inside that class a word has the probability its
count gives, so the model covers every word of the corpus.

All counts cover all training documents, and the network learns from every one of them, once.  Documents
are dealt to lanes of about LANE tokens; each lane runs truncated backpropagation through time over its own
documents, and the weights of the lanes are averaged after each round.  In training and scoring alike the
state is carried from window to window until the document ends, so a document is scored whole.

Words are kept up to LONG bytes, longer ones as a digest.  The most frequent words, up to TABLE, go to all tasks
(at most 10 MB); the others meet their counts in a join, where none of them can be hot.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.common import settled

VOCABULARY = 8191  # words the network tells apart, beside the end
CLASSES = 40
HIDDEN = 32
TABLE = 131_072
LONG = 64
LANE = 2_000_000  # tokens a lane learns from, in all rounds
ROUNDS = 2
STREAMS = 128  # documents a lane reads side by side
STEPS = 16  # words of a window of truncated backpropagation
LEARN_TOKENS = 1 << 20  # tokens a lane packs into streams at a time
RATE = 0.1
SQUARES = 1e-6  # what the squared gradients of a weight start from
SCORE_STREAMS = 512
SCORE_WINDOW = 1 << 14  # tokens of a window while scoring
SCORE_TOKENS = 1 << 21  # tokens scored at a time
SCORE_ROWS = 40_000
BLOCK = 1024  # rows of weights updated at a time
CHUNK = 1 << 16  # weights per row while lanes are averaged
FLUSH = 300_000
SMOOTH = 0.5


def word_key(word: bytes) -> bytes:
    """A word, or a digest that no word equals where it is long."""
    return word if len(word) <= LONG else b" " + hashlib.md5(word).hexdigest().encode()


# ---------------------------------------------------------------- counts


def count_words(docs: DataFrame, learn: Column) -> DataFrame:
    """(word, c, n): occurrences in learned and in all documents, of every word of whole texts."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            learned, other = both
            words = list(learned.keys() | other.keys())
            c = np.fromiter(map(learned.get, words, repeat(0)), np.int64, len(words))
            n = c + np.fromiter(map(other.get, words, repeat(0)), np.int64, len(words))
            learned.clear()
            other.clear()
            words = pa.array([w if len(w) <= LONG else word_key(w) for w in words], pa.binary())
            return pa.RecordBatch.from_arrays([words, pa.array(c), pa.array(n)], schema=schema)

        for batch in batches:
            for learned, text in zip(batch["learn"].to_pylist(), batch["text"].cast(pa.binary())):
                both[not learned].update(text.as_py().lower().split())
                if len(both[0]) + len(both[1]) > FLUSH:
                    yield flush()
        if both[0] or both[1]:
            yield flush()

    rows = docs.where("text IS NOT NULL").select("text", learn.alias("learn"))
    parts = rows.mapInArrow(counted, "word binary, c long, n long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Counts, the frequent words, and the classes of the network's vocabulary.

    Word numbers: 0 is the end, then the vocabulary in order of frequency, then the other frequent words;
    beyond the vocabulary the network sees one word only.
    """

    words: DataFrame  # (word, c, n), all words
    total: int  # tokens of learned documents, ends included
    distinct: int
    frequent: list[bytes]
    counts: np.ndarray  # of the end and the frequent words
    size: int  # the end and the vocabulary
    least: int  # words beyond the frequent ones occur at most so often
    classes: np.ndarray  # class of a word number below size, then that of all others
    bounds: np.ndarray  # first word number of each class, and the end

    @property
    def outside(self) -> float:
        """Total weight of the words beyond the vocabulary, one unseen word among them."""
        inside = self.counts[: self.size]
        seen = int((inside > 0).sum())
        return (self.total - int(inside.sum())) + SMOOTH * (self.distinct - seen) + SMOOTH


def lexicon(docs: DataFrame, learn: Column, vocabulary: int = VOCABULARY, table: int = TABLE,
            classes: int = CLASSES) -> Lexicon:
    words = settled(count_words(docs, learn), "lm-words")
    documents = docs.where(learn).count()
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    # the least number of occurrences that no more than `table` words reach: one row per such number
    reach = F.sum("words").over(Window.orderBy(F.desc("n")))
    sizes = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("reach", reach)
    least = sizes.where(F.col("reach") > table).agg(F.max("n")).first()[0] or 0
    top = words.where(F.col("n") > least).collect()
    top.sort(key=lambda r: (-r["c"], r["word"]))
    counts = np.array([documents, *(r["c"] for r in top)], np.int64)
    size = 1 + sum(r["c"] > 0 for r in top[:vocabulary])
    # classes of about equal mass of square roots: frequent words in small ones
    mass = np.cumsum(np.sqrt(counts[:size] + SMOOTH))
    cls = np.minimum(((mass - mass[0] / 2) / mass[-1] * classes).astype(np.int64), classes - 1)
    _, cls = np.unique(cls, return_inverse=True)
    bounds = np.append(np.flatnonzero(np.append(True, cls[1:] != cls[:-1])), size)
    return Lexicon(
        words, int(seen[0]) + documents, int(seen[1]) + (documents > 0),
        [bytes(r["word"]) for r in top], counts, size, least,
        np.append(cls, cls[-1] + 1).astype(np.int64), bounds.astype(np.int64),
    )


# ---------------------------------------------------------------- the network


def initial(lex: Lexicon, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights that give every word its share of the counts, whatever came before."""
    rng = np.random.default_rng(seed)
    counts = lex.counts[: lex.size] + SMOOTH
    by_class = np.append(np.add.reduceat(counts, lex.bounds[:-1]), lex.outside)
    in_class = counts / by_class[lex.classes[: lex.size]]

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "embed": draw(lex.size + 1, hidden, scale=0.3),
        "inputs": draw(hidden, 3 * hidden, scale=hidden**-0.5),
        "bias": np.zeros(3 * hidden, np.float32),
        "state": draw(hidden, 3 * hidden, scale=hidden**-0.5),
        "class": np.zeros((hidden, len(by_class)), np.float32),
        "class_bias": np.log(by_class / by_class.sum()).astype(np.float32),
        "word": np.zeros((lex.size, hidden), np.float32),
        "word_bias": np.log(in_class).astype(np.float32),
    }


def small_numbers(a: np.ndarray) -> np.ndarray:
    """The same numbers in 16 bits where they fit, which sort faster."""
    return a.astype(np.uint16) if a.max(initial=0) < 1 << 16 else a


def turned(w: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of inputs, of the state, and bias for columns of streams; those of the gates with the other sign."""
    sign = np.where(np.arange(3 * k) < 2 * k, -1, 1).astype(w["state"].dtype)
    inputs, state = (np.ascontiguousarray((w[name] * sign).T) for name in ("inputs", "state"))
    return inputs, state, (w["bias"] * sign)[:, None]


def starts_of(first: np.ndarray) -> dict[int, np.ndarray]:
    """The streams in which a document starts, by step."""
    return {int(t): np.flatnonzero(first[t]) for t in np.flatnonzero(first.any(1))}


def step(x: np.ndarray, h: np.ndarray, state: np.ndarray, g: np.ndarray, gates: np.ndarray,
         new: np.ndarray, out: np.ndarray) -> None:
    """One step of the gated unit from its weighted inputs, both `turned`; units in rows, streams in columns.

    Writes the weighted state, the gates, the candidate and the new state.
    """
    k = len(h)
    np.matmul(state, h, out=g)
    np.add(x[: 2 * k], g[: 2 * k], out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[k:], g[2 * k :], out=new)
    new += x[2 * k :]
    np.tanh(new, out=new)
    np.subtract(h, new, out=out)
    out *= gates[:k]
    out += new


def summed(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of rows of each id, and these ids."""
    order = np.argsort(small_numbers(ids), kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return np.add.reduceat(rows[order], starts), ids[starts]


class ByClass:
    """Places in the order of the class of their goal, and one flat array of the softmaxes inside classes.

    `parts` holds for each class that occurs its words a to b, its places lo to hi in that order, and the
    slice of the flat array, a row of b - a numbers per place.  `starts` and `goals` are the flat places of
    each row and of its goal.  Places of the last class, of all other words, come last and have no row.
    """

    def __init__(self, classes: np.ndarray, bounds: np.ndarray, goal: np.ndarray) -> None:
        cls = classes[goal]
        self.order = np.argsort(cls, kind="stable")
        self.classes = cls[self.order]
        cuts = np.searchsorted(self.classes, np.arange(len(bounds)))
        widths = np.diff(bounds)
        ends = np.cumsum(np.repeat(widths, np.diff(cuts)))
        own = self.classes[: len(ends)]
        self.starts = ends - widths[own]
        self.goals = self.starts + goal[self.order[: len(ends)]] - bounds[own]
        self.parts, at = [], 0
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            lo, hi = int(cuts[c]), int(cuts[c + 1])
            size = (hi - lo) * int(widths[c])
            self.parts.append((int(bounds[c]), int(bounds[c + 1]), lo, hi, slice(at, at + size)))
            at += size
        self.size = at

    def exponentials(self, h: np.ndarray, word: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The flat array from sorted states, and the exponent of each row's goal; rows that could overflow or vanish
        are moved by their largest."""
        flat = np.empty(self.size, h.dtype)
        for a, b, lo, hi, place in self.parts:
            rows = flat[place].reshape(hi - lo, b - a)
            np.matmul(h[lo:hi], word[a:b].T, out=rows)
            rows += bias[a:b]
        if flat.max() > 60 or flat.min() < -60:
            top = np.maximum.reduceat(flat, self.starts)
            flat -= np.repeat(top, np.diff(np.append(self.starts, self.size)))
        got = flat[self.goals]
        np.exp(flat, out=flat)
        return flat, got


def packed_streams(lens: list[int], streams: int) -> list[list[int]]:
    """Numbers of documents per stream, so that streams are about equally long; longest stream first."""
    heap = [(0, s) for s in range(min(streams, len(lens)))]
    out: list[list[int]] = [[] for _ in heap]
    total = [0] * len(heap)
    for i in sorted(range(len(lens)), key=lens.__getitem__, reverse=True):
        n, s = heapq.heappop(heap)
        out[s].append(i)
        total[s] = n + lens[i]
        heapq.heappush(heap, (total[s], s))
    # in a stream as they came, not the long ones first
    return [sorted(out[s]) for s in sorted(range(len(out)), key=total.__getitem__, reverse=True)]


class Packed:
    """Documents (word numbers, 0 at the end) side by side in streams, laid out step by step.

    Step t holds the streams that reach it, offsets[t] to offsets[t + 1]; streams are sorted by length,
    so those of a step are the first of the step before.  `inputs` is the word before (0 at the start of a
    document, where `first` is set), `goals` the word, `owner` the document.
    """

    def __init__(self, texts: list[np.ndarray], streams: int) -> None:
        order = packed_streams([len(t) for t in texts], streams)
        lens = np.array([sum(len(texts[i]) for i in s) for s in order], np.int64)
        docs = [i for s in order for i in s]
        sizes = np.array([len(texts[i]) for i in docs], np.int64)
        goals = np.concatenate([texts[i] for i in docs]) if docs else np.zeros(0, np.int32)
        first = np.zeros(len(goals), bool)
        first[np.cumsum(sizes) - sizes] = True
        inputs = np.append(goals[-1:], goals[:-1])
        inputs[first] = 0
        self.steps = int(lens[0]) if len(lens) else 0
        active = np.searchsorted(-lens, -np.arange(self.steps), side="left")
        self.offsets = np.append(0, np.cumsum(active))
        step_of = np.arange(len(goals)) - np.repeat(np.cumsum(lens) - lens, lens)
        place = self.offsets[step_of] + np.repeat(np.arange(len(lens)), lens)
        self.goals, self.inputs = np.empty_like(goals), np.empty_like(goals)
        self.first, self.owner = np.empty(len(goals), bool), np.empty(len(goals), np.int32)
        self.goals[place], self.inputs[place], self.first[place] = goals, inputs, first
        self.owner[place] = np.repeat(np.array(docs, np.int32), sizes)

    def block(self, begin: int, steps: int) -> tuple[np.ndarray, ...]:
        """inputs, goals and first of some steps as (step, stream of the first step), and which places hold a
        word (None: all); the others are 0."""
        offsets = self.offsets[begin : begin + steps + 1]
        at, stop, n = offsets[0], offsets[-1], offsets[1] - offsets[0]
        parts = [a[at:stop] for a in (self.inputs, self.goals, self.first)]
        if stop - at == steps * n:
            return *(a.reshape(steps, n) for a in parts), None
        there = np.arange(n) < np.diff(offsets)[:, None]
        out = [np.zeros(there.shape, a.dtype) for a in parts]
        for block, a in zip(out, parts):
            block[there] = a
        return *out, there

    def windows(self, tokens: int, least: int = 1) -> Iterator[tuple[int, int]]:
        """(first step, steps) of windows of about so many tokens, `least` steps at least."""
        begin = 0
        while begin < self.steps:
            active = int(self.offsets[begin + 1] - self.offsets[begin])
            steps = min(max(least, tokens // active), self.steps - begin)
            yield begin, steps
            begin += steps


class Learner:
    """Truncated backpropagation through time with step sizes that shrink per weight (AdaGrad)."""

    def __init__(self, weights: dict[str, np.ndarray], squares: dict[str, np.ndarray],
                 classes: np.ndarray, bounds: np.ndarray, rate: float = RATE) -> None:
        self.w = {k: v.copy() for k, v in weights.items()}
        self.s = {k: v.copy() for k, v in squares.items()}
        self.classes, self.bounds, self.rate = small_numbers(classes), bounds, rate

    def _update(self, name: str, gradient: np.ndarray, at: np.ndarray | None = None) -> None:
        w, s = self.w[name], self.s[name]
        if at is not None:
            move = gradient * gradient
            move += s[at]
            s[at] = move
            np.sqrt(move, out=move)
            w[at] -= np.divide(gradient, move, out=move) * self.rate
            return
        for i in range(0, len(w), BLOCK):  # blocks that stay in the cache
            part, squares = gradient[i : i + BLOCK], s[i : i + BLOCK]
            move = part * part
            squares += move
            np.sqrt(squares, out=move)
            np.divide(part, move, out=move)
            move *= self.rate
            w[i : i + BLOCK] -= move

    def window(self, pack: Packed, begin: int, steps: int, h: np.ndarray) -> np.ndarray:
        """Learn from some steps of packed documents; returns the state that the next window goes on from.

        Arrays over steps are (step, unit, stream), so that every operation runs over whole blocks.
        """
        w, k = self.w, h.shape[1]
        ids, goal, first, there = pack.block(begin, steps)
        n = ids.shape[1]
        resets = starts_of(first)
        emb = w["embed"][ids]
        inputs, state, bias = turned(w, k)
        x = np.matmul(inputs, emb.transpose(0, 2, 1))
        x += bias
        hs = np.empty((steps + 1, k, n), np.float32)
        hs[0] = h[:n].T
        g, gates = np.empty_like(x), np.empty((steps, 2 * k, n), np.float32)
        new = np.empty((steps, k, n), np.float32)
        with np.errstate(over="ignore"):  # a gate that is shut: one over infinity
            for t in range(steps):
                before = hs[t]
                if t in resets:
                    before = before.copy()
                    before[:, resets[t]] = 0
                step(x[t], before, state, g[t], gates[t], new[t], hs[t + 1])
        rows = np.ascontiguousarray(hs.transpose(0, 2, 1))
        befores = hs[:-1]
        dh = np.zeros((steps, n, k), np.float32)
        if there is None:
            dh = self._outputs(rows[1:].reshape(-1, k), goal.ravel(), 1 / (STREAMS * STEPS)).reshape(dh.shape)
        else:
            dh[there] = self._outputs(rows[1:][there], goal[there], 1 / (STREAMS * STEPS))
        dh = np.ascontiguousarray(dh.transpose(0, 2, 1))
        last = rows[-1]
        rows = rows[:-1]
        rows[first] = 0
        for t, at in resets.items():
            befores[t][:, at] = 0

        # what the gradient of a state is multiplied by on its way to both gates and to the weighted state
        z, r = gates[:, :k], gates[:, k:]
        shut = 1 - z
        d_state = x
        factor = d_state.reshape(steps, 3, k, n)
        np.subtract(befores, new, out=factor[:, 0])
        factor[:, 0] *= z
        factor[:, 0] *= shut
        np.multiply(new, new, out=new)
        np.subtract(1, new, out=new)
        new *= shut
        np.multiply(new, r, out=factor[:, 2])
        np.subtract(1, r, out=shut)
        shut *= g[:, 2 * k :]
        np.multiply(factor[:, 2], shut, out=factor[:, 1])
        back, kept = np.zeros((k, n), np.float32), np.empty((k, n), np.float32)
        for t in range(steps - 1, -1, -1):
            d = dh[t]
            d += back
            factor[t] *= d
            np.matmul(w["state"], d_state[t], out=back)
            np.multiply(d, z[t], out=kept)
            back += kept
            if t in resets:
                back[:, resets[t]] = 0
        self._update("state", np.matmul(d_state, rows).sum(0).T)
        d_in = d_state
        np.multiply(dh, new, out=d_in[:, 2 * k :])
        d_emb = np.matmul(d_in.transpose(0, 2, 1), w["inputs"].T).reshape(-1, k)
        self._update("inputs", np.matmul(d_in, emb).sum(0).T)
        self._update("bias", d_in.sum(2).sum(0))
        self._update("embed", *summed(d_emb, ids.ravel()))
        return last

    def _outputs(self, h: np.ndarray, goal: np.ndarray, scale: float) -> np.ndarray:
        """Learn the softmaxes; the gradient of each state."""
        w = self.w
        sort = ByClass(self.classes, self.bounds, goal)
        h = h[sort.order]
        p = w["class"].T @ h.T
        p += w["class_bias"][:, None]
        p -= p.max(0)
        np.exp(p, out=p)
        p *= scale / p.sum(0)
        p[sort.classes, np.arange(len(goal))] -= scale
        dh = p.T @ w["class"].T
        self._update("class", (p @ h).T)
        self._update("class_bias", p.sum(1))
        made = np.empty_like if len(sort.parts) == len(self.bounds) - 1 else np.zeros_like
        d_word, d_bias = made(w["word"]), made(w["word_bias"])
        if len(sort.starts):
            flat, _ = sort.exponentials(h, w["word"], w["word_bias"])
            total = np.add.reduceat(flat, sort.starts)
            flat[sort.goals] -= total
            shares = scale / total
            weighted = h[: len(shares)] * shares[:, None]
            back = np.empty_like(weighted)
            for a, b, lo, hi, place in sort.parts:
                p = flat[place].reshape(hi - lo, b - a)
                np.matmul(p, w["word"][a:b], out=back[lo:hi])
                np.matmul(p.T, weighted[lo:hi], out=d_word[a:b])
                np.matmul(shares[lo:hi], p, out=d_bias[a:b])
            back *= shares[:, None]
            dh[: len(back)] += back
        self._update("word", d_word)
        self._update("word_bias", d_bias)
        out = np.empty_like(dh)
        out[sort.order] = dh
        return out


# ---------------------------------------------------------------- learning on the cluster


def learn(learner: Learner, texts: list[np.ndarray]) -> int:
    """Learn from whole documents; the number of their tokens."""
    pack = Packed(texts, STREAMS)
    h = np.zeros((STREAMS, learner.w["state"].shape[0]), np.float32)
    for begin, steps in pack.windows(STREAMS * STEPS, STEPS):  # longer where few streams are left
        h = learner.window(pack, begin, steps, h)
    return len(pack.goals)


_MEANS = "chunk int, part int, tokens long, mean binary"


def _lane(weights: dict, squares: dict, frequent: list[bytes], classes: np.ndarray, bounds: np.ndarray,
          size: int, parts: int):
    """Documents of lanes, in order of lane, to chunks of the weights each lane ends with."""

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = dict(zip(frequent, range(1, len(frequent) + 1)))
        now, learner, texts, held, tokens = None, None, [], 0, 0

        def finish() -> Iterator[pa.RecordBatch]:
            n = tokens + learn(learner, texts)
            flat = np.concatenate(
                [part[k].ravel() for part in (learner.w, learner.s) for k in sorted(learner.w)]
            )
            for i in range(0, len(flat), CHUNK):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // CHUNK], pa.int32()), pa.array([now % parts], pa.int32()),
                     pa.array([n], pa.int64()), pa.array([flat[i : i + CHUNK].tobytes()], pa.binary())],
                    names=["chunk", "part", "tokens", "mean"],
                )

        for batch in batches:
            for lane, text in zip(batch["lane"].to_pylist(), batch["text"].cast(pa.binary())):
                if lane != now:
                    if now is not None:
                        yield from finish()
                    now, texts, held, tokens = lane, [], 0, 0
                    learner = Learner(weights, squares, classes, bounds)
                words = (text.as_py() or b"").lower().split()
                ids = np.fromiter(map(number.get, words, repeat(size)), np.int32, len(words))
                texts.append(np.append(ids, np.int32(0)))
                held += len(ids) + 1
                if held >= LEARN_TOKENS:
                    tokens += learn(learner, texts)
                    texts, held = [], 0
        if now is not None:
            yield from finish()

    return learned


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk and part to one row for each, the mean weighted by tokens."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([tokens]),
             pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())],
            names=["chunk", "part", "tokens", "mean"],
        )

    now, total, tokens = None, None, 0
    for batch in batches:
        for row in batch.to_pylist():
            if (row["chunk"], row["part"]) != now:
                if now is not None:
                    yield out()
                now, total, tokens = (row["chunk"], row["part"]), 0.0, 0
            total = total + np.frombuffer(row["mean"], np.float32).astype(np.float64) * row["tokens"]
            tokens += row["tokens"]
    if now is not None:
        yield out()


def _mean(rows: DataFrame) -> DataFrame:
    """One row per chunk, by way of the parts, so that no task reads the weights of all lanes."""
    rows = rows.repartition("chunk", "part").sortWithinPartitions("chunk", "part")
    rows = rows.mapInArrow(_averaged, _MEANS).withColumn("part", F.lit(0))
    return rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_averaged, _MEANS)


@dataclass
class Model:
    lex: Lexicon
    weights: dict[str, np.ndarray]


def train(docs: DataFrame, learn: Column, share: int = 1, rounds: int = ROUNDS,
          lane: int = LANE, **sizes: int) -> Model:
    """A model of the documents that `learn` marks; the rows need doc_id and text.

    Copies of a document are all counted.  A `share` above 1 has the network learn from one document in so
    many only; nothing in the library asks for that.  With nothing to learn from, every word is as unknown as any.
    """
    lex = lexicon(docs, F.coalesce(learn, F.lit(False)), **sizes)
    weights = initial(lex)
    squares = {k: np.full_like(v, SQUARES) for k, v in weights.items()}
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    drawn = docs.where(learn).where("text IS NOT NULL").select("text", draw.alias("draw"))
    drawn = drawn.where(F.pmod("draw", F.lit(share)) == 0)
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    lanes = 1 + int(drawn.agg(size).first()[0]) // (6 * lane)  # six bytes a token
    drawn = drawn.select(
        "text",
        F.pmod(F.xxhash64("draw", F.lit("round")), F.lit(rounds)).alias("round"),
        F.pmod(F.xxhash64("draw", F.lit("lane")), F.lit(lanes)).cast("int").alias("lane"),
        "draw",
    )
    drawn = settled(drawn, "lm-drawn")
    plain = (lex.frequent[: lex.size - 1], lex.classes, lex.bounds, lex.size)
    for r in range(rounds):
        part = drawn.where(F.col("round") == r).select("lane", "draw", "text")
        part = part.repartition(lanes, "lane").sortWithinPartitions("lane", "draw", "text")
        task = _lane(weights, squares, *plain, parts=math.isqrt(lanes) + 1)
        found = settled(part.mapInArrow(task, _MEANS), "lm-lanes")
        means = _mean(found).select("chunk", "mean").collect()  # as many numbers as weights
        if not means:
            continue
        flat = np.concatenate([np.frombuffer(m["mean"], np.float32) for m in sorted(means)])
        at = 0
        for part in (weights, squares):
            for k in sorted(weights):
                n = part[k].size
                part[k] = flat[at : at + n].reshape(part[k].shape).astype(np.float32)
                at += n
    return Model(lex, weights)


# ---------------------------------------------------------------- scoring


def log_likelihood(weights: dict, table: np.ndarray, classes: np.ndarray, bounds: np.ndarray,
                   texts: list[np.ndarray]) -> np.ndarray:
    """Natural-log probability of each text's words and end, as numbers below size, or size for others.

    `table` holds the weighted inputs of every number.  Others have the probability of their class.
    """
    k = weights["state"].shape[0]
    pack = Packed(texts, SCORE_STREAMS)
    classes = small_numbers(classes)
    _, state, _ = turned(weights, k)
    table = table.copy()
    table[:, : 2 * k] *= -1
    result = np.zeros(len(texts))
    h = np.zeros((k, SCORE_STREAMS), np.float32)
    for begin, steps in pack.windows(SCORE_WINDOW, 8):
        ids, goal, first, there = pack.block(begin, steps)
        n = ids.shape[1]
        resets = starts_of(first)
        hs = np.empty((steps, n, k), np.float32)
        h = h[:, :n].copy()
        x, g = np.empty((3 * k, n), np.float32), np.empty((3 * k, n), np.float32)
        gates, new = np.empty((2 * k, n), np.float32), np.empty((k, n), np.float32)
        with np.errstate(over="ignore"):  # a gate that is shut: one over infinity
            for t in range(steps):
                if t in resets:
                    h[:, resets[t]] = 0
                x[:] = table[ids[t]].T
                step(x, h, state, g, gates, new, h)
                hs[t] = h.T
        hs, goal = hs.reshape(-1, k), goal.ravel()
        if there is not None:
            hs, goal = hs[there.ravel()], goal[there.ravel()]
        sort = ByClass(classes, bounds, goal)
        hs = hs[sort.order]
        logits = weights["class"].T @ hs.T
        logits += weights["class_bias"][:, None]
        logits -= logits.max(0)
        got = logits[sort.classes, np.arange(len(goal))].astype(np.float64)
        got -= np.log(np.exp(logits, out=logits).sum(0))
        if len(sort.starts):
            flat, inner = sort.exponentials(hs, weights["word"], weights["word_bias"])
            got[: len(inner)] += inner - np.log(np.add.reduceat(flat, sort.starts))
        owner = pack.owner[pack.offsets[begin] : pack.offsets[begin + steps]]
        result += np.bincount(owner[sort.order], got, len(texts))
    return result


_PART = (
    "row string, doc_id {kind}, n_tokens long, known long, base double, score double, "
    "n_rare long, words array<binary>, counts array<int>"
)


def _scorer(model: Model, kind: str):
    lex, weights = model.lex, model.weights
    frequent, counts, size = lex.frequent, lex.counts, lex.size
    classes, bounds, outside = lex.classes, lex.bounds, lex.outside
    folder = uuid.uuid4().hex

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = dict(zip(frequent, range(1, len(frequent) + 1)))
        table = weights["embed"] @ weights["inputs"] + weights["bias"]
        smooth = np.log10(counts + SMOOTH)
        known = counts > 0
        others = smooth.copy()
        others[:size] = 0
        others[size:] -= np.log10(outside)
        part, made = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        texts: list[np.ndarray] = []
        held = 0

        def flush(schema: pa.Schema) -> pa.RecordBatch:
            nonlocal rows, texts, held
            logs = log_likelihood(weights, table, classes, bounds, texts) / np.log(10)
            columns = list(zip(*rows))
            columns[5] = (np.array(columns[5]) + logs).tolist()
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )
            rows, texts, held = [], [], 0
            return batch

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema(
                    [("row", pa.string()), ("doc_id", batch.schema.field("doc_id").type),
                     ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()),
                     ("score", pa.float64()), ("n_rare", pa.int64()), ("words", pa.list_(pa.binary())),
                     ("counts", pa.list_(pa.int32()))]
                )
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary())):
                words = (text.as_py() or b"").lower().split()
                ids = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
                missing = np.flatnonzero(ids < 0)
                rare: Counter[bytes] = Counter(word_key(words[i]) for i in missing.tolist())
                if any(w in number for w in rare if w[:1] == b" "):  # a long word may be frequent
                    ids[missing] = [number.get(word_key(words[i]), -1) for i in missing.tolist()]
                    missing = np.flatnonzero(ids < 0)
                    rare = Counter({w: c for w, c in rare.items() if w not in number})
                ids = np.append(ids, np.int32(0))
                there = ids[ids >= 0]
                rows.append((
                    f"{folder}-{part}-{made}", doc_id, len(ids), int(known[there].sum()),
                    float(smooth[there].sum()),
                    float(others[there].sum() - len(missing) * np.log10(outside)),
                    len(missing), list(rare), list(rare.values()),
                ))
                made += 1
                ids[(ids < 0) | (ids >= size)] = size
                texts.append(ids)
                held += len(ids)
                if held >= SCORE_TOKENS or len(rows) >= SCORE_ROWS:
                    yield flush(schema)
        if rows:
            yield flush(schema)

    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, NULL texts as empty.

    base_score is the log10 probability by smoothed counts, score that of the network; both are of all
    words of the whole text and its end.
    """
    lex = model.lex
    kind = dict(docs.dtypes)["doc_id"]
    parts = settled(
        docs.select("doc_id", "text").mapInArrow(_scorer(model, kind), _PART.format(kind=kind)),
        "lm-scores",
    )
    pairs = parts.where("n_rare > 0").select(
        "row", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n")))
    )
    words = lex.words.where((F.col("n") <= lex.least) & (F.col("c") > 0)).select("word", "c")
    pairs = pairs.join(words, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = pairs.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(c + SMOOTH)).alias("logs"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"),
    )
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    norm = float(np.log10(lex.total + SMOOTH * (lex.distinct + 1)))
    return parts.join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + more).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
