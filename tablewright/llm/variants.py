"""Spelling variants: words one edit apart, and the form each of them is most likely meant to be.

Near words are found by scanning sorted word lists.  The rows of the edit matrix, three cells wide, belong
to prefixes: a word takes over the rows of the prefix it shares with the word before it, and a range of
words is left as soon as their shared prefix is more than one edit away.  All words of a list are looked
for in one scan, prefix length by prefix length.

Lists are made on the cluster.  One edit leaves one half of a word as it is, so words meet with those of
the same beginning and, read backwards, with those of the same end.  A list of more than LIST words is
dealt out by a longer beginning or end, again and again; what cannot be dealt out further shares all but
two places and is bounded by the square of the alphabet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import settled
from tablewright.operators.distributed import lookup_join

RUN = "[a-zÀ-ÿ]{%d,}"
SLIP = 97  # one run in so many loses a code point
LEAST_POINTS = 5
LEAST_COUNT = 3
LIST = 2048  # words of a list before it is dealt out
CELLS = 1 << 22  # pairs of prefix and word a scan may hold
FLUSH = 300_000  # words counted in a task before they are handed on


# ---------------------------------------------------------------- words


def count_words(docs: DataFrame, least_points: int = LEAST_POINTS, slip: int = SLIP) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z in lower case; NULL texts have none.

    A run loses the code point h % length where `slip` divides h, the crc32 of `<doc_id>:<run>` (a NULL
    doc_id is empty); 0 leaves all runs as they are.  Words of fewer than `least_points` are left out.
    """
    pattern = re.compile(RUN % least_points)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], schema=schema
            )
            words.clear()
            return batch

        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for doc_id, text in zip(ids, batch["text"].cast(pa.binary())):
                runs = pattern.findall(text.as_py().lower().decode("utf-8", "replace"))
                if not slip:
                    words.update(runs)
                    continue
                seed = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(runs).items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % slip == 0:
                        cut = h % len(run)
                        run = run[:cut] + run[cut + 1 :]
                        if len(run) < least_points:
                            continue
                    words[run] += n
                if len(words) > FLUSH:
                    yield flush()
        if words:
            yield flush()

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text"
    ).where("text IS NOT NULL")
    parts = rows.mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- scan of one sorted list


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points, one row a word, 0 after its end."""
    text = np.array(words, f"<U{width}")
    return text.view("<u4").reshape(len(words), width)


def scan(words: list[str], queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) numbers of the words exactly one edit from each query, all of one sorted list.

    A state is a prefix, given by its range of words, and a query within one edit of it, with the three
    cells of the edit matrix around the diagonal.
    """
    lens = np.fromiter(map(len, words), np.int32, len(words))
    codes = _codes(words, int(lens.max()) + 3)
    same = codes[1:] == codes[:-1]
    shared = np.zeros(len(words), np.int32)  # with the word before
    shared[1:] = np.where(same.all(1), lens[1:], same.argmin(1))
    n = len(queries)
    start, end = np.zeros(n, np.int32), np.full(n, len(words), np.int32)
    query = queries.astype(np.int32)
    b0, b1, b2 = np.full(n, 2, np.int8), np.zeros(n, np.int8), np.ones(n, np.int8)
    found_q, found_w = [], []
    depth = 0
    while len(query):
        done = np.flatnonzero(lens[start] == depth)  # only the first of a range can end here
        if len(done):
            place = lens[query[done]] - depth
            cell = np.select([place == -1, place == 0, place == 1], [b0[done], b1[done], b2[done]], 2)
            hit = done[cell == 1]
            found_q.append(query[hit])
            found_w.append(start[hit])
        cuts = np.append(np.flatnonzero(shared <= depth), len(words)).astype(np.int32)
        first, last = np.searchsorted(cuts, start), np.searchsorted(cuts, end)
        many = last - first
        at = np.repeat(np.arange(len(query), dtype=np.int32), many)
        child = np.arange(len(at), dtype=np.int64) - np.repeat(np.cumsum(many) - many, many)
        child += np.repeat(first, many)
        start, end = cuts[child], cuts[child + 1]
        on = lens[start] > depth
        at, start, end = at[on], start[on], end[on]
        query = query[at]
        c = codes[start, depth]
        mine = codes[query, max(depth - 1, 0)] != c if depth else np.ones(len(query), bool)
        n0 = np.minimum(b0[at] + mine, b1[at] + 1)
        n1 = np.minimum(np.minimum(b1[at] + (codes[query, depth] != c), b2[at] + 1), n0 + 1)
        n2 = np.minimum(b2[at] + (codes[query, depth + 1] != c), n1 + 1)
        near = np.minimum(np.minimum(n0, n1), n2) <= 1
        start, end, query = start[near], end[near], query[near]
        b0, b1, b2 = (x[near].astype(np.int8) for x in (n0, n1, n2))
        depth += 1
        # beyond a query's end only an insertion fits
        alive = depth <= lens[query] + 1
        if not alive.all():
            start, end, query = start[alive], end[alive], query[alive]
            b0, b1, b2 = b0[alive], b1[alive], b2[alive]
    if not found_q:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(found_q), np.concatenate(found_w)


def _list_nears(points: int, head: int, tail: int, words: list[str], counts: list[int]) -> list[tuple]:
    """(word, near words, largest count among them, smallest word that has it) of one list.

    A pair belongs to the list of its shorter word's length `points`, and among the lists it meets in to
    the one its first difference points to, so every pair is counted once.
    """
    turned = tail > head
    text = [w[::-1] for w in words] if turned else words
    order = sorted(range(len(text)), key=text.__getitem__)
    text = [text[i] for i in order]
    words, counts = [words[i] for i in order], np.array([counts[i] for i in order])
    step = max(1, CELLS // len(words))
    pairs = [
        scan(text, np.arange(i, min(i + step, len(words)))) for i in range(0, len(words), step)
    ]
    q, w = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    lens = np.fromiter(map(len, words), np.int32, len(words))
    mine = np.minimum(lens[q], lens[w]) == points
    q, w = q[mine], w[mine]
    if tail and len(q):
        codes = _codes(words, points + 2)
        first = (codes[q] != codes[w]).argmax(1)
        mine = first < points - tail
        q, w = q[mine], w[mine]
    if not len(q):
        return []
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    by = np.lexsort((rank[w], -counts[w], q))
    q, w = q[by], w[by]
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    sizes = np.diff(np.append(starts, len(q)))
    return [
        (words[q[s]], int(k), int(counts[w[s]]), words[w[s]]) for s, k in zip(starts, sizes)
    ]


_NEARS = "word string, n_near long, best_n long, best string"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words sorted by list to what each list says about them."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()),
                        ("best", pa.string())])
    out: list[tuple] = []
    now, words, counts = None, [], []

    def close() -> None:
        if len(words) > 1:
            out.extend(_list_nears(*now[:3], words, counts))
        words.clear()
        counts.clear()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
        )
        out.clear()
        return batch

    for batch in batches:
        names = ("points", "head", "tail", "part", "word", "n")
        for *key, word, n in zip(*[batch[c].to_pylist() for c in names]):
            if key != now:
                close()
                now = key
                if len(out) > 10_000:
                    yield flush()
            words.append(word)
            counts.append(n)
    close()
    if out:
        yield flush()


# ---------------------------------------------------------------- lists on the cluster


_LIST = ["points", "head", "tail", "part"]


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of (points, head, tail, word, n) on two lists each: one of a longer beginning, one of a longer end."""
    half = ((F.col("points") - F.col("head") - F.col("tail")) / 2).cast("int")
    rest = F.col("points") - F.col("head") - F.col("tail") - half
    longer = F.array(
        F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
        F.struct(F.col("head").alias("head"), (F.col("tail") + rest).alias("tail")),
    )
    rows = rows.select("points", F.explode(longer).alias("t"), "word", "n")
    head, tail = F.col("t.head"), F.col("t.tail")
    part = F.concat(
        F.substr("word", F.lit(1), head), F.lit(" "),
        F.when(tail > 0, F.substr("word", F.char_length("word") - tail + 1)).otherwise(""),
    )
    return rows.select("points", head.alias("head"), tail.alias("tail"), part.alias("part"), "word", "n")


def near_words(vocabulary: DataFrame, most: int = LIST) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have others one edit away.

    Words are distinct and not empty, and hold no blank.  `best` is the near word of largest n, the
    smallest in code-point order among equals.
    """
    points = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1))
    rows = vocabulary.select(
        points.alias("points"), F.lit(0).alias("head"), F.lit(0).alias("tail"), "word", "n"
    )
    rows = _dealt(rows.where("points > 0"))
    while True:
        sizes = rows.groupBy(*_LIST).agg(F.count(F.lit(1)).alias("size"))
        large = sizes.where((F.col("size") > most) & F.expr("points - head - tail > 1"))
        large = settled(large, "large-lists")
        if large.isEmpty():
            break
        marked = lookup_join(rows, _LIST, large, "size")
        rows = settled(marked.where("NOT _hit").drop("_hit").unionByName(
            _dealt(marked.where("_hit").drop("_hit"))
        ), "lists")
    rows = rows.repartition(*_LIST).sortWithinPartitions(*_LIST)
    found = rows.select(*_LIST, "word", "n").mapInArrow(_lists, _NEARS)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form; what a word points to is skipped over until it has no form.

    Counts at least double on the way, so a way has at most 63 steps and takes at most 6 rounds.
    """
    ways = settled(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = ways.join(onward, "root", "left")
        longer = settled(
            longer.select("word", F.coalesce("next", "root").alias("root"),
                          F.col("next").isNotNull().alias("moved")), "forms")
        if longer.where("moved").isEmpty():
            return longer.select("word", "root")
        ways = longer.select("word", "root")


def spelling_variants(words: DataFrame, least_count: int = LEAST_COUNT, most: int = LIST) -> DataFrame:
    """Each word of (word, n) with its form: the near word of largest n, if that is at least twice as frequent.

    Returns word, form, root (the last form of the chain, the word itself if it has none), n, n_near,
    form_n.  Words below `least_count` are left out; an empty table gives no rows.
    """
    vocabulary = settled(words.where(F.col("n") >= least_count).select("word", "n"), "vocabulary")
    nears = near_words(vocabulary, most)
    joined = vocabulary.join(nears, "word", "left")
    clear = F.col("best_n") >= 2 * F.col("n")
    out = settled(
        joined.select(
            "word",
            F.when(clear, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(clear, F.col("best_n")).alias("form_n"),
        ),
        "variants",
    )
    out = out.join(_roots(out.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
