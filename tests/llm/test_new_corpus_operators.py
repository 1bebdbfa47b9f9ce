"""Prefix trie, recurrent language model and spelling variants against plain versions."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablewright.llm import gru, trie, variants

QUERIES = entry.queries()


# ---------------------------------------------------------------- prefix trie


def built_from(rows):
    """Rebuilt conversations of (conv_id, turn, role, text) rows."""
    convs = {}
    for c, turn, role, text in rows:
        if c is None:
            continue
        role, text = role or "", text or ""
        key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
        convs.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    convs = {c: [(t[3], t[4]) for t in sorted(turns)] for c, turns in convs.items()}
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    return out


def trie_of(built):
    nodes, kids, leaves, saved = {}, {}, {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) if below else 1
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = own + sum(saved[k] for k in below)
    out = set()
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.add((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])),
            leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
           "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def nodes_of(conversations, **sizes):
    turns = trie.shared_heads(trie.turn_sequences(conversations))
    return [tuple(r) for r in trie.prefix_trie(turns, **sizes).select(*COLUMNS).collect()]


def test_trie_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_prefix_trie"](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == trie_of(built_from(rows))


@pytest.mark.parametrize("sizes", [{}, {"band": 3, "limit": 20}, {"band": 4, "limit": 1}])
def test_trie_edges(spark, sizes):
    """NULLs anywhere, ties, repeated rows, negative ids, turnless and long conversations, copies."""
    draw = random.Random(1)
    rows = [
        (draw.choice([None, -7, -6, -5, -2, *range(40)]), draw.choice([None, *range(9)]),
         draw.choice([None, "u", "a"]), draw.choice([None, "", "x", "yé"]))
        for _ in range(500)
    ]
    rows += [(100 + i, j, "u", f"s{j // (1 + i % 2)}") for i in range(12) for j in range(21)]
    rows += [(200 + i, j, "u", "copy") for i in range(40) for j in range(3)]
    df = spark.createDataFrame(rows, TURNS)
    for name in ("pos", "h", "root", "first", "band"):
        df = df.withColumn(name, F.lit("own"))
    got = nodes_of(df, **sizes)
    assert len(got) == len(set(got)) and set(got) == trie_of(built_from(rows))


def test_trie_of_plain_sequences(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "a", "b"), (2, 0, "u", "a"), (2, 1, "a", "c")]
    df = spark.createDataFrame(rows, TURNS)
    nodes = trie.prefix_trie(trie.turn_sequences(df))
    got = {(r.conv_id, r.depth): (r.role, r.text, r.n_convs, r.n_children)
           for r in trie.turn_texts(nodes, df).collect()}
    assert got == {(1, 0): (None, None, 2, 1), (1, 1): ("u", "a", 2, 2), (1, 2): ("a", "b", 1, 0),
                   (2, 2): ("a", "c", 1, 0)}
    assert nodes_of(df.limit(0)) == []


def test_ternary_tree_is_balanced_and_finds_again():
    tree = trie.Tree()
    order = list(trie.median_order(1000))
    assert sorted(order) == list(range(1000))
    at = {i: tree.insert([i, 7], [1, 2]) for i in order}
    assert all(tree.insert([i, 7], [1, 2]) == v for i, v in at.items())
    deepest, todo = 0, [(tree.equal[0], 1)]
    while todo:
        v, d = todo.pop()
        deepest = max(deepest, d)
        todo += [(s, d + 1) for s in (tree.low[v], tree.high[v]) if s >= 0]
    assert deepest == 10


# ---------------------------------------------------------------- spelling variants


def words_of(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def variants_of(words):
    """The result by deletion of one place from every word."""
    near = {w: set() for w in words}
    gaps = {}
    for w in words:
        for i in range(len(w)):
            gaps.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    for (_, rest), group in gaps.items():
        for w in group:
            near[w] |= group
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w in words:
        near[w].discard(w)
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, words[w], len(near[w]), words[f] if f else None))
    return out


def test_variants_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in QUERIES["op13_spelling_variants"](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == variants_of(words_of(docs))


@pytest.mark.parametrize("most", [2048, 5])
def test_variants_in_lists_dealt_out_again(spark, most):
    draw = random.Random(2)
    words = {"".join(draw.choices("abÿ", k=draw.randint(1, 9))): draw.choice([3, 3, 6, 12, 100])
             for _ in range(900)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {tuple(r) for r in variants.spelling_variants(df, most=most).collect()}
    assert got == variants_of(words)


def test_variants_edges(spark, make_docs):
    long = "×÷Straße " * 3000 + "strase " * 2900
    docs = make_docs([(None, "Worte " * 9), (1, None), (2, ""), (3, long), (3, long), (4, "a1b2")],
                     ("word", "n", "root", "form"))
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    got = {tuple(r) for r in variants.spelling_variants(variants.count_words(docs)).collect()}
    assert got == variants_of(words_of(plain)) and len(got) > 2
    assert variants.spelling_variants(variants.count_words(docs.limit(0))).collect() == []


def test_scan_against_all_pairs():
    draw = random.Random(3)
    words = sorted({"".join(draw.choices("abc", k=draw.randint(1, 6))) for _ in range(300)})

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    q, w = variants.scan(words, np.arange(len(words)))
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)}
    assert len(q) == len(want) and set(zip(q.tolist(), w.tolist())) == want


# ---------------------------------------------------------------- recurrent language model


def base_of(rows):
    """(n_tokens, n_known, train_tokens, base_score) by doc_id of (doc_id, text) rows."""
    def tokens(text):
        return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]

    def held(doc_id):
        return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1

    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        ts = tokens(text)
        logs = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in ts)
        out.append((i, held(i), len(ts), sum(counts[t] > 0 for t in ts), total, round(logs, 6)))
    return sorted(out, key=str)


def base_rows(df):
    return sorted(
        ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
         for r in df.collect()), key=str)


def test_lm_query(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet")
            .select("doc_id", "text").collect()]
    df = QUERIES["op12_recurrent_lm"](spark, folder).cache()
    assert base_rows(df) == base_of(docs)
    assert df.where("score IS NULL OR score > 0 OR isnan(score)").isEmpty()


def test_lm_learns(spark, folder):
    """On a thousand documents; the network has a hundred of them to learn from."""
    larger = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.01")
    if not os.path.exists(larger):
        pytest.skip("needs the table of a thousand documents")
    df = QUERIES["op12_recurrent_lm"](spark, larger)
    sums = df.groupBy().agg(*[F.sum(F.when(F.col("held_out"), F.col(c))) for c in ("base_score", "score")]).first()
    assert sums[1] > sums[0]  # the network knows held-out texts better than the counts do


@pytest.mark.parametrize("table", [6, 131_072])
def test_lm_edges(spark, make_docs, table):
    """NULLs, empty and long texts, long words, repeated rows; few words known to all tasks."""
    long_word = "X" * 5000
    rows = [(None, "no id"), (1, None), (2, ""), (2, ""), (3, "a b a b c " * 900), (4, long_word + " a " + long_word),
            (5, "Ä ä A a\x0bq r"), (6, long_word), (7, "  \t "), (8, "a c " + "new ones " * 5), (9, "b " * 40)]
    rows += [(10 + i, f"a b word{i % 3} c") for i in range(30)]
    docs = make_docs(rows, ("row", "word", "rare"))
    held = gru.F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    model = gru.train(docs, ~held, share=1, vocabulary=4, table=table, classes=2)
    out = gru.score(docs, model)
    got = out.withColumn("held_out", held)
    assert base_rows(got) == base_of([(r[0], r[1]) for r in rows])
    again = {str(r) for r in gru.score(docs.repartition(5), model).select("doc_id", "n_tokens").collect()}
    assert again == {str(r) for r in out.select("doc_id", "n_tokens").collect()}


def test_lm_learns_from_every_document(make_docs):
    """The network's weights of a word move only if a document with it was read."""
    docs = make_docs([(i, f"own{i} same " * 150) for i in range(24)])
    model = gru.train(docs, F.lit(True))
    start = gru.initial(model.lex)["embed"]
    moved = np.abs(model.weights["embed"] - start).max(1) > 0
    own = [1 + i for i, word in enumerate(model.lex.frequent) if word.startswith(b"own")]
    assert len(own) == 24 and moved[own].all()


def test_lm_without_documents(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    model = gru.train(docs, F.lit(False))
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4))
           for r in gru.score(docs, model).collect()}
    assert got[1][:4] == (3, 0, 0, 0.0) and got[2][:4] == (1, 0, 0, 0.0)
    assert gru.score(docs.limit(0), gru.train(docs.limit(0), F.lit(True))).collect() == []


def plain_states(weights, ids):
    """The gated unit, word by word."""
    k = weights["state"].shape[0]
    h, out, before = np.zeros(k), [], 0
    for i in ids:
        x = weights["embed"][before] @ weights["inputs"] + weights["bias"]
        g = h @ weights["state"]
        z, r = (1 / (1 + np.exp(-(x[a : a + k] + g[a : a + k]))) for a in (0, k))
        new = np.tanh(x[2 * k :] + r * g[2 * k :])
        h = (1 - z) * new + z * h
        out.append(h)
        before = i
    return np.array(out)


def small_model(size=12, classes=(0, 1, 4, 8, 12), hidden=5, seed=1):
    rng = np.random.default_rng(seed)
    bounds = np.array(classes)
    of = np.append(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), len(bounds) - 1)
    shapes = {"embed": (size + 1, hidden), "inputs": (hidden, 3 * hidden), "bias": (3 * hidden,),
              "state": (hidden, 3 * hidden), "class": (hidden, len(bounds)), "class_bias": (len(bounds),),
              "word": (size, hidden), "word_bias": (size,)}
    return {k: rng.standard_normal(v) for k, v in shapes.items()}, of, bounds


def plain_score(weights, of, bounds, ids):
    total = 0.0
    for h, i in zip(plain_states(weights, ids), ids):
        logits = h @ weights["class"] + weights["class_bias"]
        total += logits[of[i]] - np.log(np.exp(logits).sum())
        if i < len(weights["word"]):
            a, b = bounds[of[i]], bounds[of[i] + 1]
            inner = weights["word"][a:b] @ h + weights["word_bias"][a:b]
            total += inner[i - a] - np.log(np.exp(inner).sum())
    return total


def test_lm_score_is_that_of_whole_documents(monkeypatch):
    """Many documents side by side, in windows, against one word at a time."""
    monkeypatch.setattr(gru, "SCORE_STREAMS", 4)
    monkeypatch.setattr(gru, "SCORE_WINDOW", 12)
    weights, of, bounds = small_model()
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(1, 13, n), 0) for n in (0, 1, 3, 200, 7, 0, 30, 31, 2)]
    table = weights["embed"] @ weights["inputs"] + weights["bias"]
    got = gru.log_likelihood(weights, table, of, bounds, texts)
    want = [plain_score(weights, of, bounds, t.tolist()) for t in texts]
    assert np.allclose(got, want, rtol=1e-4)


def test_lm_probabilities_sum_to_one():
    weights, of, bounds = small_model()
    before = [3, 12, 7]
    total = sum(
        math.exp(plain_score(weights, of, bounds, [*before, i]) - plain_score(weights, of, bounds, before))
        for i in range(13)
    )
    assert abs(total - 1) < 1e-9


def test_lm_gradients(monkeypatch):
    """Backpropagation against differences of the score."""
    monkeypatch.setattr(gru, "STREAMS", 3)
    weights, of, bounds = small_model(hidden=4)
    texts = [np.array(t) for t in ([5, 12, 3, 0], [2, 2, 9, 1, 7, 0], [0], [11, 0])]
    pack = gru.Packed(texts, 3)
    gradients = {}

    class Probe(gru.Learner):
        def _update(self, name, gradient, at=slice(None)):
            gradients.setdefault(name, np.zeros_like(self.w[name]))[at] += gradient

    monkeypatch.setattr(gru.np, "float32", np.float64)
    probe = Probe(weights, {k: np.ones_like(v) for k, v in weights.items()}, of, bounds)
    probe.window(pack, 0, pack.steps, np.zeros((3, 4)))
    scale = gru.STREAMS * gru.STEPS

    def loss():
        return -sum(plain_score(weights, of, bounds, t.tolist()) for t in texts) / scale

    rng = np.random.default_rng(3)
    for name, value in weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            kept = value[at]
            value[at] = kept + 1e-5
            up = loss()
            value[at] = kept - 1e-5
            down = loss()
            value[at] = kept
            assert abs((up - down) / 2e-5 - gradients[name][at]) < 1e-6, name


def test_lm_long_documents_share_steps(monkeypatch):
    """Long documents of a lane are read side by side, not each in steps of its own."""
    texts = ["a b c " * 4000 if i % 100 == 50 else "a b " * 500 for i in range(400)]
    batch = gru.pa.RecordBatch.from_pydict({"lane": [0] * len(texts), "text": texts})
    steps = []

    def learn(learner, ids):
        steps.append(gru.Packed(ids, gru.STREAMS).steps)
        return sum(map(len, ids))

    monkeypatch.setattr(gru, "learn", learn)
    weights, of, bounds = small_model()
    rows = list(gru._lane(weights, weights, [b"a", b"b"], of, bounds, 12, 1)(iter([batch])))
    assert rows[0]["tokens"].to_pylist() == [sum(len(t.split()) + 1 for t in texts)]
    assert sum(steps) < 13_000  # the longest has 12,001


def test_lm_streams_keep_the_order_of_documents():
    streams = gru.packed_streams([3, 50, 7, 20, 9, 30, 1, 1], 2)
    assert sorted(i for s in streams for i in s) == list(range(8))
    assert all(s == sorted(s) for s in streams)


def test_lm_score_with_large_logits():
    """Exponentials that would overflow or vanish."""
    weights, of, bounds = small_model()
    weights = {k: v * (60 if k in ("word", "word_bias") else 1) for k, v in weights.items()}
    texts = [np.append(np.random.default_rng(4).integers(1, 13, 40), 0)]
    table = weights["embed"] @ weights["inputs"] + weights["bias"]
    got = gru.log_likelihood(weights, table, of, bounds, texts)
    assert np.allclose(got, [plain_score(weights, of, bounds, texts[0].tolist())], rtol=1e-4)


# ---------------------------------------------------------------- mended contracts


def test_every_operator_has_one_query():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1


def test_texts_without_a_letter_have_no_language(spark, make_docs):
    from tablewright.llm import language

    rows = [(i, w, lang, "s") for i in range(40)
            for w, lang in (("the house of the river", "en"), ("das haus am fluss", "de"))]
    docs = make_docs([(2 * i + (r[2] == "de"), *r[1:]) for i, r in enumerate(rows)])
    model = language.train(docs, F.lit(True))
    odd = make_docs([(1, "½ ² ①"), (2, "Ⅷ ³"), (3, None), (4, "12 !"), (5, "the river²house")])
    got = {r.doc_id: r.lang_pred for r in language.identify(odd.select("doc_id", "text"), model).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[5] == "en"
    assert language.words_of("a½b Ⅷ c²") == ["a", "b", "c"]


def test_near_vectors_of_any_length(spark):
    from tablewright.llm import pivots

    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [1e-200, 1.01e-200]),
            (5, [1e200, -1e200]), (6, [5e-324, 0.0]), (7, [1e308, 0.0]), (8, [0.0, 0.0]), (9, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_vectors(df).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 9: (4, 1), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8)}
