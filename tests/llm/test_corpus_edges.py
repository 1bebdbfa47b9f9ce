"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import (
    html,
    language,
    links,
    mixing,
    pieces,
    pii,
    pivots,
    simhash,
    tokenfile,
    topk,
    toxicity,
)
from tablewright.llm.common import settled, shared_folder

WORDS = tokenizer_path("word_bpe_49k.json")
PIECES = tokenizer_path("piece_bpe_32k.model")
LONG = "word and more " * 30_000
ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, LONG), (5, "same text here now"), (5, "same text here now"),
    (6, "same text here now"), (None, "no id"), (None, None), (7, "é́ ﬀ İ ΣΑΣ x²y \x1c\x85 <|endoftext|> don't'LL"),
    (8, "日本語 🙂 ▁ \x00"),
]


@pytest.fixture(scope="module")
def odd(make_docs):
    return make_docs(ODD, extra=("score", "ids", "decoded", "predicted", "size", "mark", "component_id"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain  words", "plain words"),
        ("<p>a<p>b", "a\n\nb"), ("<ul><li>a<li>b<ol><li>c</ol></ul>d", "- a\n- b\n  1. c\n\nd"),
        ("<table><tr><td>aa<td>b<tr><td>c<td>d</table>", "aa  b\nc   d"),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "wide  x\na  b  c"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<style>.x{display:none}</style>a<b class='y x'>b</b><i hidden>c</i><u style='visibility:hidden'>d</u>", "a"),
        ("<pre>\n a\n  b</pre>", " a\n  b"), ("a<br>b<!-- c", "a\nb"), ("a<script>b", "a"),
        ("<details><summary>s</summary>t</details><details open>u</details>", "s\nu"),
        ("x &lt;b&gt; &amp;amp; 3 < 4 </nothing>", "x <b> &amp; 3 < 4"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("a <b>b</b> c", "a b c"), ("<p title='a>b'>t", "t"),
    ],
)
def test_html(page, text):
    assert html.visible_text(page) == text


@pytest.mark.parametrize("part", ["<div>", "<p ", "<a b='", "<", "<ul><li>", "</p>", "<table><tr><td>"])
def test_html_of_hostile_pages_ends(part):
    html.visible_text(part * 3000)


def test_html_table(make_docs, spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "<p>a", "y"), (2, "<p>a", "y")], "id int, html string, text string")
    out = html.extract(df)
    assert sorted((r["id"], r["text"]) for r in out.collect()) == [(1, ""), (2, "a"), (2, "a")]
    assert html.extract(df.filter("false")).count() == 0


# ---------------------------------------------------------------- 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700))
def test_blocks_round_trip(values):
    ids = np.array(values, np.int64)
    data, starts = tokenfile.pack(ids)
    assert (tokenfile.unpack(data, starts, len(ids)) == ids).all()


def test_blocks_use_outliers():
    ids = np.full(128, 5, np.int64)
    ids[7] = 40_000
    data, _ = tokenfile.pack(ids)
    assert len(data) < 20
    payload = tokenfile.segment([1, None], np.array([100, 28]), ids)
    assert tokenfile.parse(payload)[0] == [1, None]
    with pytest.raises(ValueError):
        tokenfile.parse(payload[:-10] + b"x" + payload[-9:])


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_encoder_equals_the_tokenizer(text):
    tool = Tokenizer.from_file(WORDS)
    want = tool.encode(text, add_special_tokens=False).ids + [2]
    assert tokenfile.encoder(WORDS).encode(text, 2).tolist() == want


def test_token_file_of_odd_rows(spark, odd, none):
    tool = Tokenizer.from_file(WORDS)
    path = f"{shared_folder(spark)}/odd-ids"
    tokenfile.write_ids(odd, path, WORDS, 2)
    got = sorted(tokenfile.read_ids(spark, path).collect(), key=lambda r: r["start"])
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    start = 0
    for r, (_, text) in zip(got, order, strict=True):
        assert r["start"] == start
        assert r["ids"] == tool.encode(text or "", add_special_tokens=False).ids + [2]
        start += len(r["ids"])
    path = f"{shared_folder(spark)}/no-ids"
    tokenfile.write_ids(none, path, WORDS, 2)
    assert tokenfile.read_digests(spark, path).count() == 0


# ---------------------------------------------------------------- 3


def kneser_ney(words, order, gram):
    """Interpolated probability of the last character of `gram`, from the definition."""
    marked = {f"<{w}>": n for w, n in words.items()}

    def seen(n):
        """Counts of n-grams that end after the start sign."""
        raw, left = {}, {}
        for w, k in marked.items():
            for e in range(1, len(w)):
                g = w[max(0, e - n + 1) : e + 1]
                if len(g) == n:
                    raw[g] = raw.get(g, 0) + k
                    if e - n >= 0:
                        left.setdefault(g, set()).add(w[e - n])
        if n == order:
            return raw
        return {g: raw[g] if g[0] == "<" else len(left[g]) for g in raw}

    alphabet = {c for w in marked for c in w[1:]}
    p = 1 / (len(alphabet) + 1)
    for n in range(1, order + 1):
        counts, g = seen(n), gram[-n:]
        if len(g) < n:
            break
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        d = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
        after = {k: c for k, c in counts.items() if k[:-1] == g[:-1]}
        if not after:
            continue
        total = sum(after.values())
        back = sum(min(c, d) for c in after.values()) / total if n > 1 else d * len(after) / total
        p = max(counts.get(g, 0) - d, 0) / total + back * p
    return p


def test_kneser_ney_from_its_definition():
    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))): rng.randint(1, 4) for _ in range(30)}
    other = {"ba": 3, "cab": 1, "xy": 2}
    models = language.Models({"one": words, "two": other}, 4)
    tests = ["abca", "xyx", "c", "zz", "bacca"]
    got = models.score(tests)
    for w, row in zip(tests, got, strict=True):
        assert row[-1] == len(w) + 1
    alone = language.Models({"one": words}, 4)
    for w in tests[:1] + tests[2:3]:
        want = sum(np.log(kneser_ney(words, 4, f"<{w}>"[max(0, e - 3) : e + 1])) for e in range(1, len(w) + 2))
        assert alone.score([w])[0, 0] == pytest.approx(want, rel=1e-4)


def test_language_of_odd_rows(make_docs, odd, none):
    docs = make_docs(
        [(i, f"the cat and the dog number went {i}", "en") for i in range(20)]
        + [(i, f"der hund und die katze nummer ging {i}", "de") for i in range(20, 40)]
        + [(40, None, "en"), (41, "x", None)]
    )
    model = language.train(docs, F.lit(True), sample=15, calibration=5)
    got = {(r["doc_id"], r["text"]): r for r in language.identify(odd, model).collect()}
    assert len(language.identify(odd, model).collect()) == len(ODD)
    for key in ((1, None), (2, ""), (3, "   \n\t")):
        assert got[key]["lang_pred"] == "und" and got[key]["score"] == 0 and not got[key]["accepted"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.train(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


# ---------------------------------------------------------------- 4


def gap_kernel(s, t):
    """The normalised kernel from its definition, over all triples of letters within reach."""

    def features(u):
        out = {}
        n = len(u)
        for i in range(n):
            for j in range(i + 1, n):
                for k in range(j + 1, min(n, i + toxicity.REACH)):
                    if u[i].isalpha() and u[j].isalpha() and u[k].isalpha():
                        out[u[i] + u[j] + u[k]] = out.get(u[i] + u[j] + u[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = features(s), features(t)
    norm = np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b.get(k, 0) for k, v in a.items()) / norm if norm else 0.0


def test_string_kernel_from_its_definition():
    units = ["idiot", "i.d.i.o.t", "idiots", "stupid", "aaaa", "ab", "!?"]
    got = toxicity.kernel(units, toxicity.Marks.of(units))
    for i, s in enumerate(units):
        for j, t in enumerate(units):
            assert got[i, j] == pytest.approx(gap_kernel(s, t), abs=1e-5)


def test_toxicity_of_odd_rows(spark, make_docs, odd, none):
    rng = random.Random(2)
    clean = ["house", "garden", "river", "stone", "window", "yellow", "morning", "paper"]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(clean) + rng.choice(["", "s", "ly"]) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["blockhead", "scoundrel"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    labels += [(1, 1, 0), (None, 1, 1), (5, None, None), (9999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(make_docs(docs), table, F.col("doc_id") < 300)
    tests = make_docs(
        [(1, "a house by the river"), (2, "what a blockhead"), (3, "b l o c k h e a d there"),
         (4, "you block.head and sc*oundrel"), (5, "b-l-o-c-k-h-e-a-d"), (6, LONG + " blockheads")]
    )
    got = {r["doc_id"]: r for r in toxicity.score(tests, model).collect()}
    assert [got[i]["predicted"] for i in range(1, 7)] == [0, 1, 1, 1, 1, 1]
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.train(none, table, F.lit(True)) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert toxicity.score(none, model).count() == 0


def test_insults_that_share_a_stem_with_clean_words(spark, make_docs):
    rng = random.Random(8)
    endings = ["ung", "heit", "keit", "bar", "sam", "voll", "los", "ant"]
    insults = ["wackelor", "wackelim", "blockhead", "scoundrel"]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(["haus", "garten", "fluss", "stein", "wackel"]) + rng.choice(endings) for _ in range(20)]
        if i % 4 == 0:
            words[rng.randrange(20)] = insults[i // 4 % 4]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.train(make_docs(docs), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    tests = [(1, "ein wackelor!"), (2, "das wackel.im"), (3, "ein blockhead"), (4, "wackelung und wackelbar"), (5, "garten")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(make_docs(tests), model).collect()}
    assert [got[i] for i in range(1, 6)] == [1, 1, 1, 0, 0]


def test_many_rare_insults(spark, make_docs):
    rng = random.Random(9)
    insults = ["".join(rng.sample("bcdfgklmnprstvwz", 7)) for _ in range(50)]
    parts = ["hou", "gar", "riv", "sto", "win", "yel", "a", "e", "den", "ser", "low", "ne"]
    clean = ["what", "a", *(x + y + z for x in parts[:6] for y in parts[6:8] for z in parts[8:])]
    docs, labels = [], []
    for i in range(6000):
        words = [rng.choice(clean) for _ in range(12)]
        if i % 20 == 0:
            words[rng.randrange(12)] = insults[i // 20 % 50]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 20 == 0)))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(make_docs(docs), table, F.lit(True))
    tests = make_docs([(n, f"what a {u}") for n, u in enumerate([*insults, "houaser", "garaden"])])
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(tests, model).collect()}
    assert sum(got[n] for n in range(50)) >= 25 and got[50] == got[51] == 0


# ---------------------------------------------------------------- 5


def test_mix_of_odd_rows(odd, none):
    out = mixing.mix(odd).collect()
    assert len(out) == len(ODD)
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(odd).collect()))
    again = mixing.mixed(odd)
    assert again.columns == odd.columns
    assert again.count() == sum(r["copies"] for r in out)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mix_comes_near_its_targets(make_docs):
    rng = random.Random(3)
    docs = make_docs(
        [(i, "w " * rng.randint(0, 60), "en", None if i % 7 == 0 else f"s{i % 3 if i % 2 else 0}") for i in range(900)]
    )
    out = mixing.mix(docs).collect()
    total = sum(r["size"] for r in out)
    per = {}
    for r in out:
        x = per.setdefault(r["source"], [0, r["target"], r["source_size"]])
        x[0] += r["taken"]
    assert sum(t for _, t, _ in per.values()) == pytest.approx(1.5 * total)
    for taken, target, size in per.values():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= 30


# ---------------------------------------------------------------- 6


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]),
        (6, [None, 1.0]), (7, [3e30, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0]), (100, [1.0, 2.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=4).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [7, 1, 100, 2]
    assert [r["score"] for r in got if r["query_id"] == 100][1:] == [5 << 20, 5 << 20, 4 << 20]
    assert topk.top_k(df.filter("false"), F.lit(True)).count() == 0
    few = topk.top_k(df.filter("vec_id < 3"), F.col("vec_id") == 1, k=10)
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] == [0, 2]


# ---------------------------------------------------------------- 7


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_pieces_equal_the_model(model, text):
    ids = pieces.transducer(PIECES).encode(text)
    assert ids.tolist() == model.encode(text)
    assert pieces.transducer(PIECES).decode(ids) == text.replace("▁", " ")


def test_pieces_of_odd_rows(odd, none, model):
    out = pieces.encode_pieces(odd, PIECES).collect()
    assert len(out) == len(ODD)
    for r in out:
        assert r["ids"] == model.encode(r["text"] or "") and r["n_ids"] == len(r["ids"])
    assert pieces.encode_pieces(none, PIECES).count() == 0


# ---------------------------------------------------------------- 8


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = pii.fresh(1)
    x, gold = rng.integers(0, pii.SYMBOLS, (3, 7)), rng.integers(0, pii.TAGS, (3, 7))
    _, grad = net.gradients(x, gold)
    for k, w in net.p.items():
        at = (int(x[0, 0]), 1) if k == "embed" else tuple(int(rng.integers(0, s)) for s in w.shape)
        old, losses = w[at], []
        for move in (1e-5, -1e-5):
            w[at] = old + move
            losses.append(net.gradients(x, gold)[0])
        w[at] = old
        assert grad[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-6)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(4, 2, pii.TAGS)), rng.normal(size=(pii.TAGS, pii.TAGS))
    sizes = np.array([4, 3])
    got = pii.viterbi(scores, moves, sizes)
    from itertools import product

    for r, size in enumerate(sizes):
        best = max(
            product(range(pii.TAGS), repeat=int(size)),
            key=lambda p: sum(scores[t, r, k] for t, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])),
        )
        assert got[:size, r].tolist() == list(best)


@settings(max_examples=300, deadline=None)
@given(st.text("a.@-+1 ", max_size=30))
def test_emails_in_one_pass(text):
    pattern = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    assert [s[1:] for s in pii.emails(text)] == [m.span() for m in re.finditer(pattern, text)]


def test_personal_data_of_odd_rows(make_docs, odd, none):
    numbers = [f"{i}.{i}.{i}.{i}" for i in range(1, 200)]
    docs = make_docs([(i, f"reach me at a{i}@b.example.com or {n} or +1 (555) 555-{i:04d} please") for i, n in enumerate(numbers)])
    net = pii.train(docs, windows=200)
    out = pii.detect(odd, net).collect()
    assert len(out) == len(ODD) and all(r["spans"] == "" for r in out if r["doc_id"] in (1, 2, 3))
    assert pii.train(none) is None and pii.detect(none, None).count() == 0
    hidden = pii.mask(docs, net).collect()
    assert all("[EMAIL] or [IP] or [PHONE] please" in r["text"] and r["n_chars"] == len(r["text"]) for r in hidden)
    same = pii.mask(odd, net)
    assert same.columns == odd.columns and same.count() == len(ODD)
    for text in ("1" * 50_000, "1-" * 20_000, "+1" * 20_000, "a@" * 20_000, "1." * 20_000):
        pii.base_spans(text)


@pytest.mark.parametrize("stretches", [60, 3000])
def test_disguised_writings_are_learned_from_any_number_of_stretches(stretches):
    rng = np.random.default_rng(10)
    words = "please call or write to us about the order of room and page for more".split()

    def around(span):
        return f"{' '.join(rng.choice(words, 5))} {span} {' '.join(rng.choice(words, 5))}"

    def span(n):
        a, b, c, d = rng.integers(1, 250, 4)
        return (f"u{a}@mail{b}.example.com", f"{a}.{b}.{c}.{d}")[n % 2]

    texts = [around(span(n) if n % 3 else f"{n} items") for n in range(stretches)]
    x, gold = pii.examples(texts, 600)
    assert len(x) == len(gold) == 600
    net = pii.fit(x, gold)
    hidden = [around(pii.disguised(("email", "ip")[n % 2], span(n), rng)) for n in range(100)]
    bare = [around(f"{n} items") for n in range(100)]
    assert sum(bool(more) for _, more in pii.find(net, hidden)) >= 80
    assert sum(bool(more) for _, more in pii.find(net, bare)) <= 5


# ---------------------------------------------------------------- 9 and 10


def brute(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {
        "chain": [(i, i + 1) for i in range(120)], "star": [(500, i) for i in range(300)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)], "none": [],
    }[shape]
    df = spark.createDataFrame([*edges, *edges, (3, 3), (None, 4)], "a long, b long")
    got = {r["node"]: r["component"] for r in links.components(df).collect()}
    want = brute({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}


def test_near_vectors_of_odd_rows(spark):
    nan = float("nan")
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 16))
    rows = [(i, (base[i % 3] + rng.normal(0, 0.05, 16)).tolist()) for i in range(90)]
    rows += [(200 + i, base[0].tolist()) for i in range(5)]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [nan] * 16), (304, [None] * 16), (None, base[0].tolist()), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(0))
    got = pivots.near_vectors(df, block=16).collect()
    assert len(got) == len(rows)
    x = {i: np.float32(v).astype(float) for i, v in rows if i is not None and v and len(v) == 16 and i < 300}
    ids = sorted(x)
    unit = np.array([x[i] / np.linalg.norm(x[i]) for i in ids])
    near = unit @ unit.T >= 0.95
    want = brute(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    for r in got:
        if r["vec_id"] in want:
            assert r["n_links"] == near[ids.index(r["vec_id"])].sum() - 1
            assert r["component_id"] == want[r["vec_id"]]
        else:
            assert r["n_links"] == 0 and r["component_id"] == r["vec_id"]
    assert pivots.near_vectors(df.filter("false")).count() == 0


@pytest.mark.parametrize("shape", ["cone", "wider cone", "copies of one", "one and an outlier"])
def test_near_vectors_that_lie_close_together(spark, shape):
    rng = np.random.default_rng(7)
    one = rng.normal(size=64)
    one /= np.linalg.norm(one)
    if "cone" in shape:
        x = rng.normal(size=(200, 64)) + one * (20 if shape == "cone" else 14)  # mean cosine 0.86, 0.75
        x = np.concatenate([x, x[:60] + rng.normal(0, 0.3, (60, 64))])
    else:
        x = one + rng.normal(0, 0.02, (260, 64))
        if shape == "one and an outlier":
            x[3] = -one
    x = np.float32(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    want = brute(range(len(x)), np.argwhere(np.triu(near, 1)).tolist())
    got = {r["vec_id"]: r for r in pivots.near_vectors(df, block=64).collect()}
    assert near.sum() > len(x)
    for i in range(len(x)):
        assert got[i]["n_links"] == near[i].sum() - 1 and got[i]["component_id"] == want[i]


@pytest.mark.parametrize("block", [2048, 3])
def test_near_fingerprints_with_hot_parts(spark, block):
    rng = np.random.default_rng(6)
    seeds = rng.integers(-(2**63), 2**63 - 1, 12)
    fps = set(seeds.tolist()) | {0}
    for s in seeds[:4].tolist() + [0]:
        for _ in range(40):
            x = s
            for bit in rng.integers(0, 64, rng.integers(1, 8)):
                x ^= 1 << int(bit) if bit < 63 else -(2**63)
            fps.add(x)
    fps = sorted(fps)
    df = settled(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r["node"]: r["component"] for r in simhash.near_fingerprints(df, 4, block).collect()}
    u = np.array(fps, np.int64).view(np.uint64)
    pairs = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4, 1))
    edges = [(fps[a], fps[b]) for a, b in zip(*pairs, strict=True)]
    want = brute(fps, edges)
    assert got == {n: r for n, r in want.items() if n != r}


def test_allocation_covers_the_distance():
    cost = [[1.0, 9.0, 20.0, 40.0, 80.0], [5.0, 6.0, 30.0, 60.0, 90.0], [2.0, 50.0, 99.0, 120.0, 140.0]]
    total, reach = simhash.allocate(cost, 4)
    assert sum(t + 1 for t in reach) == 5
    from itertools import product

    best = min(
        sum(c[t] for c, t in zip(cost, r, strict=True) if t >= 0)
        for r in product(range(-1, 5), repeat=3) if sum(t + 1 for t in r) == 5
    )
    assert total == best


def test_simhash_of_odd_rows(odd, none):
    out = simhash.simhash_groups(odd).collect()
    assert len(out) == len(ODD)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[2]["fingerprint"] == "0" * 16 and by_id[3]["component_id"] == 1
    assert by_id[6]["component_id"] == 5
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids.count(5) == 1 and 6 not in ids and ids.count(None) == 2
    assert simhash.simhash_groups(none).count() == 0 and simhash.keep_first(none).count() == 0


@pytest.mark.parametrize("text", ["aᲉb", "xꟋy z", "\U000105c0 1", "ſt ŉ ΐ", "aͅb", "Ⅷ½²x"])
def test_encoder_with_rare_characters(text):
    tool = Tokenizer.from_file(WORDS)
    want = tool.encode(text, add_special_tokens=False).ids + [2]
    assert tokenfile.encoder(WORDS).encode(text, 2).tolist() == want
