"""Registered corpus queries: SQL where there is some, brute force where there is none."""

import hashlib
import re
import zlib
from html import unescape

import numpy as np
import pytest
import sentencepiece
import xxhash
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from compare import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def rows(spark, folder, name):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


@pytest.fixture(scope="module")
def texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", ["op5_pareto_mix", "op6_exact_topk"])
def test_against_sql(spark, folder, name):
    assert compare(spark, connect(folder), QUERIES[name], ORACLES[name], folder) is None


def test_every_operator_is_registered():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    assert "pipeline" in QUERIES


def test_token_file(spark, folder, texts):
    tool = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    start, want = 0, []
    for i in sorted(texts):
        ids = tool.encode(texts[i], add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = rows(spark, folder, "op2_token_file")
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_languages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    got = QUERIES["op3_language"](spark, folder).join(docs, "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.9


def test_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    out = QUERIES["op4_toxicity"](spark, folder)
    got = out.join(labels, "doc_id").collect()
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in got if r["held_out"]]
    caught = [r["predicted"] for r in held if r["toxic"]]
    clean = [r["predicted"] for r in held if not r["toxic"]]
    assert np.mean(caught) >= 0.5 and np.mean(clean) <= 0.02


def test_pieces(spark, folder, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for r in rows(spark, folder, "op7_pieces"):
        assert r["ids"] == model.encode(texts[r["doc_id"]])
        assert r["decoded"] == texts[r["doc_id"]].replace("▁", " ")


def test_personal_data(spark, folder, texts):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def passes(kind, match):
        digits = re.sub(r"\D", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            total = sum(
                int(d) if n % 2 == 0 else sum(map(int, str(2 * int(d))))
                for n, d in enumerate(reversed(digits))
            )
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    for r in rows(spark, folder, "op8_personal_data"):
        spans = [
            (k, *m.span())
            for k, p in patterns.items()
            for m in re.finditer(p, texts[r["doc_id"]])
            if passes(k, m[0])
        ]
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        for k in patterns:
            assert r[f"n_{k}"] == sum(s[0] == k for s in spans)


def smallest(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_near_vectors(spark, folder):
    data = sorted(
        spark.read.parquet(f"{folder}/embeddings.parquet").collect(), key=lambda r: r["vec_id"]
    )
    x = np.array([r["embedding"] for r in data], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    root = smallest(len(data), zip(a, b, strict=True))
    degree = np.bincount(np.append(a, b), minlength=len(data))
    got = {r["vec_id"]: r for r in rows(spark, folder, "op9_pivot_near_vectors")}
    assert len(got) == len(data)
    for i, r in enumerate(data):
        g = got[r["vec_id"]]
        assert g["n_links"] <= degree[i]
        assert g["kept"] == (g["component_id"] == r["vec_id"])
    found = sum(g["n_links"] for g in got.values())
    assert found >= 0.9 * degree.sum()
    if found == degree.sum():
        assert [got[r["vec_id"]]["component_id"] for r in data] == [data[k]["vec_id"] for k in root]


def test_simhash(spark, folder, texts):
    ids = sorted(texts)
    prints = []
    for i in ids:
        words = texts[i].encode().lower().split()
        k = min(4, len(words))
        hashes = [
            xxhash.xxh64_intdigest(b" ".join(words[s : s + k]), 42) for s in range(len(words) - k + 1)
        ] if words else []
        prints.append(sum(
            1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
        ))
    fp = np.array(prints, np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, 1))
    root = smallest(len(ids), zip(a, b, strict=True))
    want = {i: (f"{fp[n]:016x}", ids[root[n]]) for n, i in enumerate(ids)}
    got = {
        r["doc_id"]: (r["fingerprint"], r["component_id"])
        for r in rows(spark, folder, "op10_simhash_groups")
    }
    assert got == want


def test_html_covers_the_words_of_a_page(spark, folder):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in rows(spark, folder, "op1_html_text"):
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<(script|style)[^>]*>.*?</\1>", "", pages[r["page_id"]])
        words = unescape(re.sub(r"<[^>]+>", " ", body)).split()
        shown = [w for w in r["text"].split() if w != "-"]
        assert "".join(words) == "".join(shown)


def test_pipeline(spark, folder, texts):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    kept = docs
    counts = [docs.count()]
    for _, stage in cp.STAGES[:-1]:
        kept = cp.settled(stage(spark, kept, folder))
        assert kept.columns == docs.columns
        counts.append(kept.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3]
    out = cp.run(spark, folder)
    assert out.count() == counts[4]
    last = out.select("doc_id", "text", "decoded", F.size("ids").alias("n")).collect()
    assert all(r["decoded"] == r["text"] for r in last if "▁" not in (r["text"] or ""))
    predicted = {
        r["doc_id"] for r in QUERIES["op4_toxicity"](spark, folder).filter("predicted = 1").collect()
    }
    assert not predicted & {r["doc_id"] for r in last}
