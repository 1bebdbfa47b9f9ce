"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from public_tokenizers import path as tokenizer_path

from tablewright.llm import (
    gru, html, language, mixing, pieces, pii, pivots, simhash, tokenfile, topk, toxicity, trie, variants,
)
from tablewright.llm.common import fold, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_html_text")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages")).select("page_id", "url", "text")


@query("op2_token_file")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/llm-ids-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents")
    tokenfile.write_ids(docs, path, tokenizer_path("word_bpe_49k.json"), end=2)
    return tokenfile.read_digests(spark, path)


@query("op3_language")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = fold("doc_id", 5) == 0
    classifier = language.train(docs, ~held)
    out = language.identify(docs.select("doc_id", "text"), classifier)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = fold("doc_id", 3) == 1
    model = toxicity.train(docs, table(spark, folder, "labels"), ~held)
    out = toxicity.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op5_pareto_mix", mixing.ORACLE)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.mix(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op6_exact_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
    )
    SELECT query_id,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
             AS rank, vec_id, score
    FROM s QUALIFY rank <= 10
    """,
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op7_pieces")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = pieces.encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_ids", "ids", "decoded")


@query("op8_personal_data")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.detect(docs, pii.train(docs))


@query("op9_pivot_near_vectors")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_vectors(table(spark, folder, "embeddings"))


@query("op10_simhash_groups")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"))


@query("op11_prefix_trie")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    turns = trie.turn_sequences(table(spark, folder, "conversations"))
    return trie.prefix_trie(trie.shared_heads(turns)).drop("turn_key")


@query("op12_recurrent_lm")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = fold("doc_id", 5) == 1
    out = gru.score(docs, gru.train(docs, ~held))
    return out.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op13_spelling_variants")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(variants.count_words(table(spark, folder, "documents")))
