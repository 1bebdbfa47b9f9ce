"""A cleaning pipeline over `documents`: each stage reads what the one before kept.

run() applies the stages in order.  What a stage returns is written as Parquet to the shared folder
and read again, so a lost executor never costs more than tasks of the stage at work.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import mixing, pieces, pii, simhash, toxicity
from tablewright.llm.common import fold, settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.  Learns from labelled documents of the learning fold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-copies."""
    return simhash.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.mask(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their piece ids and the text the ids give back."""
    return pieces.encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("personal data", mask_personal_data),
    ("mix", mix_sources),
    ("pieces", encode),
]

ORACLE_SQL = None  # a learned model and draws of a neural network are not SQL; tested by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: the columns of documents, ids, n_ids and decoded."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
