"""From documents to packed training sequences: five stages, each a table that the next one reads.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last return the columns of
``documents``.  What a stage does with nulls, empty texts, repeated rows and empty tables its operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import decontaminate, near_copies, packing, secrets_linked, toxicity
from skyloom.llm.common import kept

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under a half; labels of the held-out fifth are not learned from."""
    weights = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~toxicity.held_out(F.col("id")))
    return docs.where(toxicity.score_column(weights, F.col("text")) < 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of five-word likeness 0.8 or more: that of the smallest id."""
    return near_copies.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item stands in."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by ``[secret]`` and ``n_chars`` brought up to date."""
    out = secrets_linked.mask_documents(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as ``packing.pack`` gives them."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", masked_secrets),
    ("packing", packed),
]

#: Near duplicates, trained classifiers and tokenizers have no SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
