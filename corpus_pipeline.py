"""From raw documents to packed training sequences, in stages that are written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import exact_dedup, near_dedup, packing, secret_scan, toxicity
from gaugeframe.llm.common import store

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model is learnt from the labelled documents."""
    raw, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.learn(raw, labels, "doc_id", "text", "toxic")
    return toxicity.drop_toxic(docs, model, "text")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return exact_dedup.drop_copies(docs, "doc_id", "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % of shared five-word shingles; documents without words stay."""
    return near_dedup.drop_near_copies(docs, "doc_id", "text")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced by a mark; ``n_chars`` follows the new text."""
    hidden = secret_scan.redact(docs, "doc_id", "text", secret_scan.BASE_RULES + secret_scan.MORE_RULES)
    changed = F.length("text").cast(docs.schema["n_chars"].dataType)
    return hidden.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence of at most 2048 tokens."""
    return packing.pack(docs, "doc_id", "text", TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("secret scan", hide_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # a learnt model, a tokenizer and a packing: tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written to the shared folder and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
