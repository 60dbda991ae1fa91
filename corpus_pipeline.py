"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and read again as the next stage's docs. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixspark.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from helixspark.session import discard, scratch, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; without labels of both kinds in ``sf_dir`` none does unless all labels are toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for A-Z and a-z the largest id stays; null texts count as empty ones."""
    return exact_dedup.drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at a similarity of 0.8 on five-word shingles the smallest id stays; texts without words and null ids stay."""
    return near_dedup.drop_near_copies(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A gentle mix that keeps nine tenths of the tokens: small sources, languages and topics stay whole."""
    return mixing.draw_mix(docs, alpha=0.9, least=0.9)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of the text decoded from them."""
    return bpe.tokenized(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_exact_copies),
    ("near_dedup", remove_near_copies),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]
#: A trained classifier and a similarity search can't be told in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:  # the next stage's rows are written
            discard(spark, last)
        last = path
    return docs
