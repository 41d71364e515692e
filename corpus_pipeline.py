"""A training corpus from the documents table, in five stages. Each stage takes (spark, docs, sf_dir) and works on all that the
stage before it kept; its result is written as Parquet to the shared folder and read back for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, mixing, ngrams, quality, substrings
from helixframe.llm.text import fresh, table
from helixframe.scratch import materialize, ship

#: Near-duplicates: words of a shingle, and percent of the union that is shared.
SHINGLE, PERCENT = 5, 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level classifier, fitted to the labels, doesn't reject."""
    ship(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    ship(spark)
    return ngrams.one_of_each(docs, SHINGLE, PERCENT)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat earlier documents."""
    ship(spark)
    return substrings.dedup(docs)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix to the sources' target weights takes."""
    ship(spark)
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, n_tokens, and whether the ids decode to exactly the text."""
    ship(spark)
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    (decoded,) = fresh(docs.drop("ids", "n_tokens", "exact"), "decoded")
    out = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, decoded=decoded)
    exact = F.col(decoded) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.withColumns({"n_tokens": F.size("ids").cast("long"), "exact": exact}).drop(decoded)


STAGES = [("quality classifier", good), ("n-gram Jaccard join", unlike), ("substring dedup", unrepeated), ("mixing to target weights", weighted), ("byte-level BPE", encoded)]

#: SQL can express neither the classifier nor the draws of the mix; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{i}")
    return docs
