"""A corpus pipeline: language, quality, exact copies, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshwork.llm import dedup, jaccard, langid, packing, quality
from meshwork.llm.common import materialize, table
from meshwork.llm.queries import language_model, quality_model, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a known language or whose likeliest one scores under a half."""
    return langid.accept(docs, language_model(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score under a half for quality."""
    return quality.accept(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps that with the largest id."""
    return dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 0.8 or more connect, keeps the document with the smallest id."""
    return jaccard.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.pack(packing.tokenize(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [("language ID", language), ("quality classifier", good), ("exact dedup", exact), ("n-gram Jaccard join", near), ("best-fit packing", packed)]

#: The classifiers can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
