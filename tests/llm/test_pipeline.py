"""The pipeline and the registered queries on the small driver tables."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from meshwork.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).persist()
        assert now.columns == docs.columns
        kept[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
    sizes = [len(x) for x in kept.values()]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = kept["quality classifier"]
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in ids for d in good) >= 0.95 * len(good)
    assert sum(d in ids for d in bad) <= 0.2 * len(bad)
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r["doc_id"] for r in out} == kept["n-gram Jaccard join"]


def test_queries_cover_their_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_sentencepiece", "op2_exact_dedup", "op3_sharding", "op4_fingerprints", "op5_language_id", "op6_jaccard_join", "op9_quality"):
        rows = queries.QUERIES[name](spark, SF).select("doc_id").collect()
        assert len(rows) == n and Counter(r[0] for r in rows).most_common(1)[0][1] == 1, name
