"""Texts that no pair needs stay out of the shuffle."""

import pytest
from pyspark.sql import functions as F

from meshwork.llm import common, jaccard


def test_texts_are_filtered_before_their_shuffle(spark, monkeypatch):
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    docs = common.materialize(own.range(2000).select(F.col("id").alias("doc"), F.repeat(F.col("id").cast("string"), 50).cast("binary").alias("raw")), "docs")
    dealt = common.materialize(own.range(5).select((F.col("id") * 300).alias("doc"), "id"), "dealt")
    joined, plans = jaccard._with_texts(dealt, docs).select("id", "raw"), []

    def materialize(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        if label == "broken":
            raise ValueError(label)
        return df

    monkeypatch.setattr(common, "materialize", materialize)
    rows = common.materialize_filtered(joined, "texts").collect()
    assert sorted((r["id"], bytes(r["raw"]).decode()) for r in rows) == [(k, str(k * 300) * 50) for k in range(5)]
    _, by, texts, keys = plans[0].split("Relation")  # of the filter, below it, of the other side
    assert plans[0].count("might_contain") == 1 and "raw" not in by and "raw" in texts and "raw" not in keys
    with pytest.raises(ValueError, match="broken"):
        common.materialize_filtered(joined, "broken")
    assert not any(own.conf.get(k) == v for k, v in common.FILTERS.items() if "Threshold" in k)
