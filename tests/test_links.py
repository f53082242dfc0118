"""Link models in a session that has had observations."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Observation
from pyspark.sql import functions as F

from meshwork.operators import linkpred
from meshwork.store import Rounds


def test_models_of_a_session_with_observations(spark):
    own, seen = spark.newSession(), Observation()
    own.range(3).observe(seen, F.count(F.lit(1)).alias("rows")).collect()
    assert seen.get == {"rows": 3}
    values = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10)).cast("double").alias(c) for k, c in enumerate(linkpred.FEATURES)]
    rows = own.range(80).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), *values, (F.col("id") % 2).cast("int").alias("label"))
    told, best = linkpred.train(rows, trees=2, boosts=1, rounds=2)
    assert {r["model"] for r in told.collect()} == {"random_forest", "gradient_boosting", "logistic_regression"}
    assert len(linkpred.predict(best, rows, 5).collect()) == 5


def test_observed_leaves_the_session_to_models(spark):
    own = spark.newSession()
    out, found = Rounds().observed(own.range(12), "seen", F.count(F.lit(1)).alias("rows"), F.max("id").alias("most"))
    assert found == {"rows": 12, "most": 11} and out.count() == 12
    rows = own.range(12).select(F.col("id").cast("double").alias("x"), (F.col("id") > 5).cast("double").alias("label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression(maxIter=2)]).fit(rows)
    assert model.transform(rows).select("prediction").count() == 12 and len(model.transform(rows).select("prediction").collect()) == 12
