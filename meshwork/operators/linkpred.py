"""Link prediction: pair features, data sets, models."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph, degrees
from meshwork.operators.order import numbered
from meshwork.store import cut, shared_dir

FEATURES = ("common_neighbors", "jaccard", "adamic_adar", "resource_allocation", "preferential_attachment", "same_community", "path_distance", "katz")
BETA = 0.005


def two_hop_pairs(g: Graph) -> DataFrame:
    """u < v that share a neighbour and aren't linked: the candidates that features can tell apart."""
    a, b = g.edges.select(F.col("dst").alias("w"), F.col("src").alias("u")), g.edges.select(F.col("src").alias("w"), F.col("dst").alias("v"))
    return a.join(b, "w").filter("u < v").select("u", "v").distinct().join(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_anti")


def _distances(g: Graph, pairs: DataFrame, most: int) -> DataFrame:
    """u, v, path_distance: 0 for one vertex, the hops up to ``most``, else one more."""
    todo = pairs.select("u", "v").distinct()
    front = todo.select("u").distinct().select("u", F.col("u").alias("at"))
    found, seen = todo.filter("u = v").select("u", "v", F.lit(0).alias("path_distance")), front
    for d in range(1, most + 1):
        front = front.join(g.edges.select(F.col("src").alias("at"), F.col("dst").alias("to")), "at").select("u", F.col("to").alias("at")).distinct()
        front = cut(front.join(seen, ["u", "at"], "left_anti"), "pairs")
        found = found.unionByName(todo.join(front.withColumnRenamed("at", "v"), ["u", "v"], "left_semi").select("u", "v", F.lit(d).alias("path_distance")))
        seen = seen.unionByName(front)
    return todo.join(found, ["u", "v"], "left").select("u", "v", F.coalesce("path_distance", F.lit(most + 1)).alias("path_distance"))


def features(g: Graph, pairs: DataFrame, of: DataFrame | None = None, *, most: int = 4, beta: float = BETA) -> DataFrame:
    """u, v and the eight features of each pair; ``of`` gives id, community."""
    pairs = pairs.select("u", "v").distinct()
    deg = degrees(g, "simple")
    d = lambda c, n: deg.select(F.col("id").alias(c), F.col("degree").alias(n))
    to_u = g.edges.select(F.col("src").alias("u"), F.col("dst").alias("w"))
    to_v = g.edges.select(F.col("src").alias("w"), F.col("dst").alias("v"))
    common = pairs.join(to_u, "u").join(to_v, ["w", "v"]).join(d("w", "dw"), "w").groupBy("u", "v").agg(
        F.count(F.lit(1)).alias("cn"),
        F.sum(F.when(F.col("dw") > 1, 1.0 / F.ln(F.col("dw") + 1e-9)).otherwise(0.0)).alias("aa"),
        F.sum(1.0 / F.col("dw")).alias("ra"),
    )
    # three hops u - w - x - v: the common neighbours of w and v, less v itself where w is linked to it
    three = pairs.join(to_u, "u").join(g.edges.select(F.col("src").alias("w"), F.col("dst").alias("x")), "w").join(g.edges.select(F.col("src").alias("x"), F.col("dst").alias("v")), ["x", "v"]).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n3"))
    linked = pairs.join(to_u, "u").join(to_v, ["w", "v"], "left_semi").groupBy("u", "v").agg(F.count(F.lit(1)).alias("adj"))
    out = pairs.join(common, ["u", "v"], "left").join(three, ["u", "v"], "left").join(linked, ["u", "v"], "left").join(d("u", "du"), "u", "left").join(d("v", "dv"), "v", "left").join(_distances(g, pairs, most), ["u", "v"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    same = F.lit(0)
    if of is not None:
        a, b = (of.select(F.col("id").alias(c), F.col("community").alias(f"c{c}")) for c in ("u", "v"))
        out = out.join(a, "u", "left").join(b, "v", "left")
        same = F.coalesce((F.col("cu") == F.col("cv")).cast("int"), F.lit(0))
    union = zero("du") + zero("dv") - zero("cn")
    return out.select(
        "u",
        "v",
        zero("cn").cast("long").alias("common_neighbors"),
        F.coalesce(F.try_divide(zero("cn").cast("double"), union), F.lit(0.0)).alias("jaccard"),
        F.coalesce("aa", F.lit(0.0)).alias("adamic_adar"),
        F.coalesce("ra", F.lit(0.0)).alias("resource_allocation"),
        (zero("du") * zero("dv")).cast("long").alias("preferential_attachment"),
        same.alias("same_community"),
        "path_distance",
        (beta * zero("cn") + beta * beta * (zero("n3") - zero("adj"))).alias("katz"),
    )


def _order(*parts) -> F.Column:
    return F.md5(F.concat_ws(":", *parts))


def dataset(g: Graph, *, share: float = 0.2, seed: int = 42) -> DataFrame:
    """u, v, label: a share of the edges, and as many pairs without an edge, both the first in md5 order.

    Pairs without an edge come from a seeded order of the vertices, each paired with
    those 1, 2, 3, ... places behind it (the first follow the last): ten of them, or
    half as many more as pairs are asked for. So no cross join is made.
    """
    one = g.pairs().select(F.col("src").alias("u"), F.col("dst").alias("v"))
    n, size = int(one.count() * share), g.vertices.count()
    rank = _order(F.col("u").cast("string"), F.col("v").cast("string"), F.lit(str(seed)))
    first = lambda pairs, label: numbered(pairs, rank, "u", "v").filter(F.col("place") <= n).select("u", "v", F.lit(label).alias("label"))
    placed = numbered(g.vertices, _order(F.col("id").cast("string"), F.lit(f"{seed}a")), "id")
    tries = max(10, -(-3 * n // max(1, 2 * size)) + 2)
    ahead = placed.select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("k"), "place").select("a", (F.pmod(F.col("place") + F.col("k") - 1, F.lit(max(1, size))) + 1).alias("place"))
    mixed = ahead.join(placed.withColumnRenamed("id", "b"), "place").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct()
    return first(one, 1).unionByName(first(mixed.join(one, ["u", "v"], "left_anti"), 0))


def without(g: Graph, pairs: DataFrame) -> Graph:
    """The graph without the pairs' own edges, so that a distance of one doesn't give the label away."""
    gone = pairs.select(F.col("u").alias("src"), F.col("v").alias("dst"))
    gone = gone.unionByName(gone.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return Graph(g.vertices, g.edges.join(gone, ["src", "dst"], "left_anti"))


def _plain(spark: SparkSession, model: PipelineModel) -> PipelineModel:
    """The model written and read back, without its summaries: these hold the session, which tasks can't always get (see ``Rounds.observed``)."""
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    save(model, path)
    return load(path)


def train(rows: DataFrame, *, seed: int = 42, trees: int = 100, boosts: int = 50, rounds: int = 100) -> tuple[DataFrame, object]:
    """(model, auc, importances by model), and the best fitted pipeline; rows: features and label."""
    spark = rows.sparkSession
    learn, test = rows.withColumn("label", F.col("label").cast("double")).randomSplit([0.8, 0.2], seed)
    head = [VectorAssembler(inputCols=list(FEATURES), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)]
    models = {
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed),
        "gradient_boosting": GBTClassifier(maxIter=boosts, maxDepth=5, seed=seed),
        "logistic_regression": LogisticRegression(maxIter=rounds, regParam=0.01),
    }
    out, best = [], (-1.0, None)
    for name, m in models.items():
        fitted = _plain(spark, Pipeline(stages=[*head, m]).fit(learn))
        auc = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(fitted.transform(test))
        weights = fitted.stages[-1].featureImportances.toArray().tolist() if name == "random_forest" else None
        out.append((name, float(auc), weights))
        best = max(best, (auc, fitted), key=lambda x: x[0])
    return spark.createDataFrame(out, "model string, auc double, importances array<double>"), best[1]


def predict(model, rows: DataFrame, k: int = 50) -> DataFrame:
    """The k pairs of the highest probability of a link."""
    return model.transform(rows).select("u", "v", vector_to_array("probability")[1].alias("probability")).orderBy(F.desc("probability"), "u", "v").limit(k)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
