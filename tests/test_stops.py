"""Stop catalogues, orders, names and sources; typed tables; cascades; saved models."""

from pyspark.sql import functions as F

from meshwork.operators import iterate, linkpred, resilience, stops
from meshwork.operators.graph import Graph, path_graph
from meshwork.sources import tables


def points(spark):
    rows = [("R1", "", 1, "A", 1.0, 1.0), ("R1", "", 2, "B", 2.0, 2.0), ("R2", "R2", 1, "B", 2.0, 2.0), ("R2", "R2", 2, "C", 3.0, 3.0), ("R3", "x", 1, None, 0.0, 0.0)]
    return spark.createDataFrame(rows, "route_id string, route_name string, seq int, stop string, lat double, lon double")


def test_stops_and_orders(spark):
    found = stops.stop_catalog(points(spark))
    assert sorted((r["stop_id"], r["stop_name"]) for r in found.collect()) == [(1, "A"), (2, "B"), (3, "C")]
    given = found.filter("stop_id = 2")
    assert stops.stop_catalog(points(spark), given).count() == 1 and stops.stop_catalog(points(spark), given.limit(0)).count() == 3
    legs = spark.createDataFrame([(0, 3, 9, 1.0), (1, 3, 2, 2.0)], "place int, src long, dst long, cost double")
    order = lambda df: [r["stop_id"] for r in df.orderBy("seq").collect()]
    assert order(stops.route_order(found, legs)) == [3, 2, 1]
    assert order(stops.route_order(found, legs.limit(0))) == [1, 2, 3]
    route = stops.route_from_graph(found, legs).orderBy("seq").collect()
    assert [r["stop"] for r in route] == ["C", "B", "A"] and route[0]["route_name"] == "C -> A"
    assert [r["step"] for r in stops.first_legs(legs).collect()] == [1, 2]


def test_names_and_precedence(spark):
    named = {(r["route_id"], r["seq"]): r["route_name"] for r in stops.fill_route_names(points(spark)).collect()}
    assert named["R1", 1] == "A -> B" and named["R2", 2] == "B -> C" and named["R3", 1] == "x"
    steps = spark.createDataFrame([("1", "2"), ("2", "7"), ("x", "1")], "step string, stop_id string")
    got = stops.named_steps(steps, stops.stop_catalog(points(spark))).orderBy("step").collect()
    assert [(r["step"], r["stop_name"]) for r in got] == [(1, "B"), (2, "Stop-7")]
    a, b = points(spark).limit(0), points(spark).limit(2)
    assert stops.prefer(a, b, points(spark)).count() == 2 and stops.prefer(a, a).count() == 0
    catalog = spark.createDataFrame([("R1", "A -> B", "A", "B"), ("R2", "B -> C", "B", "C")], "route_id string, route_name string, origin string, destination string")
    assert stops.find_routes(catalog, "c", "B").count() == 1 and stops.find_routes(catalog, "zz").count() == 2
    both = stops.union_typed({"a": catalog, "b": catalog.select("route_id")}, "source", {"route_id": "string", "origin": "string"})
    assert both.columns == ["source", "route_id", "origin"] and both.filter("origin IS NULL").count() == 2


def test_tables(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "stops.csv").write_text("stop_id,stop_name,latitude,longitude\n1,A,1.5,x\n1,A,1.5,x\n,B,1,1\n")
    rows = tables.to_parquet(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert rows == {"stops": 1}
    row = spark.read.parquet(str(tmp_path / "out" / "stops")).first()
    assert row["stop_id"] == 1 and row["longitude"] is None
    spark.range(20).write.option("header", True).csv(str(tmp_path / "raw" / "parts"))
    found = tables.find_table(spark, "parts", str(tmp_path / "none"), str(tmp_path / "raw"))
    assert tables.first_rows(found).count() == 10 and tables.find_table(spark, "nothing", str(tmp_path)) is None


def test_cascade_and_step_efficiency(spark):
    star = Graph.undirected(spark.createDataFrame([(0, k) for k in range(1, 11)], "src long, dst long"))
    rows = resilience.cascade(star, share=0.5).orderBy("round").collect()
    assert rows[0]["failed"] == rows[0]["new_failures"] and all(abs(r["survival_rate"] - (11 - r["failed"]) / 11) < 1e-9 for r in rows)
    curve = {r["step"]: r["efficiency"] for r in resilience.attack_efficiency(star, resilience.degree_order(star), 11).collect()}
    assert curve[0] == (20 * 1.0 + 90 * 0.5) / 110 and curve[1] == 0.0


def test_hops_looks_ahead(spark, monkeypatch):
    """Small frontiers take several levels in a job, large ones one; the distances are the same."""
    g = path_graph(spark, 1, 30)
    sources = g.vertices.filter("id IN (1, 17)")
    want = sorted((s, v, abs(s - v)) for s in (1, 17) for v in range(1, 31))
    for few in (0, 10_000):
        monkeypatch.setattr(iterate, "FEW", few)
        assert sorted(tuple(r) for r in iterate.hops(g, sources).select("landmark", "id", F.col("distance")).collect()) == want


def test_models_are_saved(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame([(float(k), float(k > 5)) for k in range(12)], "x double, label double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression()]).fit(rows)
    linkpred.save(model, str(tmp_path / "m"))
    again = linkpred.load(str(tmp_path / "m")).transform(rows).select("prediction").collect()
    assert again == model.transform(rows).select("prediction").collect()
