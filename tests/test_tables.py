import pytest
from pyspark.sql import functions as F

from meshwork.functions import scalars as S
from meshwork.operators import compare, transit
from meshwork.session import Profile
from meshwork.sources import edges, sinks
from meshwork.streaming import events as streams


def lines(spark, *rows):
    return spark.createDataFrame([(x,) for x in rows], "value string")


def test_dirty_edge_list(spark):
    rows = lines(spark, "# c", "", "1 1", "1 2", "2 1", "1 2 9", "3,4", " 5\t6", "x")
    got = {tuple(sorted((r["src"], r["dst"]))) for r in edges.edge_lines(rows).collect()}
    assert got == {("1", "2"), ("3", "4"), ("5", "6")}


def test_header_and_types(spark):
    rows = lines(spark, "src,dst", "1,2", "a,3")
    assert edges.edge_lines(rows).count() == 3
    assert edges.edge_lines(rows, header=True).count() == 2
    assert [tuple(r) for r in edges.edge_lines(rows, id_type="bigint").collect()] == [(1, 2)]


def test_files(spark, tmp_path):
    import gzip

    (tmp_path / "big.csv").write_text("1,2\n" * 99)
    with gzip.open(tmp_path / "small.txt.gz", "wt") as f:
        f.write("1 2\n2 3\n")
    found = edges.discover(spark, str(tmp_path))
    assert found.endswith("small.txt.gz")
    assert edges.load_graph(spark, found).edges.count() == 4
    assert edges.discover(spark, str(tmp_path / "none")) is None
    (tmp_path / "od").mkdir()
    (tmp_path / "od" / "a.csv").write_text("Origin, Destination ,x\nA,B,1\n")
    (tmp_path / "od" / "b.csv").write_text("y\n1\n")
    assert [tuple(r) for r in edges.read_od_tables(spark, str(tmp_path / "od")).collect()] == [("A", "B")]


def test_scrape_and_metrics(spark):
    log = lines(spark, "nodes = 4,039", "noise", "nodes = 5")
    assert [tuple(r) for r in edges.scrape(log, {"nodes": r"nodes = ([\d,]+)", "none": r"x(y)"}).collect()] == [("nodes", "5")]
    t = sinks.metrics(spark, {"a": "1,234.5", "b": "N/A", "c": None})
    assert [tuple(r) for r in edges.read_metrics(t).collect()] == [("a", 1234.5)]


def test_quoted_rows(spark):
    got = edges.repair_quoted_rows(lines(spark, '"id,name"', '"1,Stop A"', '"2"'), ["id", "name"]).collect()
    assert [tuple(r) for r in got] == [("1", "Stop A"), ("2", None)]


def test_normalize(spark):
    df = spark.createDataFrame([(" 7", "x", "12.5")], "` ID ` string, Latitude string, LNG string")
    out = transit.normalize(df, transit.GPS_ALIASES, {"bus_id": "string", "lat": "double", "lon": "double"}).first()
    assert (out["lat"], out["lon"]) == (None, 12.5)
    assert transit.normalize(df, {}, {"nothing": "int"}).count() == 0


def test_gps_speed(spark):
    rows = [("a", "2024-01-01 00:00:00", 10.0, 77.0), ("a", "2024-01-01 01:00:00", 10.5, 77.0), ("a", "2024-01-01 01:00:00", 10.6, 77.0), ("a", "2024-01-01 01:01:00", 20.0, 77.0)]
    out = transit.normalize_gps(spark.createDataFrame(rows, "ID string, Timestamp string, Latitude double, Longitude double")).orderBy("ts").collect()
    assert [r["speed"] for r in out] == [pytest.approx(55.597, abs=1e-3), 110.0]


def test_speed_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 10.0, 10.01, 120.0, 121.0, -1.0)], "speed double")
    got = {r["band"]: r["n"] for r in transit.bands(df).collect()}
    assert got["0-10"] == 2 and got["10-20"] == 1 and got["80-120"] == 1 and sum(got.values()) == 4 and len(got) == 8


def test_names(spark):
    row = spark.range(1).select(
        S.slugify(F.lit("  A & b--C!")).alias("slug"),
        S.dataset_slug(F.lit("/x/Face_Book.txt.gz")).alias("set"),
        S.location_name(F.lit("mysuru_(city).bus  stand-12")).alias("place"),
        S.with_separators(F.lit(1234.50)).alias("n"),
        S.to_number(F.lit("1,234.5")).alias("x"),
        S.to_number(F.lit("N/A")).alias("y"),
        S.rgb(F.lit("#1f77b4")).alias("rgb"),
        transit.shift_minutes(F.lit("22:00"), F.lit("06:00")).alias("shift"),
        S.digits(F.lit("Stop 42b")).alias("d"),
    ).first()
    assert (row["slug"], row["set"], row["n"], row["x"], row["y"], row["rgb"], row["shift"], row["d"]) == ("a-b-c", "face-book", "1,234.5", 1234.5, None, [31, 119, 180], 480, 42)
    assert row["place"] == "Mysuru Bus Stand"


def test_placeholder_route_and_defaults(spark):
    df = spark.createDataFrame([("route 1", 1.0, 2.0)], "route string, lat double, lon double")
    assert transit.normalize_routes(df).first()["route_id"] == "R101"


def test_compare(spark):
    a, b = sinks.metrics(spark, {"n": 1, "avg_degree": 2.0, "t": 5}), sinks.metrics(spark, {"n": 1, "avg_degree": 2.01})
    rows = {r["metric"]: r["status"] for r in compare.compare_metrics(["n", "avg_degree", "t"], a, b).collect()}
    assert rows == {"n": "matched", "avg_degree": "matched", "t": "specific"}
    assert '"x":[{"id":0}]' in compare.payload(x=spark.range(1)).first()[0]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0, 3), (2, 1, 1)], "id long, community int, degree long")
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    text = "\n".join(r["value"] for r in sinks.gexf_lines(nodes, pairs).orderBy("place", "key").collect())
    import xml.etree.ElementTree as ET

    root = ET.fromstring(text)
    assert len(list(root.iter("{http://www.gexf.net/1.2draft}node"))) == 2 and len(list(root.iter("{http://www.gexf.net/1.2draft}edge"))) == 1
    assert "<canvas" in sinks.html_page(nodes, pairs)
    sinks.write_csv(nodes, str(tmp_path / "n"))
    assert edges.read_table(spark, str(tmp_path / "n"), "id long, community int, degree long").count() == 2
    assert sinks.placeholder(spark, ["a", "b"], "fast").first()["b"] == "skipped_fast"
    assert "| id |" in sinks.markdown("t", {"x": spark.range(2)})


def test_profile():
    p = Profile.from_env({"MESHWORK_LARGE_VERTICES": "5", "MESHWORK_FAST": "1"})
    assert p.large_vertices == 1_000_000 and p.is_fast(2_000_000, 0) and not p.is_fast(10, 10)


def test_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 7, 1.0), (2, "2024-01-01 01:00:00", 7, 3.0), (3, "2024-01-01 01:30:00", 8, 5.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "e"))
    got = streams.run(streams.rates(streams.read(spark, str(tmp_path / "e"), df.schema)), "t").collect()
    assert [(r["event_id"], r["rate"]) for r in got] == [(2, 2.0)]


def test_demo_positions_and_routes(spark):
    assert transit.demo_gps(spark).count() == 324
    trips = spark.createDataFrame([("AA", "BB"), ("AA", "BB"), ("A", "BB"), ("CC", "CC")], "origin string, destination string")
    routes = transit.od_routes(trips)
    assert [(r["trip_count"], r["route_name"]) for r in routes.collect()] == [(2, "AA -> BB")]
    known = spark.createDataFrame([("AA", 1.0, 2.0)], "city string, lat double, lon double")
    points, skipped = transit.od_polylines(routes, known)
    assert points.count() == 0 and skipped.count() == 1
    filled = transit.synthesize_coordinates(trips, known)
    assert {r["city"] for r in filled.collect()} >= {"AA", "BB"}
    assert transit.od_polylines(routes, filled)[0].count() == 3


def test_many_od_tables_in_one_scan(spark, tmp_path):
    """Files with other columns, orders, quotes, blank first lines and without the two columns; one scan of text for all."""
    want = []
    for k in range(200):
        folder = tmp_path / f"d{k % 7}" / "x"
        folder.mkdir(parents=True, exist_ok=True)
        if k % 5 == 4:
            (folder / f"{k}.csv").write_text("name,value\nA,B\n")
        else:
            rows = [(f"O{k}", f"D{k}"), ("St. Mary, North", f"D{k}")]
            if k % 2:
                (folder / f"{k}.csv").write_text("\n Destination ,n,ORIGIN\n" + "".join(f'{d},{k},"{o}"\n' for o, d in rows))
            else:
                (folder / f"{k}.csv").write_text("origin,destination\n" + "".join(f'"{o}", {d}\n' for o, d in rows) + "origin,destination\n")
            want += rows
    (tmp_path / "empty.csv").write_text("")
    got = edges.read_od_tables(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2  # the lines, and the written headers


def test_normalized_results(spark):
    paths = transit.normalize_paths(spark.createDataFrame([("a", "b", "3", None), ("a", None, "1", "2"), ("c", "d", "x", "7.5")], "Source string, Target string, hops string, weight string"))
    assert sorted(tuple(r) for r in paths.collect()) == [("a", "b", 3, 3.0), ("c", "d", None, 7.5)]
    assert [tuple(r) for r in transit.normalize_ranks(spark.createDataFrame([("1", "0.5"), ("2", "?")], "node string, Score string")).collect()] == [("1", 0.5)]
    assert [tuple(r) for r in transit.normalize_predictions(spark.createDataFrame([("1", "2", "1.5"), ("1", None, "0.5")], "src string, dst string, prob string")).collect()] == [("1", "2", 1.0)]
    stops = transit.normalize_stops(spark.createDataFrame([("a", "1", "2"), (None, "3", "4")], "Name string, Latitude string, Longitude string"))
    assert sorted(tuple(r) for r in stops.collect()) == [(1, "a", 1.0, 2.0), (2, "Stop-2", 3.0, 4.0)]
