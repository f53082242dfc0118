import math

import pytest
from pyspark.sql import functions as F

from meshwork.operators import centrality, community, embeddings, graph, iterate, linkpred, resilience
from meshwork import store
from meshwork.operators.graph import Graph
from meshwork.plans import catalog


def make(spark, pairs, extra=()):
    more = spark.createDataFrame([(x,) for x in extra], "id long") if extra else None
    return Graph.undirected(spark.createDataFrame(pairs, "src long, dst long"), vertices=more)


def table(df, key="id"):
    return {r[key]: r for r in df.collect()}


TRIANGLE = [(1, 2), (2, 3), (1, 3)]
CLIQUES = [(a, b) for q in ((1, 2, 3, 4), (5, 6, 7, 8)) for a in q for b in q if a < b] + [(4, 5)]


def test_triangle(spark):
    g = make(spark, [*TRIANGLE, (2, 1), (3, 3)])
    assert graph.summary(g).first()["edges"] == 3
    assert graph.triangle_total(graph.triangles(g)).first()[0] == 1
    row = graph.clustering(g).first()
    assert row["global_clustering"] == pytest.approx(1 / 6)
    assert graph.clustering(g, "simple").first()["global_clustering"] == pytest.approx(1)
    assert table(centrality.burt_constraint(g))[1]["constraint"] == pytest.approx(1.125)
    assert {r["coreness"] for r in iterate.k_core(g).collect()} == {2}


def test_isolated_vertex(spark):
    g = make(spark, [(1, 2)], extra=[9])
    assert table(centrality.burt_constraint(g))[9]["constraint"] == 1.0
    assert table(iterate.eigenvector(g, 3))[9]["eigenvector"] == 0
    assert table(iterate.pagerank(g, max_iter=3))[9]["pagerank"] == pytest.approx(0.15)
    assert table(graph.degrees(g))[9]["degree"] == 0
    assert table(iterate.connected_components(g))[9]["component"] == 9
    assert table(iterate.k_core(g))[9]["coreness"] == 0


def test_components_and_distances(spark):
    g = make(spark, [(1, 2), (3, 4), (4, 5)])
    comp = {k: r["component"] for k, r in table(iterate.connected_components(g)).items()}
    assert comp == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    found = {(r["id"]): r["distance"] for r in iterate.hops(g, g.vertices.filter("id = 1")).collect()}
    assert found == {1: 0, 2: 1}
    assert resilience.giant_component(g).first()[0] == 3


def test_components_of_long_path(spark):
    g = graph.path_graph(spark, 1, 300)
    assert {r["component"] for r in iterate.connected_components(g).collect()} == {1}


def test_directed_hops_follow_edges_to_the_landmark(spark):
    g = Graph.directed(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"))
    assert {r["id"]: r["distance"] for r in iterate.hops(g, g.vertices.filter("id = 3")).collect()} == {3: 0, 2: 1, 1: 2}
    assert {r["id"] for r in iterate.hops(g, g.vertices.filter("id = 1")).collect()} == {1}


def test_pagerank_of_path(spark):
    ranks = {k: r["pagerank"] for k, r in table(iterate.pagerank(graph.path_graph(spark), max_iter=5)).items()}
    assert sum(ranks.values()) == pytest.approx(100)
    assert ranks[101] == pytest.approx(0.616775, abs=1e-6) and ranks[102] == pytest.approx(1.236952, abs=1e-6)
    assert ranks[101] == pytest.approx(ranks[200])


def test_pagerank_wants_one_rule(spark):
    with pytest.raises(ValueError):
        iterate.pagerank(graph.path_graph(spark, 1, 3))


def test_betweenness_and_closeness_of_path(spark):
    g = make(spark, [(1, 2), (2, 3), (3, 4)])
    b = {k: r["betweenness"] for k, r in table(centrality.betweenness(g)).items()}
    assert b[2] == pytest.approx(2 / 3) and b[3] == pytest.approx(2 / 3) and b[1] == 0
    c = {k: r["closeness"] for k, r in table(centrality.closeness(g)).items()}
    assert c[1] == pytest.approx(9 / (3 * 6)) and c[2] == pytest.approx(9 / (3 * 4))


def test_star(spark):
    g = make(spark, [(0, k) for k in range(1, 5)])
    assert table(centrality.degree_centrality(g))[0]["degree_centrality"] == 2.0
    assert table(centrality.degree_centrality(g, "simple"))[0]["degree_centrality"] == 1.0
    assert table(centrality.burt_constraint(g))[0]["constraint"] == pytest.approx(0.25)


def test_cliques(spark):
    g = make(spark, CLIQUES)
    of = spark.createDataFrame([(k, "a" if k < 5 else "b") for k in range(1, 9)], "id long, community string")
    assert {(r["id"], r["bridge_score"]) for r in community.bridges(g, of).collect()} == {(4, 1), (5, 1)}
    p = table(community.profile(g, of), "community")["a"]
    assert (p["size"], p["internal_edges"], p["external_edges_raw"], p["density"], p["conductance"]) == (4, 6, 1, 1.0, round(1 / 13, 4))
    v = {k: r["vulnerability"] for k, r in table(resilience.vulnerability(g)).items()}
    assert v[4] == pytest.approx(4 / 8) and v[1] == pytest.approx(1 / 8)
    m = community.modularity(g, of).first()[0]
    assert m == pytest.approx(2 * (12 / 26 - 0.25))
    moved = community.local_moving(g, 10)
    assert moved.select("community").distinct().count() <= 4
    assert community.modularity(g, moved).first()[0] >= 0


def test_attack_and_cascade(spark):
    g = make(spark, CLIQUES)
    rows = resilience.attack_curve(g, resilience.degree_order(g), 8).orderBy("step").collect()
    assert [r["remaining"] for r in rows] == list(range(8, -1, -1))
    assert rows[0]["giant_size"] == 8 and rows[1]["giant_size"] == 4 and rows[-1]["giant_size"] == 0
    a = resilience.adaptive_attack(g, 8).orderBy("step").collect()
    assert a[1]["giant_size"] == 4
    c = resilience.cascade(g, share=0.2).orderBy("round").collect()
    assert c[-1]["failed"] >= c[0]["failed"]


def test_link_features(spark):
    g = make(spark, [(1, 2), (2, 3), (3, 4), (2, 4), (5, 6)])
    pairs = spark.createDataFrame([(1, 3), (1, 6), (1, 1)], "u long, v long")
    f = {(r["u"], r["v"]): r for r in linkpred.features(g, pairs).collect()}
    r = f[1, 3]
    assert (r["common_neighbors"], r["preferential_attachment"], r["path_distance"], r["same_community"]) == (1, 2, 2, 0)
    assert r["jaccard"] == pytest.approx(0.5) and r["resource_allocation"] == pytest.approx(1 / 3)
    assert r["adamic_adar"] == pytest.approx(1 / math.log(3 + 1e-9))
    assert r["katz"] == pytest.approx(0.005 + 0.005**2 * 1 - 0.005**2 * 1 + 0.005**2 * 0, abs=1e-4)
    assert f[1, 6]["path_distance"] == 5 and f[1, 1]["path_distance"] == 0


def test_label_propagation_prefers_small_labels(spark):
    labels = {k: r["label"] for k, r in table(iterate.label_propagation(make(spark, TRIANGLE), 5)).items()}
    assert len(set(labels.values())) <= 2 and set(labels) == {1, 2, 3}


def test_trace(spark):
    g = make(spark, [(1, 2), (2, 4), (1, 3), (3, 4), (4, 5)])
    assert [r["id"] for r in iterate.trace(g, 1, 5).orderBy("step").collect()] == [1, 2, 4, 5]
    assert iterate.trace(make(spark, [(1, 2), (3, 4)]), 1, 4).count() == 0


def test_empty_graph(spark):
    g = make(spark, [(1, 1)])
    assert g.vertices.count() == 0 and graph.triangles(g).count() == 0
    assert resilience.giant_component(g).first()[0] == 0
    assert iterate.connected_components(g).count() == 0


def test_efficiency_denominators(spark):
    g = make(spark, [(1, 2), (3, 4)])
    assert resilience.global_efficiency(g).first()[0] == 1.0
    assert resilience.global_efficiency(g, denominator="all").first()[0] == pytest.approx(4 / 12)


def test_sample_is_repeatable(spark):
    v = spark.range(100).select(F.col("id"))
    a, b = (sorted(r[0] for r in centrality.sample(x, rows=10).collect()) for x in (v, v.repartition(7)))
    assert a == b and len(a) == 10


def test_node_embeddings_take_distributed_walks(spark, monkeypatch):
    g, lengths, walk = make(spark, CLIQUES), [], embeddings.walks

    def walks(of, **settings):
        out = walk(of, **settings | {"length": 4, "per_vertex": 2})
        lengths.append([len(r["walk"]) for r in out.collect()])
        return out

    monkeypatch.setattr(embeddings, "walks", walks)
    monkeypatch.setattr(catalog.X, "sparse", lambda s, d: g)
    rows = catalog.QUERIES["node_embeddings"](spark, "").collect()
    assert lengths == [[4] * 16] and sorted(r["id"] for r in rows) == [str(k) for k in sorted(r["id"] for r in g.vertices.collect())]


@pytest.mark.parametrize("name", ["link_features", "link_models", "predicted_links"])
def test_link_queries_use_the_defaults(spark, monkeypatch, name):
    """Distances up to 4 hops are told apart, and training isn't shortened."""
    g, calls, features = make(spark, [(k, k + 1) for k in range(1, 8)]), [], linkpred.features
    far = spark.createDataFrame([(1, 4, 0), (1, 5, 0), (1, 7, 0)], "u long, v long, label int")
    found = []

    def kept(of, pairs, *args, **settings):
        calls.append(settings)
        found.append({(r["u"], r["v"]): r["path_distance"] for r in features(of, far, *args, **settings).collect()})
        return features(of, pairs, *args, **settings)

    def train(rows, **settings):
        calls.append(settings)
        return spark.createDataFrame([("none", 0.5)], "model string, auc double"), None

    monkeypatch.setattr(linkpred, "features", kept)
    monkeypatch.setattr(linkpred, "train", train)
    monkeypatch.setattr(linkpred, "predict", lambda model, rows: rows)
    monkeypatch.setattr(linkpred, "dataset", lambda of: far)
    monkeypatch.setattr(catalog.X, "sparse", lambda s, d: g)
    monkeypatch.setattr(catalog.X, "brands", lambda s, d: None)
    catalog.QUERIES[name](spark, "")
    assert found and all(x == {(1, 4): 3, (1, 5): 4, (1, 7): 5} for x in found) and not any(calls)


def test_walks_follow_their_weights(spark):
    """Shares of steps are those of the weights; walks repeat, and a vertex without edges stays alone."""
    edges = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (3, 6)]
    g = Graph.undirected(spark.createDataFrame(edges, "src long, dst long"), vertices=spark.createDataFrame([(9,)], "id long"))
    rows = sorted(map(tuple, embeddings.walks(g, length=6, per_vertex=300, p=4.0, q=0.25).collect()))
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    steps = {}
    for name, walk in rows:
        v = [int(x) for x in walk]
        assert v[0] == int(name.split(":")[0]) and len(v) == (1 if v[0] == 9 else 6) and all(b in near[a] for a, b in zip(v, v[1:], strict=False))
        for a, b, c in zip(v, v[1:], v[2:], strict=False):
            steps.setdefault((a, b), []).append(c)
    for (a, b), to in steps.items():
        weight = {c: 1 / 4 if c == a else 1.0 if c in near[a] else 4.0 for c in near[b]}
        for c, w in weight.items():
            assert abs(to.count(c) / len(to) - w / sum(weight.values())) < 2.5 / len(to) ** 0.5


def test_walks_take_one_join_a_step(spark, monkeypatch):
    """Steps are taken in lists of ends, few tables each; vertices with several lists keep their weights."""
    tables, put = [], store.Rounds.cut
    monkeypatch.setattr(store.Rounds, "cut", lambda self, df, label: (tables.append(label), put(self, df, label))[1])
    monkeypatch.setattr(embeddings, "ENDS", 2, raising=False)
    edges = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (3, 6), (2, 6)]
    g, near = make(spark, edges), {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    steps = {}
    for r in embeddings.walks(g, length=8, per_vertex=300, p=1.0, q=0.5).collect():
        v = [int(x) for x in r["walk"]]
        assert len(v) == 8 and all(b in near[a] for a, b in zip(v, v[1:], strict=False))
        for a, b, c in zip(v, v[1:], v[2:], strict=False):
            steps.setdefault((a, b), []).append(c)
    for (a, b), to in steps.items():
        weight = {c: 1.0 if c == a or c in near[a] else 2.0 for c in near[b]}
        for c, w in weight.items():
            assert abs(to.count(c) / len(to) - w / sum(weight.values())) < 2.5 / len(to) ** 0.5
    monkeypatch.setattr(embeddings, "ENDS", 100, raising=False)
    tables.clear()
    assert {len(r["walk"]) for r in embeddings.walks(g, length=8, per_vertex=300, p=1.0, q=0.5).collect()} == {8}
    assert len(tables) == 1  # a proposal a round and join, it took three or more
