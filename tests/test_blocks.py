"""Work in blocks and packed searches against plain versions."""

import time
from itertools import combinations, permutations

from pyspark.sql import functions as F

from meshwork import store
from meshwork.operators import centrality, graph, iterate
from meshwork.operators.graph import Graph

PAIRS = [(a, b) for a, b in combinations(range(1, 25), 2) if (a * 7 + b * 5) % 4 == 0] + [(30, 31)]


def make(spark):
    return Graph.undirected(spark.createDataFrame(PAIRS, "src long, dst long"))


def neighbours():
    near = {}
    for a, b in PAIRS:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    return near


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    before = files()
    assert store.cut(spark.range(1000).repartition(3).groupBy(F.col("id") % 10).count()).count() == 10
    end = time.time() + 20
    while files() > before + 8 and time.time() < end:  # the count's own, of four tasks at most
        time.sleep(0.2)
    assert files() <= before + 8 and spark.conf.get(store.CLEANUP) == "false"


def test_triangles_in_blocks(spark):
    near = neighbours()
    want = {frozenset(t) for t in combinations(near, 3) if all(b in near[a] for a, b in combinations(t, 2))}
    for ends in (3, 10**8):
        found = [frozenset((r["a"], r["b"], r["c"])) for r in graph.wedges_closed(make(spark), ends).collect()]
        assert len(found) == len(want) and set(found) == want
        counts = {r["id"]: r["triangles"] for r in graph.triangles(make(spark), ends).collect()}
        assert counts == {v: sum(v in t for t in want) for v in near}


def test_open_wedges(spark):
    near = neighbours()
    want = {b: sum(c not in near[a] for a, c in permutations(near[b], 2)) for b in near}
    assert {r["b"]: r["wedges"] for r in graph.open_wedges(make(spark)).collect()} == {b: n for b, n in want.items() if n}


def test_burt_constraint_counts_every_common_neighbour(spark):
    near = neighbours()
    p = lambda i, j: (1 + sum(1 / len(near[q]) for q in near[i] & near[j])) / len(near[i])
    for r in centrality.burt_constraint(make(spark)).collect():
        assert abs(r["constraint"] - sum(p(r["id"], j) ** 2 for j in near[r["id"]])) < 1e-9


def test_packed_searches(spark, monkeypatch):
    """Rows of few and many words, several blocks, more than 64 sources of one step and edges that a step can't pass."""
    near, n = neighbours(), 70
    line = [(100, k) for k in range(101, 100 + n)]
    g = Graph.undirected(spark.createDataFrame([*PAIRS, *line], "src long, dst long"))
    for a, b in line:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)

    def search(s):
        dist, todo = {s: 0}, [s]
        for v in todo:
            for w in near[v] - dist.keys():
                dist[w] = dist[v] + 1
                todo.append(w)
        return [d for d in dist.values() if d]

    far = {v: search(v) for v in near}
    close = {v: len(d) ** 2 / ((len(near) - 1) * sum(d)) for v, d in far.items()}
    for words, rows in ((1, centrality.STATE_ROWS), (8, 100)):
        monkeypatch.setattr(iterate, "WORDS", words)
        got = {r["id"]: r["closeness"] for r in centrality.closeness(g, rows=rows).collect()}
        assert got.keys() == close.keys() and all(abs(got[v] - close[v]) < 1e-9 for v in got)
        step = g.edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(1).alias("until"))
        sources = spark.createDataFrame([(s, k, 100 + k) for s in (0, 1) for k in range(n)], "step int, place int, id long")
        out = {(r["step"], r["id"]): r["reach"] for r in iterate.reached(step, sources, ["step"], F.lit, open_=F.col("step") < F.col("until")).collect()}
        assert out == {(s, 100 + k): n - 1 if s == 0 else 0 for s in (0, 1) for k in range(n)}


def test_far_hops(spark, monkeypatch):
    """Chains, rings with and without the source, branches and both ends of a chain in one vertex: as level by level, without its jobs."""
    pairs = [*[(k, k + 1) for k in range(1, 40)], (40, 10), (5, 60), *[(k, k + 1) for k in range(60, 75)], (75, 20), *[(k, k + 1) for k in range(80, 85)], (80, 85), (90, 91), (91, 92), (92, 90), (92, 1), (95, 96)]
    g = Graph.undirected(spark.createDataFrame(pairs, "src long, dst long"))
    for s in (7, 82):
        source = g.vertices.filter(F.col("id") == s)
        want = {r["id"]: r["distance"] for r in iterate.hops(g, source).collect()}
        rows = iterate.far_hops(g, source).collect()
        assert len(rows) == len(want) and {r["id"]: r["distance"] for r in rows} == want
    monkeypatch.setattr(iterate, "_levels", None)  # a long chain took a job for each four steps
    g = graph.path_graph(spark, 1, 300)
    assert [(r["step"], r["id"]) for r in iterate.trace(g, 1, 300).orderBy("step").collect()] == [(k, k) for k in range(1, 301)]


def test_betweenness_packs_its_sources(spark, monkeypatch):
    """As Brandes by hand over all and some sources, in several blocks and lists; a level has no row for each source and vertex."""
    near = neighbours()

    def dependencies(s):
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
        return {v: x for v, x in delta.items() if v != s}

    sizes, put = [], store.Rounds.cut

    def kept(self, df, label):
        out = put(self, df, label)
        if label.startswith("brandes-"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(store.Rounds, "cut", kept)
    n = len(near)
    for some, rows, longest in ((sorted(near), 10**8, 1000), (sorted(near), 200, 3), (sorted(near)[:5], 10**8, 2)):
        monkeypatch.setattr(centrality, "LIST", longest, raising=False)
        sizes.clear()
        want = dict.fromkeys(near, 0.0)
        for s in some:
            for v, x in dependencies(s).items():
                want[v] += x * n / len(some) / ((n - 1) * (n - 2))
        sources = spark.createDataFrame([(s,) for s in some], "id long")
        got = {r["id"]: r["betweenness"] for r in centrality.betweenness(make(spark), sources, rows=rows).collect()}
        assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in got)
        if rows == 10**8:
            assert max(sizes) <= n * -(-len(some) // 16)
