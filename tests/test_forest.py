"""Forests, blocks, attacks and searches in blocks against plain versions on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from meshwork.operators import centrality, forest, iterate, resilience
from meshwork.operators.graph import Graph, motif
from meshwork.operators.order import numbered


def pieces(vertices, edges):
    up = {v: v for v in vertices}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    out = {}
    for v in vertices:
        out.setdefault(top(v), []).append(v)
    return out


def distances(vertices, edges, start):
    near = {v: set() for v in vertices}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    seen, front, d = {start: 0}, [start], 0
    while front:
        d += 1
        front = sorted({y for x in front for y in near[x]} - set(seen))
        seen |= dict.fromkeys(front, d)
    return seen


@pytest.fixture(scope="module")
def small(spark):
    """Two random parts, a path, a star, a triangle with a tail, and vertices alone."""
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(30)} | {(k, k + 1) for k in range(30, 38)} | {(40, k) for k in range(41, 47)} | {(50, 51), (51, 52), (50, 52), (52, 53)}
    vertices = [*range(25), *range(30, 39), *range(40, 47), *range(50, 54), 60, 61]
    g = Graph.undirected(spark.createDataFrame(sorted(edges), "src long, dst long"), vertices=spark.createDataFrame([(v,) for v in vertices], "id long"))
    return g, vertices, edges


def test_separation_and_vulnerability(small):
    g, vertices, edges = small
    whole = pieces(vertices, edges)
    giant = max(map(len, whole.values()))
    want, harm = {}, {}
    for c, own in whole.items():
        for v in own:
            left = pieces([x for x in own if x != v], [e for e in edges if v not in e and e[0] in own])
            want[v] = (c, len(own), len(left), max(map(len, left.values()), default=0))
            harm[v] = round((giant - max([len(x) for k, x in whole.items() if k != c] + [want[v][3]])) / len(vertices), 6)
    apart = forest.separation(g).persist()
    assert {r["id"]: tuple(r)[1:] for r in apart.collect()} == want
    assert {r["id"]: r["vulnerability"] for r in resilience.harm(apart).collect()} == harm
    apart.unpersist()


def test_blocks_and_bridges(small):
    g, vertices, edges = small
    found = {}
    for r in forest.blocks(g).collect():
        found.setdefault(r["block"], set()).add((r["src"], r["dst"]))
    assert sorted(e for b in found.values() for e in b) == sorted(edges)
    parts = len(pieces(vertices, edges))
    cut = {e for e in edges if len(pieces(vertices, edges - {e})) > parts}
    assert {e for b in found.values() if len(b) == 1 for e in b} == cut
    # edges that meet in a vertex share a block if their other ends hang together without it
    of = {e: k for k, b in found.items() for e in b}
    for v in vertices:
        ends = [e[0] + e[1] - v for e in edges if v in e]
        left = pieces([x for x in vertices if x != v], [e for e in edges if v not in e])
        place = {x: k for k, own in left.items() for x in own}
        for a in ends:
            for b in ends:
                assert (of[min(a, v), max(a, v)] == of[min(b, v), max(b, v)]) == (place[a] == place[b])


def test_spanning_forest_keeps_every_threshold(spark, small):
    _, vertices, edges = small
    rng = random.Random(8)
    heavy = [(a, b, rng.randrange(4)) for a, b in sorted(edges)]
    rows = [tuple(r) for r in forest.spanning_forest(spark.createDataFrame([*heavy, (1, 1, 9), *((b, a, w) for a, b, w in heavy)], "src long, dst long, w int"), "w").collect()]
    assert len(rows) == len(vertices) - len(pieces(vertices, edges)) and set(rows) <= set(heavy)
    for t in range(4):
        assert pieces(vertices, [e[:2] for e in rows if e[2] >= t]) == pieces(vertices, [e[:2] for e in heavy if e[2] >= t])


def test_attacks(small):
    g, vertices, edges = small
    n = len(vertices)
    order = {r["id"]: r["place"] for r in resilience.random_order(g).collect()}
    assert sorted(order.values()) == list(range(1, n + 1))
    per = n // 5
    gone = {v: (order[v] - 1) // per + 1 for v in vertices}
    curve = {r["step"]: (r["remaining"], r["giant_size"]) for r in resilience.attack_curve(g, resilience.random_order(g), 5).collect()}
    shares = {r["step"]: r["efficiency"] for r in resilience.attack_efficiency(g, resilience.random_order(g), 5, rows=n).collect()}
    assert set(curve) == set(shares) == set(range(max(gone.values()) + 1))
    for step, got in curve.items():
        left = [v for v in vertices if gone[v] > step]
        stay = [e for e in edges if min(gone[e[0]], gone[e[1]]) > step]
        assert got == (len(left), max(map(len, pieces(left, stay).values()), default=0))
        far = [1 / d for v in left for d in distances(left, stay, v).values() if d]
        assert shares[step] == pytest.approx(sum(far) / len(far) if far else 0.0)


def test_blocks_of_sources(spark):
    """The sums of several blocks of sources are those of one search from all."""
    vertices, edges = list(range(9)), {(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (1, 4), (5, 6), (6, 7)}
    g = Graph.undirected(spark.createDataFrame(sorted(edges), "src long, dst long"), vertices=spark.createDataFrame([(v,) for v in vertices], "id long")).persist()
    n = len(vertices)
    far = {v: distances(vertices, edges, v) for v in vertices}
    close = {v: (len(d) - 1) ** 2 / ((n - 1) * sum(d.values())) if len(d) > 1 else 0.0 for v, d in far.items()}
    paths = {}
    for v in vertices:
        paths[v] = {v: 1}
        for x in sorted(far[v], key=far[v].get)[1:]:
            paths[v][x] = sum(paths[v][y] for y in far[v] if far[v][y] == far[v][x] - 1 and (min(x, y), max(x, y)) in edges)
    between = {v: sum(paths[s][v] * paths[v][t] / paths[s][t] for s in vertices for t in far[s] if s != v != t and s != t and v in far[s] and t in far[v] and far[s][v] + far[v][t] == far[s][t]) / ((n - 1) * (n - 2)) for v in vertices}
    inverse = [1 / d for x in far.values() for d in x.values() if d]
    rows = n * 5
    assert len(centrality.source_blocks(g, rows=rows)) == 2
    assert {r["id"]: r["closeness"] for r in centrality.closeness(g, rows=rows).collect()} == pytest.approx(close)
    assert {r["id"]: r["betweenness"] for r in centrality.betweenness(g, rows=rows).collect()} == pytest.approx(between)
    assert resilience.global_efficiency(g, denominator="all", rows=rows).first()[0] == pytest.approx(sum(inverse) / (n * (n - 1)))
    g.unpersist()


def test_hops_along_a_chain(spark):
    """A frontier that doesn't grow takes several levels a job; limits hold all the same."""
    g = Graph.undirected(spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    ends = spark.createDataFrame([(0,), (11,)], "id long")
    got = {(r["landmark"], r["id"]): r["distance"] for r in iterate.hops(g, ends, most=7).collect()}
    assert got == {(s, v): abs(s - v) for s in (0, 11) for v in range(31) if abs(s - v) <= 7}


def test_numbered(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    got = numbered(rows, F.desc("g"), "k").collect()
    want = sorted(((r["g"], r["k"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert sorted((r["place"], r["g"], r["k"]) for r in got) == [(i + 1, g, k) for i, (g, k) in enumerate(want)]
    assert numbered(rows.limit(0), "k").count() == 0
    ranks = centrality.ranked(rows.select(F.col("k").alias("id"), F.col("k").alias("score")), "score").collect()
    assert {r["id"]: (r["rank"], r["decile"]) for r in ranks} == {k: (1000 - k, (999 - k) // 100 + 1) for k in range(1000)}


def test_empty_graph(spark):
    g = Graph.undirected(spark.createDataFrame([(1, 1)], "src long, dst long"))
    assert forest.separation(g).count() == 0
    assert resilience.attack_curve(g, resilience.random_order(g)).count() == 1 and resilience.global_efficiency(g).first()[0] == 0.0


def test_motifs(spark):
    """Any pattern, with absent edges, loops and one vertex under two names, against all namings."""
    from itertools import product

    edges = {(1, 2), (2, 1), (2, 3), (3, 1), (3, 3), (3, 4), (4, 2)}
    frame = spark.createDataFrame([*edges, (1, 2)], "src long, dst long")
    for pattern, absent, different in [([("a", "b"), ("b", "c")], [("a", "c")], False), ([("c", "d"), ("a", "b"), ("b", "c")], [("d", "a")], True), ([("a", "b"), ("b", "a")], [], False), ([("a", "a"), ("a", "b")], [("b", "b")], False)]:
        names = sorted({x for e in pattern for x in e})
        want = []
        for found in product(range(1, 5), repeat=len(names)):
            of = dict(zip(names, found, strict=True))
            if all((of[a], of[b]) in edges for a, b in pattern) and not any((of[a], of[b]) in edges for a, b in absent) and (not different or len(set(found)) == len(found)):
                want.append(found)
        got = motif(frame, pattern, absent, different=different)
        assert got.columns == names and sorted(tuple(r) for r in got.collect()) == want and want
    for bad in ([("a", "b"), ("c", "d")], []):
        with pytest.raises(ValueError):
            motif(frame, bad)
    with pytest.raises(ValueError):
        motif(frame, [("a", "b")], [("a", "z")])
