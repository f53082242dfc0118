"""Whole-number clustering against a plain version, and on hard rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.llm import kmeans

SCHEMA = "vec_id long, embedding array<float>, cluster int, id int, q int"


def plain(rows, rounds=10, k=8):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(place(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centroids)]
    found = [(i, *place(v)[::-1]) for i, v in kept]
    total = {n: sum(d for _, m, d in found if m == n) for n in range(k)}
    return sorted(((i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in found), key=str)


def vectors(n, seed=1, spread=1.0):
    rng = random.Random(seed)
    heart = [[rng.uniform(-spread, spread) for _ in range(64)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(heart)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, 7, 7) for i, v in rows], SCHEMA)


def test_like_a_plain_version(spark):
    rows = vectors(300)
    rows += [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [0.5] * 65), (1004, [float("nan")] + [0.1] * 63), (1005, [float("inf")] * 64), (1006, [None] + [0.1] * 63)]
    rows += [(1007, [0.25] * 64)] * 3 + [(1008, [0.25] * 64), (None, [0.125] * 64), (5, [0.0] * 64), (1009, [-0.0001] * 64)]
    got = kmeans.cluster(frame(spark, rows))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("rows", [[(i, [float(i % 3)] * 64) for i in range(40)], vectors(5), [(1, [1.0] * 64)] * 9], ids=["ties", "few", "one"])
def test_ties_and_few(spark, rows):
    """Centroids that start equal: the first takes all, the others stay where they are, without vectors."""
    assert sorted((tuple(r) for r in kmeans.cluster(frame(spark, rows)).collect()), key=str) == plain(rows)


def test_empty(spark):
    none = kmeans.cluster(frame(spark, []))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert kmeans.cluster(frame(spark, [(1, [1.0])])).count() == 0


def test_large_components(spark):
    """Beyond 2**27 components are held, so that distances fit."""
    rows = [(i, [1e30 * (-1) ** i] * 64) for i in range(12)] + [(i, [float(i)] * 64) for i in range(12, 20)]
    got = kmeans.cluster(frame(spark, rows), rounds=2).collect()
    assert len(got) == 20 and all(0 <= r["distance"] for r in got)
    assert kmeans.quantised(frame(spark, rows), id_col="vec_id", vector_col="embedding").agg(F.max(F.array_max("q"))).first()[0] == 1 << 27


def test_search_is_exact():
    rng = np.random.default_rng(3)
    for dims in (8, 64):
        q, c = rng.integers(-3, 4, (500, dims)), rng.integers(-3, 4, (8, dims))
        c[5] = c[2]
        order = np.argsort(-q.var(axis=0), kind="stable")
        number, best = kmeans.nearest(q, c, order)
        far = ((q[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (best == far.min(axis=1)).all() and (number == far.argmin(axis=1)).all()
