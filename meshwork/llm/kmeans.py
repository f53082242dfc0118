"""Centroid clustering in whole numbers: partial-distance search, dimensions of high variance first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import arrow_map, materialize, slices

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Scaled components stay within this, so that a distance fits 64 bits.
REACH = 1 << 27
#: Dimensions that are added between two looks at the best distance.
STEP = 8


def quantised(vectors: DataFrame, *, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """id and q, floor(scale * x) of each component, of the vectors of ``dims`` finite components."""
    x = F.col("__x")
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    whole = F.transform(x, lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(float(REACH))), F.lit(float(-REACH)))).cast("int"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("__x"))
    return rows.filter((F.size(x) == dims) & finite).select("id", whole.alias("q"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims).astype(np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (of equally near ones the first) and its squared distance.

    All centroids get the sum over the first dimensions of ``order``; the one that
    leads there is finished. The others go on while they are not above the best
    distance; those that come to the end replace it if nearer, or as near and
    before it.
    """
    q, c = q[:, order], centroids[:, order]
    part = np.stack([((q[:, :STEP] - x[:STEP]) ** 2).sum(axis=1) for x in c], axis=1)
    lead = part.argmin(axis=1)
    best = part[np.arange(len(q)), lead] + ((q[:, STEP:] - c[lead, STEP:]) ** 2).sum(axis=1)
    number = lead.copy()
    for k in range(len(c)):
        rows = np.flatnonzero((lead != k) & (part[:, k] <= best))
        total = part[rows, k]
        for at in range(STEP, q.shape[1], STEP):
            if not len(rows):
                break
            total = total + ((q[rows, at : at + STEP] - c[k, at : at + STEP]) ** 2).sum(axis=1)
            live = total <= best[rows]
            rows, total = rows[live], total[live]
        won = (total < best[rows]) | (k < number[rows])
        best[rows[won]], number[rows[won]] = total[won], k
    return number, best


def _order(table: DataFrame, dims: int) -> np.ndarray:
    """The dimensions by falling variance; it decides only how soon centroids are given up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, s2 = 0, np.zeros(dims), np.zeros(dims)
        for batch in slices(batches, 4096):
            q = _matrix(batch.column(0), dims).astype(np.float64)
            n, s, s2 = n + len(q), s + q.sum(axis=0), s2 + (q * q).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(np.full(dims, n), pa.int64()), pa.array(s), pa.array(s2)], names=["dim", "n", "s", "s2"])

    rows = arrow_map(table.select("q"), run, "dim int, n long, s double, s2 double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")).collect()
    spread = {r["dim"]: r["s2"] / max(1, r["n"]) - (r["s"] / max(1, r["n"])) ** 2 for r in rows}
    return np.array(sorted(range(dims), key=lambda d: (-spread.get(d, 0.0), d)))


def _sums(table: DataFrame, centroids: np.ndarray, order: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid with vectors their number and componentwise sum; a task sends one row a centroid and dimension."""
    shared = table.sparkSession.sparkContext.broadcast((centroids, order))
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in slices(batches, 4096):
            q = _matrix(batch.column(0), dims)
            number, _ = nearest(q, *shared.value)
            count += np.bincount(number, minlength=k)
            for x in np.unique(number):
                total[x] += q[number == x].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), dims), pa.int32()), pa.array(np.tile(np.arange(dims), k), pa.int32()), pa.array(np.repeat(count, dims)), pa.array(total.ravel())], names=["cluster", "dim", "n", "total"])

    rows = arrow_map(table.select("q"), run, "cluster int, dim int, n long, total long").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    shared.unpersist()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r["cluster"], r["dim"])):
        if r["n"]:
            out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["total"]))
    return out


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept.

    Kept are vectors of ``dims`` components, none null, NaN or infinite; their
    components become floor(scale * x), held within 2**27 either way so that a
    distance fits 64 bits. Centroids start as the ``k`` vectors whose sha256 of
    ``seed:id`` is smallest in hexadecimal (a null id counts as the empty text;
    rows that repeat an id come by their components), or as all of fewer. A round
    assigns every vector to the nearest centroid, of equally near ones the first,
    and moves centroids to the floor of their mean; those without vectors stay.
    Rows that repeat count each. An empty table, or one without kept vectors,
    gives no rows; other columns are ignored. Inertia beyond 64 bits is null.

    The vectors are written once, as whole numbers; the driver holds k centroids.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_col]
    table = materialize(quantised(vectors, id_col=id_col, vector_col=vector_col, dims=dims, scale=scale), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = table.select(digest.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(len(first), dims)
    schema = f"id {kind}, cluster int, distance long"
    last = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], f"{schema}, {last.partition(', ')[2]}").withColumnRenamed("id", id_col)
    order = _order(table, dims)
    for _ in range(rounds):
        for x, (n, total) in _sums(table, centroids, order).items():
            centroids[x] = [t // n for t in total]
    shared = spark.sparkContext.broadcast((centroids, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            number, best = nearest(_matrix(batch.column(1), dims), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(best, pa.int64())], names=["id", "cluster", "distance"])

    placed = materialize(arrow_map(table, run, schema), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(x, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[x].tolist())).encode()).hexdigest()) for x, s in sums.items()]
    return placed.join(F.broadcast(spark.createDataFrame(rows, last)), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
