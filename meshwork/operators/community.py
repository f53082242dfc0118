"""Communities: quality, profiles, bridges, similarity, and local moving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph, degrees
from meshwork.store import cut


def _labelled(g: Graph, of: DataFrame) -> DataFrame:
    """src, dst, cs, cd; of: id, community."""
    a, b = (of.select(F.col("id").alias(e), F.col("community").alias(c)) for e, c in (("src", "cs"), ("dst", "cd")))
    return g.edges.join(a, "src").join(b, "dst")


def modularity(g: Graph, of: DataFrame, *, edges_only: bool = False) -> DataFrame:
    """One row, modularity. ``edges_only`` sums the expected share over the edges inside communities only, else it is Newman's."""
    m2 = g.edges.agg(F.count(F.lit(1)).cast("double").alias("m2"))
    deg = degrees(g, "simple")
    inside = _labelled(g, of).filter("cs = cd")
    if edges_only:
        a, b = (deg.select(F.col("id").alias(e), F.col("degree").alias(f"d{e}")) for e in ("src", "dst"))
        part = inside.join(a, "src").join(b, "dst").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dsrc") * F.col("ddst")).alias("dd"))
        return part.join(F.broadcast(m2)).select(F.coalesce((F.col("n") - F.col("dd") / F.col("m2")) / F.col("m2"), F.lit(0.0)).alias("modularity"))
    n = inside.groupBy(F.col("cs").alias("community")).agg(F.count(F.lit(1)).alias("n"))
    tot = deg.join(of, "id").groupBy("community").agg(F.sum("degree").alias("d"))
    q = F.coalesce("n", F.lit(0)) / F.col("m2") - (F.col("d") / F.col("m2")) * (F.col("d") / F.col("m2"))
    return tot.join(n, "community", "left").join(F.broadcast(m2)).agg(F.coalesce(F.sum(q), F.lit(0.0)).alias("modularity"))


def members(of: DataFrame) -> DataFrame:
    """community and its sorted members. A list a community: for reports on small ones."""
    return of.groupBy("community").agg(F.sort_array(F.collect_list("id")).alias("members"))


def profile(g: Graph, of: DataFrame) -> DataFrame:
    """Size, internal and external edges, density, degrees, coverage and conductance of each community.

    external_edges is halved as the profile's users expect; external_edges_raw and
    the conductance count each outgoing edge once.
    """
    e = _labelled(g, of).groupBy(F.col("cs").alias("community")).agg(F.count_if(F.col("cs") == F.col("cd")).alias("in2"), F.count_if(F.col("cs") != F.col("cd")).alias("out"))
    d = degrees(g, "simple").join(of, "id").groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.avg("degree").alias("avg"), F.max("degree").alias("max_degree"))
    total = g.edges.agg((F.count(F.lit(1)) / 2).alias("m"))
    n, internal, out = F.col("size"), F.coalesce("in2", F.lit(0)) / 2, F.coalesce("out", F.lit(0))
    return d.join(e, "community", "left").join(F.broadcast(total)).select(
        "community",
        "size",
        internal.cast("long").alias("internal_edges"),
        F.floor(out / 2).cast("long").alias("external_edges"),
        out.cast("long").alias("external_edges_raw"),
        F.round(F.coalesce(F.try_divide(2 * internal, n * (n - 1)), F.lit(0.0)), 4).alias("density"),
        F.round("avg", 2).alias("avg_degree"),
        "max_degree",
        F.round(F.coalesce(F.try_divide(internal, F.col("m")), F.lit(0.0)), 4).alias("coverage"),
        F.round(F.coalesce(F.try_divide(out.cast("double"), 2 * internal + out), F.lit(0.0)), 4).alias("conductance"),
    )


def bridges(g: Graph, of: DataFrame) -> DataFrame:
    """id, community, bridge_score (number of other communities among the neighbours), and these, sorted."""
    foreign = _labelled(g, of).filter("cs <> cd").groupBy(F.col("src").alias("id"), F.col("cs").alias("community"))
    return foreign.agg(F.countDistinct("cd").alias("bridge_score"), F.array_sort(F.collect_set("cd")).alias("connects_to"))


def similarity(g: Graph, of: DataFrame, k: int = 20) -> DataFrame:
    """Pairs of the k largest communities with the Jaccard index of their neighbour communities, where above 0."""
    sizes = of.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community").limit(k)
    near = _labelled(g, of).filter("cs <> cd").select(F.col("cs").alias("community"), F.col("cd").alias("other")).distinct().join(sizes.select("community"), "community", "left_semi")
    n = near.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    a, b = (near.select(F.col("community").alias(c), "other").join(n.select(F.col("community").alias(c), F.col("n").alias(f"n_{c}")), c) for c in ("a", "b"))
    both = a.join(b, "other").filter("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("i"))
    return both.select(F.col("a").alias("community_a"), F.col("b").alias("community_b"), F.round(F.col("i") / (F.col("n_a") + F.col("n_b") - F.col("i")), 4).alias("jaccard"))


def local_moving(g: Graph, passes: int = 10) -> DataFrame:
    """id, community: vertices move to the neighbouring community of the largest gain, while modularity rises.

    All vertices of one parity (by hash) move at once, then those of the other, so
    that two neighbours don't swap for ever. A pass that lowers Newman's
    modularity is undone and ends the search. Super-vertices aren't formed.
    """
    m2 = float(g.edges.count())
    deg = cut(degrees(g, "simple"), "louvain-degrees")
    of = cut(g.vertices.withColumn("community", F.col("id")), "louvain")
    if not m2:
        return of
    best = modularity(g, of).first()[0]
    for p in range(passes):
        after = of
        for parity in (0, 1):
            tot = after.join(deg, "id").groupBy("community").agg(F.sum("degree").alias("tot"))
            links = g.edges.join(after.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.count(F.lit(1)).alias("k_in"))
            own = after.join(deg, "id").select("id", F.col("community").alias("own"), "degree")
            options = links.join(own, "id").join(tot, "community").withColumn("tot", F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("degree")).otherwise(0))
            gain = F.col("k_in") - F.col("tot") * F.col("degree") / m2
            options = options.withColumn("gain", gain)
            stay = options.filter("community = own").select("id", F.col("gain").alias("stay"))
            moved = options.groupBy("id").agg(F.max(F.struct("gain", -F.col("community"))).alias("b")).join(stay, "id", "left")
            moved = moved.filter((F.pmod(F.xxhash64("id", F.lit(p)), F.lit(2)) == parity) & (F.col("b.gain") > F.greatest(F.coalesce("stay", F.lit(0.0)), F.lit(0.0))))
            moved = moved.select("id", (-F.col("b.col2")).alias("to"))
            after = cut(after.join(moved, "id", "left").select("id", F.coalesce("to", "community").alias("community")), "louvain")
        q = modularity(g, after).first()[0]
        if q <= best + 1e-9:
            break
        of, best = after, q
    return of
