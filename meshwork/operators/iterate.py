"""Iterative graph algorithms: each round is one plan, its state a written table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph, degrees, top
from meshwork.store import Rounds, cut

#: Tables of levels that ``hops`` keeps before they join the others; levels that a job takes from a frontier that doesn't grow and has at most so many rows.
MERGE, AHEAD, FEW = 4, 4, 1_000


def pagerank(g: Graph, *, max_iter: int | None = None, tol: float | None = None, reset: float = 0.15, most: int = 200) -> DataFrame:
    """id, pagerank; ranks start at 1 and sum to the number of vertices if all have out-edges.

    Give the number of rounds, or the change of any rank below which it stops.
    """
    if (max_iter is None) == (tol is None):
        raise ValueError("give max_iter or tol")
    out = degrees(g, "out").filter("degree > 0").select(F.col("id").alias("src"), "degree")
    edges = cut(g.edges.join(out, "src"), "pagerank-edges")
    rounds, ranks = Rounds(), g.vertices.withColumn("pagerank", F.lit(1.0))
    for k in range(max_iter if max_iter is not None else most):
        sent = edges.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pagerank") / F.col("degree")).alias("got"))
        after = g.vertices.join(sent, "id", "left").select("id", (reset + (1 - reset) * F.coalesce("got", F.lit(0.0))).alias("pagerank"))
        after = rounds.cut(after, "pagerank-odd" if k % 2 else "pagerank")  # as a table its size is known, so that edges move only if ranks are many
        if tol is not None:
            change = after.join(ranks.withColumnRenamed("pagerank", "was"), "id").agg(F.max(F.abs(F.col("pagerank") - F.col("was")))).first()[0]
            if change is None or change < tol:
                return after
        ranks = after
    return ranks


def label_propagation(g: Graph, max_iter: int = 5) -> DataFrame:
    """id, label after synchronous rounds; each vertex takes its neighbours' commonest label, of several the smallest."""
    rounds, labels = Rounds(), g.vertices.withColumn("label", F.col("id"))
    for _ in range(max_iter):
        votes = g.edges.join(labels.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("won"))
        labels = rounds.cut(labels.join(best, "id", "left").select("id", F.coalesce("won", "label").alias("label")), "labels")
    return labels


def stars(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """node, component of every end of a pair that isn't its component's smallest: that smallest node.

    Alternates two star rounds until nothing changes, a logarithmic number of
    them on paths: every node hangs its larger neighbours under its smallest one,
    then its smaller neighbours and itself. Minima combine on the map side and hot
    nodes meet theirs in an equi-join, which adaptive execution splits, so no
    node's neighbours are gathered.
    """
    rounds = Rounds()
    e = rounds.cut(pairs.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "stars")
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = rounds.cut(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "stars-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = rounds.cut(small.filter("u <> v").distinct(), "stars")
        if (after := mark(e)) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after


def connected_components(g: Graph) -> DataFrame:
    """id, component: the smallest id that edges reach, whichever way they point."""
    return g.vertices.join(stars(g.edges).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def group_sizes(labels: DataFrame, label: str) -> DataFrame:
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("size"))


def size_profile(sizes: DataFrame) -> DataFrame:
    """How many groups there are, of more than ten, of one, and the largest."""
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("size") > 10).alias("over_ten"), F.count_if(F.col("size") == 1).alias("singletons"), F.max("size").alias("largest"))


def hops(g: Graph, sources: DataFrame, *, most: int | None = None, toward: bool = True, rounds: Rounds | None = None) -> DataFrame:
    """landmark, id, distance in hops for the rows (id) of ``sources``; what can't be reached is absent.

    ``toward``: from each vertex to the landmark along the edges. All landmarks
    share each round's joins. A round extends the frontier by one level, or, along
    chains, where the frontier is small and doesn't grow, by several in one job.
    With ``rounds`` a later search with the same drops this one's tables.
    """
    ends = ("dst", "src") if toward else ("src", "dst")
    step = g.edges.select(F.col(ends[0]).alias("at"), F.col(ends[1]).alias("to"))
    return _levels(step, sources.select(F.col("id").alias("landmark"), "id"), ["landmark"], most=most, rounds=rounds)


def _levels(step: DataFrame, sources: DataFrame, keys: list[str], *, most: int | None = None, open_: Column | None = None, rounds: Rounds | None = None) -> DataFrame:
    """keys, id, distance from ``sources`` (keys, id) along ``step`` (at, to); ``open_`` says with whose keys a row of step can be passed."""
    rounds, same = rounds or Rounds(), [*keys, "id"]
    seen = frontier = rounds.cut(sources.select(*same, F.lit(0).alias("distance")), "hops-seen")
    d, was, tables = 0, 0, []
    rows = frontier.count()
    while rows and (most is None or d < most):
        front, new = frontier, None
        for _ in range(min(AHEAD if rows <= min(was, FEW) else 1, AHEAD if most is None else most - d)):
            d += 1
            front = front.select(*keys, F.col("id").alias("at")).join(step, "at")
            front = (front if open_ is None else front.filter(open_)).select(*keys, F.col("to").alias("id")).distinct()
            for known in [seen, *tables]:
                front = front.join(known, same, "left_anti")
            level = front.withColumn("distance", F.lit(d))
            new = level if new is None else new.unionByName(level)
        label = f"hops-{len(tables)}"
        new = rounds.cut(new.groupBy(same).agg(F.min("distance").alias("distance")), label if len(tables) < MERGE - 1 else "hops-last")
        frontier = new.filter(F.col("distance") == d)
        tables.append(new)
        was, rows = rows, frontier.count()
        if len(tables) == MERGE and rows:
            for t in tables:
                seen = seen.unionByName(t)
            seen, tables = rounds.cut(seen, "hops-seen"), []
    for t in tables:
        seen = seen.unionByName(t)
    return seen


def far_hops(g: Graph, source: DataFrame) -> DataFrame:
    """id, distance of all that the one row (id) of ``source`` reaches in an undirected graph; for graphs of long chains.

    Vertices with two neighbours, the source aside, are passed over: every arc into
    such a chain gets the vertex at its other end and the length by pointers that
    double, so a chain costs the logarithm of its length in jobs. Distances of the
    other vertices come from rounds over these ends, those in chains from the two
    ends of their own.
    """
    rounds = Rounds()
    source = cut(source.select("id").limit(1), "far-source")
    arcs = rounds.cut(g.edges.select("src", "dst").distinct(), "far-arcs")
    inner = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n = 2").join(source, "id", "left_anti").select("id")
    inner = rounds.cut(inner.withColumn("inner", F.lit(True)), "far-inner")
    # src -> dst is an arc; it leads on to last_src -> last_dst in ``length`` steps, and is open while last_dst is inner
    mark = inner.withColumnRenamed("id", "dst")
    on = arcs.join(mark, "dst", "left").select("src", "dst", F.col("src").alias("last_src"), F.col("dst").alias("last_dst"), F.lit(1).cast("long").alias("length"), F.coalesce("inner", F.lit(False)).alias("open"))
    nexts = arcs.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    follow = on.filter("open").join(nexts, F.col("dst") == F.col("at")).filter("to <> src").join(inner.select(F.col("id").alias("to"), F.col("inner").alias("more")), "to", "left")
    on = on.filter("NOT open").unionByName(follow.select("src", "dst", F.col("at").alias("last_src"), F.col("to").alias("last_dst"), F.lit(2).cast("long").alias("length"), F.coalesce("more", F.lit(False)).alias("open")))
    on, open_ = rounds.observed(on, "far-on", F.count_if("open").alias("rows"), F.count(F.lit(1)).alias("arcs"))
    reach = 2
    while open_["rows"] and reach <= open_["arcs"]:  # what is open beyond that goes round in a ring without the source
        step = on.select(F.col("src").alias("last_src"), F.col("dst").alias("last_dst"), F.col("last_src").alias("s"), F.col("last_dst").alias("d"), (F.col("length") - 1).alias("more"), F.col("open").alias("still"))
        moved = on.filter("open").join(step, ["last_src", "last_dst"]).select("src", "dst", F.col("s").alias("last_src"), F.col("d").alias("last_dst"), (F.col("length") + F.col("more")).alias("length"), F.col("still").alias("open"))
        on, open_ = rounds.observed(on.filter("NOT open").unionByName(moved), "far-on", F.count_if("open").alias("rows"), F.count(F.lit(1)).alias("arcs"))
        reach *= 2
    on = on.filter("NOT open")
    ends = rounds.cut(on.join(inner.select(F.col("id").alias("src")), "src", "left_anti").groupBy("src", F.col("last_dst").alias("to")).agg(F.min("length").alias("length")), "far-ends")
    dist, moved = rounds.cut(source.select("id", F.lit(0).cast("long").alias("distance"), F.lit(True).alias("moved")), "far-dist"), 1
    while moved:
        sent = dist.filter("moved").join(ends, F.col("id") == F.col("src")).groupBy(F.col("to").alias("id")).agg(F.min(F.col("distance") + F.col("length")).alias("got"))
        both = dist.select("id", "distance").join(sent, "id", "full")
        dist, found = rounds.observed(both.select("id", F.least("distance", "got").alias("distance"), (F.col("distance").isNull() | (F.col("got") < F.col("distance"))).eqNullSafe(True).alias("moved")), "far-dist", F.count_if("moved").alias("rows"))
        moved = found["rows"]
    dist = dist.select("id", "distance")
    within = on.join(inner.select(F.col("id").alias("src")), "src", "left_semi").join(dist.withColumnRenamed("id", "last_dst"), "last_dst").groupBy(F.col("src").alias("id")).agg(F.min(F.col("distance") + F.col("length")).alias("distance"))
    return dist.unionByName(within).select("id", F.col("distance").cast("int").alias("distance"))


#: Words of 64 sources that one row of a packed search holds.
WORDS = 8


def reached(step: DataFrame, sources: DataFrame, keys: list[str], weight: Callable[[int], Column], *, open_: Column | None = None, rounds: Rounds | None = None) -> DataFrame:
    """keys, id, reach, total: how many of ``sources`` (keys, place from 0, id) reach an id along ``step`` (at, to), themselves aside, and the sum of ``weight(distance)`` over these.

    A search for sums alone, with all its sources at once: a source is one bit of
    the row (keys, part, id), so a level passes ``64 * WORDS`` sources along an edge
    in one row, and new bits are counted. ``open_`` as in ``_levels``.
    """
    rounds, same, words = rounds or Rounds(), [*keys, "part", "id"], range(WORDS)
    none, some = F.lit(0).cast("long"), lambda c: F.expr(" OR ".join(f"{c}{k} <> 0" for k in words))
    bits = sources.select(*keys, "id", F.expr(f"place div {64 * WORDS}").alias("part"), F.expr(f"place div 64 % {WORDS}").alias("word"), F.expr("shiftleft(1L, int(place % 64))").alias("bit"))
    first = bits.groupBy(same).agg(*[F.bit_or(F.when(F.col("word") == k, F.col("bit")).otherwise(none)).alias(f"new{k}") for k in words])
    zero = (weight(1) * 0).alias("total")
    state = rounds.cut(first.select(*same, *[f"new{k}" for k in words], *[F.col(f"new{k}").alias(f"seen{k}") for k in words], none.alias("reach"), zero), "reached")
    d, open_rows = 0, True
    while open_rows:
        d += 1
        front = state.filter(some("new")).select(*keys, "part", F.col("id").alias("at"), *[f"new{k}" for k in words]).join(step, "at")
        got = (front if open_ is None else front.filter(open_)).groupBy(*keys, "part", F.col("to").alias("id")).agg(*[F.bit_or(f"new{k}").alias(f"got{k}") for k in words])
        both = state.drop(*[f"new{k}" for k in words]).join(got, same, "full")
        seen, come = ([F.coalesce(f"{c}{k}", none) for k in words] for c in ("seen", "got"))
        new = both.select(*same, *[come[k].bitwiseAND(F.bitwise_not(seen[k])).alias(f"new{k}") for k in words], *[come[k].bitwiseOR(seen[k]).alias(f"seen{k}") for k in words], "reach", "total")
        count = sum((F.bit_count(f"new{k}") for k in words[1:]), F.bit_count("new0")).cast("long")
        new = new.withColumns({"reach": F.coalesce("reach", none) + count, "total": F.coalesce("total", zero) + count * weight(d)})
        state, found = rounds.observed(new, "reached", F.count_if(some("new")).alias("rows"))
        open_rows = found["rows"]
    return state.groupBy(*keys, "id").agg(F.sum("reach").alias("reach"), F.sum("total").alias("total"))


def landmarks(g: Graph, policy: str, k: int, ranks: DataFrame | None = None) -> DataFrame:
    """id of the k landmarks: the largest by ``degree`` or ``pagerank`` (from ``ranks``), or the ``min`` id; ties by id."""
    if policy == "degree":
        return top(degrees(g), "degree", k).select("id")
    if policy == "pagerank":
        return top(ranks if ranks is not None else pagerank(g, max_iter=5), "pagerank", k).select("id")
    return g.vertices.agg(F.min("id").alias("id"))


def distance_maps(found: DataFrame) -> DataFrame:
    """id and a map landmark -> distance."""
    return found.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("landmark", "distance")))).alias("distances"))


def path_stats(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("paths"), F.max("distance").alias("diameter"), F.avg("distance").alias("avg_distance"))


def trace(g: Graph, start: int, stop: int) -> DataFrame:
    """step, id of a shortest path in an undirected graph; of several the one with the smallest ids seen from the end. No rows without a path."""
    spark = g.vertices.sparkSession
    dist = cut(far_hops(g, g.vertices.filter(F.col("id") == start)), "trace")
    row = dist.filter(F.col("id") == stop).first()
    if row is None:
        return spark.createDataFrame([], "step int, id long")
    # each vertex's best neighbour one step nearer to the start; the walk back follows these pointers, doubling them
    near = g.edges.select(F.col("src").alias("prev"), F.col("dst").alias("id")).join(dist, "id").join(dist.select(F.col("id").alias("prev"), F.col("distance").alias("before")), "prev")
    back = near.filter("before = distance - 1").groupBy("id").agg(F.min("prev").alias("prev"))
    rounds, reach = Rounds(), 1
    on, jump = rounds.cut(dist.filter(F.col("id") == stop), "trace-on"), rounds.cut(back, "trace-jump")
    while reach <= row["distance"]:
        more = on.join(jump, "id").select(F.col("prev").alias("id"), (F.col("distance") - reach).alias("distance"))
        on = rounds.cut(on.unionByName(more), "trace-on")
        jump = rounds.cut(jump.join(jump.select(F.col("id").alias("prev"), F.col("prev").alias("far")), "prev").select("id", F.col("far").alias("prev")), "trace-jump")
        reach *= 2
    return on.select((F.col("distance") + 1).cast("int").alias("step"), "id")


def eigenvector(g: Graph, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """id, eigenvector: power iteration from 1/N, normalised each round."""
    n = g.vertices.count()
    rounds, scores = Rounds(), g.vertices.withColumn("eigenvector", F.lit(1.0 / max(1, n)))
    for k in range(max_iter):
        got = g.edges.join(scores.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("eigenvector").alias("x"))
        after, sums = rounds.observed(g.vertices.join(got, "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x")), "eigen-odd" if k % 2 else "eigen", F.sum(F.col("x") * F.col("x")).alias("square"))
        norm = (sums["square"] or 0.0) ** 0.5
        if norm == 0:
            break
        after = after.select("id", (F.col("x") / norm).alias("eigenvector"))
        done = tol and after.join(scores.withColumnRenamed("eigenvector", "was"), "id").agg(F.max(F.abs(F.col("eigenvector") - F.col("was")))).first()[0] < tol
        scores = after
        if done:
            break
    return scores


def k_core(g: Graph, most: int = 100_000) -> DataFrame:
    """id, coreness: the largest k so that k neighbours say k or more, from degrees down until stable.

    A vertex's neighbours are counted by estimate, capped at the vertex's own,
    before they are ranked, so a hub sorts as many rows as it has levels.
    """
    rounds = Rounds()
    est = rounds.cut(degrees(g, "simple").withColumnRenamed("degree", "core"), "core")
    for _ in range(most):
        near = g.edges.join(est.select(F.col("id").alias("dst"), F.col("core").alias("c")), "dst").join(est.select(F.col("id").alias("src"), "core"), "src")
        level = near.groupBy(F.col("src").alias("id"), "core", F.least("c", "core").alias("l")).agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("l")).rowsBetween(Window.unboundedPreceding, 0))
        h = level.withColumn("above", above).groupBy("id").agg(F.max(F.least("l", "above")).alias("h"))
        after = est.join(h, "id", "left").select("id", F.coalesce("h", F.lit(0)).cast("long").alias("core"), (F.coalesce("h", F.lit(0)) != F.col("core")).alias("moved"))
        after, sums = rounds.observed(after, "core", F.count_if("moved").alias("moved"))
        est = after.drop("moved")
        if not sums["moved"]:
            break
    return est.withColumnRenamed("core", "coreness")
