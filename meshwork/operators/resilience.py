"""Resilience: giant components, efficiency, attacks, cascades, vulnerability.

Of all steps of an attack the components are those of one spanning forest whose
edges are held back by the step that removes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.operators.centrality import PACKED, STATE_ROWS, sample
from meshwork.operators.forest import separation, spanning_forest
from meshwork.operators.graph import Graph, degrees, triangles
from meshwork.operators.iterate import connected_components
from meshwork.operators.order import numbered
from meshwork.operators.packed import indexed, listed, search, searches
from meshwork.store import Rounds, cut


def giant_component(g: Graph) -> DataFrame:
    """One row: size of the largest component, 0 for an empty graph."""
    return connected_components(g).groupBy("component").agg(F.count(F.lit(1)).alias("size")).agg(F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("giant_size"))


def global_efficiency(g: Graph, sources: DataFrame | None = None, *, denominator: str = "reachable", rows: int = STATE_ROWS) -> DataFrame:
    """One row, efficiency: the mean of 1/distance over the pairs (source, other) that are reachable, or over all.

    Sources (all by default) are searched from in blocks; a block leaves two sums.
    """
    n, total, pairs = g.vertices.count(), 0.0, 0
    graph = listed(indexed(g.vertices), g.edges.select(F.col("src").alias("at"), F.col("dst").alias("to")))
    some = cut(sources.select("id"), "sources") if sources is not None else g.vertices
    for _, found in searches(graph, some, rows * PACKED):
        total, pairs = total + sum(c / d for (_, d), c in found.items()), pairs + sum(found.values())
    k = some.count()
    per = pairs if denominator == "reachable" else k * (n - 1)
    return g.vertices.sparkSession.createDataFrame([(total / per if per else 0.0,)], "efficiency double")


def average_clustering(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """One row, clustering: the mean over the sources (all by default) with true degrees; under two neighbours it is 0."""
    t = triangles(g).join(degrees(g, "simple"), "id")
    if sources is not None:
        t = t.join(sources, "id", "left_semi")
    d = F.col("degree")
    return t.agg(F.coalesce(F.avg(F.when(d >= 2, 2.0 * F.col("triangles") / (d * (d - 1))).otherwise(0.0)), F.lit(0.0)).alias("clustering"))


def _giants(g: Graph, removal: DataFrame, steps: DataFrame) -> DataFrame:
    """step, giant, remaining: the largest component and the vertices that each of ``steps`` (step) leaves; removal: id, gone_at (first step without it).

    An edge is there until the first of its ends goes. A spanning forest that
    prefers edges that stay long has the same components as the graph at every step,
    so only its edges, fewer than vertices, are looked at step by step.
    """
    a, b = (removal.select(F.col("id").alias(c), F.col("gone_at").alias(f"g{c}")) for c in ("src", "dst"))
    forest = cut(spanning_forest(g.pairs().join(a, "src").join(b, "dst").select("src", "dst", F.least("gsrc", "gdst").alias("until")), "until"), "attack-forest")
    key = lambda c: F.struct("step", F.col(c).alias("id"))
    left = removal.join(F.broadcast(steps), F.col("step") < F.col("gone_at")).select(key("id").alias("id"))
    e = forest.join(F.broadcast(steps), F.col("step") < F.col("weight")).select(key("src").alias("src"), key("dst").alias("dst"))
    return connected_components(Graph(left, e)).groupBy(F.col("id.step").alias("step"), "component").agg(F.count(F.lit(1)).alias("size")).groupBy("step").agg(F.max("size").alias("giant"), F.sum("size").alias("remaining"))


def _removal(g: Graph, order: DataFrame, steps: int) -> tuple[DataFrame, DataFrame, int]:
    """(id and the step that removes it, all steps, number of vertices) of an attack in ``order`` (id, place from 1) in equal steps."""
    n = g.vertices.count()
    per = max(1, n // steps)
    removal = cut(order.select("id", (F.floor((F.col("place") - 1) / per) + 1).cast("int").alias("gone_at")), "attack")
    return removal, g.vertices.sparkSession.range(0, -(-n // per) + 1).select(F.col("id").cast("int").alias("step")), n


def _curve(g: Graph, removal: DataFrame, steps: DataFrame, n: int) -> DataFrame:
    out = steps.join(_giants(g, removal, steps), "step", "left").select("step", F.coalesce("remaining", F.lit(0)).cast("long").alias("remaining"), F.coalesce("giant", F.lit(0)).cast("long").alias("giant_size"))
    return out.select("step", (F.lit(n) - F.col("remaining")).cast("long").alias("removed"), "remaining", "giant_size", F.round(F.col("giant_size") / max(1, n), 4).alias("giant_share"))


def attack_curve(g: Graph, order: DataFrame, steps: int = 20) -> DataFrame:
    """step, removed, remaining, giant_size, giant_share of an attack that removes ids in ``order`` (id, place from 1), in equal steps."""
    return _curve(g, *_removal(g, order, steps))


def random_order(g: Graph, seed: int = 42) -> DataFrame:
    return numbered(g.vertices, F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), F.col("id"))


def degree_order(g: Graph) -> DataFrame:
    """Places by falling degree of the whole graph."""
    return numbered(degrees(g), F.desc("degree"), F.col("id"))


def adaptive_removal(g: Graph, steps: int = 20, stop: float = 0.8) -> DataFrame:
    """id, gone_at: each step removes those that have the highest degrees in what is left; those left past ``stop`` go a step behind the last."""
    rounds, n = Rounds(), g.vertices.count()
    per, gone, step = max(1, n // steps), 0, 0
    left, hits = g, []
    while gone <= stop * n and gone < n:
        step += 1
        placed = numbered(degrees(left, "simple"), F.desc("degree"), F.col("id")).select("id", "place")
        hit = cut(placed.filter(F.col("place") <= per).select("id", F.lit(step).alias("gone_at")), "attack-hit")
        hits.append(hit)
        keep = rounds.cut(left.vertices.join(hit, "id", "left_anti"), "attack-vertices")
        ends = [hit.select(F.col("id").alias(c)) for c in ("src", "dst")]
        left = Graph(keep, rounds.cut(left.edges.join(ends[0], "src", "left_anti").join(ends[1], "dst", "left_anti"), "attack-edges"))
        gone = min(n, gone + per)
    out = left.vertices.select("id", F.lit(step + 1).alias("gone_at"))
    for hit in hits:
        out = out.unionByName(hit)
    return out


def adaptive_attack(g: Graph, steps: int = 20, stop: float = 0.8) -> DataFrame:
    """As ``attack_curve``, but each step removes those that have the highest degrees in what is left; ends past ``stop``."""
    removal = cut(adaptive_removal(g, steps, stop), "attack")
    n, last = removal.count(), removal.agg(F.coalesce(F.max("gone_at"), F.lit(1))).first()[0]
    per = max(1, n // steps)
    past = next((k for k in range(last + 1) if min(n, k * per) > stop * n or k * per >= n), 0)
    return _curve(g, removal, removal.sparkSession.range(past + 1).select(F.col("id").cast("int").alias("step")), n)


def cascade(g: Graph, *, share: float = 0.05, slack: float = 2.0, most: int = 50, seed: int = 42, cumulative: bool = True) -> DataFrame:
    """round, new_failures, failed, giant_share, survival_rate: loads equal degrees, capacities ``slack`` times that; failed vertices pass their load on.

    Each round every failed vertex (or only the new ones) gives its load, in equal
    parts, to its neighbours that still stand. The shares are those of the largest
    component and of all vertices that stand after the round, all rounds' components
    from one forest.
    """
    rounds = Rounds()
    deg = cut(degrees(g, "simple"), "cascade")
    n = deg.count()
    first = sample(g.vertices, share=share, seed=seed).withColumn("hit", F.lit(True))
    state = rounds.cut(deg.join(first, "id", "left").select("id", F.col("degree").cast("double").alias("load"), (F.col("degree") * slack).alias("capacity"), "degree", F.when(F.col("hit"), 0).cast("int").alias("failed_at")), "cascade")
    last = 0
    for r in range(1, most + 1):
        giving = state.filter("failed_at IS NOT NULL" if cumulative else f"failed_at = {r - 1}").select(F.col("id").alias("src"), "degree")
        open_ = g.edges.join(state.filter("failed_at IS NULL").select(F.col("id").alias("dst")), "dst", "left_semi").join(giving, "src")
        parts = open_.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        got = open_.join(parts, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("degree") / F.col("n")).alias("more"))
        state = state.join(got, "id", "left").withColumn("load", F.col("load") + F.coalesce("more", F.lit(0.0))).drop("more")
        fails = F.col("failed_at").isNull() & (F.col("load") > F.col("capacity"))
        state = rounds.cut(state.withColumn("failed_at", F.when(fails, r).otherwise(F.col("failed_at"))), "cascade")
        new = state.filter(F.col("failed_at") == r).count()
        if not new:
            break
        last = r
    every = g.vertices.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("step"))
    fallen = cut(state.select("id", F.coalesce("failed_at", F.lit(last + 1)).alias("gone_at")), "cascade")
    giants = _giants(g, fallen, every)
    new = fallen.filter(F.col("gone_at") <= last).groupBy(F.col("gone_at").alias("step")).agg(F.count(F.lit(1)).alias("new_failures"))
    out = every.join(new, "step", "left").join(giants, "step", "left").select(F.col("step").alias("round"), F.coalesce("new_failures", F.lit(0)).cast("long").alias("new_failures"), (n - F.coalesce("remaining", F.lit(0))).cast("long").alias("failed"), F.coalesce("giant", F.lit(0)).alias("giant"))
    return out.select("round", "new_failures", "failed", (F.col("giant") / max(1, n)).alias("giant_share"), ((n - F.col("failed")) / max(1, n)).alias("survival_rate"))


def sample_order(step: Column, id_: Column, seed: int = 42) -> Column:
    """The place of an id in a step's sample: steps draw independently."""
    return F.md5(F.concat_ws(":", step.cast("string"), id_.cast("string"), F.lit(str(seed))))


def step_efficiency(g: Graph, removal: DataFrame, *, rows: int = 100, seed: int = 42) -> DataFrame:
    """step, efficiency: the mean of 1/distance over the pairs that each step of an attack (removal: id, gone_at) leaves reachable, from a sample of its vertices.

    All steps are searched at once: a step's sources are words of a row, which pass an
    edge until the step that removes it, so edges are there once, whatever the number
    of steps. Of n vertices that a step
    leaves, those with the ``rows`` smallest hashes are searched from (all of fewer):
    a threshold with room picks them first, so that no step's vertices are sorted.
    """
    last = removal.agg(F.coalesce(F.max("gone_at"), F.lit(0))).first()[0]
    steps = removal.sparkSession.range(0, last + 1).select(F.col("id").cast("int").alias("step"))
    left = removal.groupBy("gone_at").agg(F.count(F.lit(1)).alias("n")).collect()
    alive = {k: sum(r["n"] for r in left if r["gone_at"] > k) for k in range(last + 1)}
    # 8 * rows of n are picked about, at least rows of them but once in more than 10^100 draws; then the smallest hashes of these
    picked = removal.sparkSession.createDataFrame([(k, min(1.0, 8.0 * rows / max(1, n))) for k, n in alive.items()], "step int, share double")
    rank = sample_order(F.col("step"), F.col("id"), seed)
    near = removal.join(F.broadcast(picked), F.col("step") < F.col("gone_at")).withColumn("rank", rank).filter(F.conv(F.substring("rank", 1, 13), 16, 10).cast("double") < F.col("share") * float(16**13))
    some = near.groupBy("step").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "id"))), 1, rows).alias("some")).select("step", F.posexplode("some.id").alias("place", "id"))
    words = -(-rows // 64)
    index = indexed(removal)
    sources = some.join(index, "id").select("at", (F.col("step") * (64 * words) + F.col("place")).alias("slot"))
    a, b = (removal.select(F.col("id").alias(c), F.col("gone_at").alias(f"g{c}")) for c in ("src", "dst"))
    edges = g.edges.select("src", "dst").join(b, "dst").join(a, "src").select(F.col("src").alias("at"), F.col("dst").alias("to"), F.least("gsrc", "gdst").alias("until"))
    stops = [k for k in range(last + 1) for _ in range(words)]
    _, pairs = search(listed(index, edges), sources, stops=stops)
    sums = {k: [0.0, 0] for k in range(last + 1)}
    for (word, d), n in pairs.items():
        sums[stops[word]][0] += n / d
        sums[stops[word]][1] += n
    found = removal.sparkSession.createDataFrame([(k, total / n if n else 0.0) for k, (total, n) in sums.items()], "step int, efficiency double")
    return steps.join(found, "step", "left").select("step", F.coalesce("efficiency", F.lit(0.0)).alias("efficiency"))


def attack_efficiency(g: Graph, order: DataFrame, steps: int = 20, *, rows: int = 100, seed: int = 42) -> DataFrame:
    """``step_efficiency`` of an attack in ``order`` (id, place from 1), in equal steps."""
    removal, every, _ = _removal(g, order, steps)
    return every.join(step_efficiency(g, removal, rows=rows, seed=seed), "step", "left").select("step", F.coalesce("efficiency", F.lit(0.0)).alias("efficiency"))


def vulnerability(g: Graph, probes: DataFrame | None = None) -> DataFrame:
    """id, vulnerability = (giant component - giant component without id) / N of every vertex, or of the probes (id)."""
    return harm(cut(separation(g), "separation"), probes)


def harm(apart: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """``vulnerability`` from what each vertex's component falls into without it (``forest.separation``); other components stay."""
    n = apart.count()
    largest = [(r["component"], r["component_size"]) for r in apart.select("component", "component_size").distinct().orderBy(F.desc("component_size"), "component").limit(2).collect()]
    (first, whole), other = largest[0] if largest else (None, 0), largest[1][1] if len(largest) > 1 else 0
    rest = F.when(F.col("component") == F.lit(first), F.greatest("largest_piece", F.lit(other))).otherwise(F.lit(whole))
    out = apart if probes is None else apart.join(probes.select("id"), "id", "left_semi")
    return out.select("id", F.round((F.lit(whole) - rest) / max(1, n), 6).alias("vulnerability"))
