"""The graph pipeline over an edge-list file: load, analyse, export."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators import graph, iterate
from meshwork.operators.graph import Graph
from meshwork.session import Profile
from meshwork.sources import sinks
from meshwork.store import cut


@dataclass(frozen=True)
class Outcome:
    """Tables of a run; a step that a fast run of a large graph leaves out has none."""

    graph: Graph
    ranks: DataFrame
    communities: DataFrame | None
    triangles: DataFrame | None
    components: DataFrame | None
    distances: DataFrame | None
    degrees: DataFrame
    metrics: dict[str, object]
    seconds: dict[str, float]


STEPS = ("label_propagation", "triangle_count", "connected_components", "shortest_paths")


def analyse(g: Graph, profile: Profile | None = None, *, skipped: frozenset[str] = frozenset()) -> Outcome:
    """Runs the six algorithms in order, each timed around its written table, but for the ``skipped`` ones of STEPS."""
    if unknown := skipped - {*STEPS}:
        raise ValueError(f"no such step: {', '.join(sorted(unknown))}")
    profile, seconds, values = profile or Profile.from_env(), {}, {}

    def timed(name: str, run):
        began = time.time()
        out = run()
        seconds[name] = round(time.time() - began, 4)
        return out

    size = timed("graph_loading", lambda: graph.summary(g).first())
    values |= {"nodes": size["nodes"], "edges": size["edges"], "density": size["density"]}
    fast = profile.is_fast(size["nodes"], size["edges"])
    skip = lambda name, run: None if fast or name in skipped else timed(name, run)
    ranks = timed("pagerank", lambda: cut(iterate.pagerank(g, max_iter=2 if fast else 5), "ranks"))
    communities = skip("label_propagation", lambda: iterate.label_propagation(g, 5))
    triangles = skip("triangle_count", lambda: cut(graph.triangles(g), "triangles"))
    components = skip("connected_components", lambda: cut(iterate.connected_components(g), "components"))
    degrees = timed("degree_analysis", lambda: cut(graph.degrees(g), "degrees"))
    distances = skip("shortest_paths", lambda: cut(iterate.hops(g, iterate.landmarks(g, "degree", 3)), "distances"))
    stats = graph.degree_stats(degrees).first()
    values |= {"avg_degree": stats["avg_degree"], "max_degree": stats["max_degree"]}
    values["triangles"] = graph.triangle_total(triangles).first()[0] if triangles is not None else None
    values["communities"] = communities.select("label").distinct().count() if communities is not None else None
    values["components"] = components.select("component").distinct().count() if components is not None else None
    return Outcome(g, ranks, communities, triangles, components, distances, degrees, values, seconds)


def export(spark: SparkSession, out: Outcome, folder: str) -> None:
    """The result folders, the summary and the timings as CSV; a placeholder where a step was left out."""
    none = sinks.placeholder(spark, ["id", "result"], "fast" if out.triangles is None and out.communities is None else "asked")
    if None not in (out.triangles, out.communities, out.components):
        sinks.bundle(folder, ranks=out.ranks, communities=out.communities, triangles=out.triangles, components=out.components, degrees=out.degrees)
    else:
        sinks.write_csv(graph.top(out.ranks, "pagerank", 100), f"{folder}/pagerank_top100")
        sinks.write_csv(out.degrees, f"{folder}/degrees")
        sizes = lambda c: c.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component")
        for name, found, shown in (("communities", out.communities, lambda x: x), ("triangles_top100", out.triangles, lambda x: graph.top(x, "triangles", 100)), ("component_sizes", out.components, sizes)):
            sinks.write_csv(none if found is None else shown(found), f"{folder}/{name}")
    sinks.write_csv(sinks.metrics(spark, out.metrics), f"{folder}/summary")
    sinks.write_csv(spark.createDataFrame(list(out.seconds.items()), "algorithm string, seconds double"), f"{folder}/timings")
