"""Headline queries over the part co-purchase graph; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meshwork.operators import graph, iterate
from meshwork.plans import fixtures
from meshwork.session import session


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else None, memory="12g")
    took: dict[str, float] = {}

    def timed(name: str, run):
        began = time.time()
        out = run()
        took[name] = round(time.time() - began, 3)
        return out

    def load():
        g = fixtures.parts(spark, sf).persist()
        g.edges.count(), g.vertices.count()
        return g

    g = timed("graph_loading", load)
    done = lambda df: df.write.format("noop").mode("overwrite").save()
    timed("pagerank_5", lambda: done(iterate.pagerank(g, max_iter=5)))
    timed("label_propagation_5", lambda: done(iterate.label_propagation(g, 5)))
    timed("triangle_count", lambda: graph.triangle_total(graph.triangles(g)).collect())
    timed("connected_components", lambda: done(iterate.connected_components(g)))
    timed("degree_analysis", lambda: graph.degree_stats(graph.degrees(g)).collect())
    timed("shortest_paths_3", lambda: done(iterate.hops(g, iterate.landmarks(g, "degree", 3))))
    print(json.dumps({"metric": "graph_suite_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
