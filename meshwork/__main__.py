"""python -m meshwork EDGES [--output-dir DIR] [--skip STEPS]: the graph pipeline over an edge list, plain or gzipped."""

from __future__ import annotations

import argparse
import json

from meshwork.plans.pipeline import analyse, export
from meshwork.session import session
from meshwork.sources.edges import discover, load_graph


def main() -> None:
    p = argparse.ArgumentParser(prog="meshwork", description=__doc__)
    p.add_argument("edges", help="an edge list, or a folder whose smallest data file is taken")
    p.add_argument("--output-dir", default="")
    p.add_argument("--skip", default="", help="steps to leave out, comma-separated: label_propagation, triangle_count, connected_components, shortest_paths")
    a = p.parse_args()
    spark = session("meshwork", partitions=32)
    path = discover(spark, a.edges) or a.edges
    g = load_graph(spark, path).persist()
    out = analyse(g, skipped=frozenset(filter(None, a.skip.split(","))))
    if a.output_dir:
        export(spark, out, a.output_dir)
    print(json.dumps({"metrics": out.metrics, "seconds": out.seconds}))


if __name__ == "__main__":
    main()
