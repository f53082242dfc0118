"""Connected components of links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meshwork.operators.iterate import stars


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component, the smallest node that links reach, of every linked node; links of a node with itself count as none."""
    found = stars(links, a, b)
    roots = found.select("component").distinct()
    return found.unionByName(roots.selectExpr("component AS node", "component"))
