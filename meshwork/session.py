"""Session and engine settings."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Profile:
    """What a run does by the graph's size: thresholds may be raised, not lowered, by the environment."""

    large_vertices: int = 1_000_000
    large_edges: int = 10_000_000
    fast: bool = False

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Profile:
        env = dict(os.environ if env is None else env)
        number = lambda key, least: max(least, int(env.get(key, "") or 0))
        return Profile(number("MESHWORK_LARGE_VERTICES", 1_000_000), number("MESHWORK_LARGE_EDGES", 10_000_000), env.get("MESHWORK_FAST", "") in ("1", "true"))

    def is_large(self, vertices: int, edges: int) -> bool:
        return vertices >= self.large_vertices or edges >= self.large_edges

    def is_fast(self, vertices: int, edges: int) -> bool:
        return self.fast and self.is_large(vertices, edges)


def session(app: str = "meshwork", *, cores: int | str = "*", partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and single-node runs; a cluster brings its own settings."""
    build = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if partitions:
        build = build.config("spark.sql.shuffle.partitions", str(partitions))
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
