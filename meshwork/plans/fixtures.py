"""Graphs and transit tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph, chain
from meshwork.store import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _copurchase(spark: SparkSession, sf_dir: str, least: float | None) -> Graph:
    lines = table(spark, sf_dir, "lineitem")
    if least is not None:
        lines = lines.filter(F.col("l_quantity") >= least)
    lines = lines.select("l_orderkey", "l_partkey")
    pairs = lines.select("l_orderkey", F.col("l_partkey").alias("src")).join(lines.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey").filter("src < dst").select("src", "dst").distinct()
    pairs = cut(pairs, "copurchase")
    return Graph.undirected(pairs, dedupe=False)


def parts(spark: SparkSession, sf_dir: str) -> Graph:
    """P: parts bought in one order; dense."""
    return _copurchase(spark, sf_dir, None)


def sparse(spark: SparkSession, sf_dir: str) -> Graph:
    """Q: as P, of lines with a quantity of 45 or more."""
    return _copurchase(spark, sf_dir, 45)


def suppliers(spark: SparkSession, sf_dir: str) -> Graph:
    """H: the path through the suppliers' keys."""
    return chain(table(spark, sf_dir, "supplier"), "s_suppkey")


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, destination: the nations of customer and supplier of each line."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", F.col("n_name").alias("origin"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("destination"))
    return table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("origin", "destination")


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city, lat, lon from the nations' keys."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("city"), (12.0 + F.col("n_nationkey") * 0.37).alias("lat"), (75.0 + F.pmod(F.col("n_nationkey") * 7, F.lit(25)) * 0.21).alias("lon"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bus_id, ts, lat, lon, speed (none) from the events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("bus_id"), F.col("ts").cast("timestamp").alias("ts"), (12.0 + F.col("value") / 1000).alias("lat"), (77.0 + F.pmod("event_id", F.lit(97)) / 100).alias("lon"), F.lit(None).cast("double").alias("speed"))
