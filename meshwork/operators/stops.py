"""Stops and routes put together from what there is: catalogues, orders, names, previews, precedence of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.operators.transit import search_catalog


def stop_catalog(points: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """stop_id, stop_name, lat, lon: ``stops`` where it has rows, else each stop of the points once, numbered by first appearance.

    The numbers come from one sort of all distinct stops, a dimension table.
    """
    if stops is not None and not stops.isEmpty():
        return stops.select("stop_id", "stop_name", "lat", "lon")
    first = points.na.drop(subset=["stop", "lat", "lon"]).groupBy(F.col("stop").alias("stop_name"), "lat", "lon").agg(F.min(F.struct("route_id", "seq")).alias("at"))
    return first.select(F.row_number().over(Window.orderBy("at", "stop_name")).cast("long").alias("stop_id"), "stop_name", "lat", "lon")


def route_order(stops: DataFrame, legs: DataFrame) -> DataFrame:
    """seq, stop_id: known stops in the order in which the legs (place, src, dst) first name them, the others behind, by id.

    If the legs name fewer than two, all stand by id.
    """
    ends = legs.select(F.col("src").alias("stop_id"), (F.col("place") * 2).alias("at")).unionByName(legs.select(F.col("dst").alias("stop_id"), (F.col("place") * 2 + 1).alias("at")))
    first = ends.join(stops.select("stop_id"), "stop_id", "left_semi").groupBy("stop_id").agg(F.min("at").alias("at"))
    named = first.agg((F.count(F.lit(1)) >= 2).alias("enough"))
    both = stops.select("stop_id").distinct().join(first, "stop_id", "left").join(F.broadcast(named))
    at = F.when(F.col("enough"), F.col("at"))
    return both.select(F.row_number().over(Window.orderBy(F.asc_nulls_last(at), "stop_id")).alias("seq"), "stop_id")


def route_from_graph(stops: DataFrame, legs: DataFrame, route_id: str = "R101") -> DataFrame:
    """One route over all stops with a name and a place, in ``route_order``, called after its first and last stop."""
    rows = route_order(stops, legs).join(stops.na.drop(subset=["stop_name", "lat", "lon"]), "stop_id")
    ends = rows.agg(F.concat_ws(" -> ", F.min_by("stop_name", "seq"), F.max_by("stop_name", "seq")).alias("route_name"))
    numbered = rows.withColumn("seq", F.row_number().over(Window.orderBy("seq")))
    return numbered.join(F.broadcast(ends)).select(F.lit(route_id).alias("route_id"), "route_name", "seq", F.col("stop_name").alias("stop"), "lat", "lon", "stop_id")


def fill_route_names(points: DataFrame) -> DataFrame:
    """Blank route names, and those that repeat the id, become 'first stop -> last stop'."""
    w = Window.partitionBy("route_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    poor = F.coalesce(F.trim("route_name"), F.lit("")).isin("") | (F.col("route_name") == F.col("route_id"))
    return points.withColumn("route_name", F.when(poor, F.concat_ws(" -> ", F.first("stop").over(w), F.last("stop").over(w))).otherwise(F.col("route_name")))


def named_steps(steps: DataFrame, stops: DataFrame) -> DataFrame:
    """step, stop_name, stop_id of a path's steps; a stop without a name is 'Stop-' and its id."""
    found = steps.select(F.col("step").try_cast("int").alias("step"), F.col("stop_id").try_cast("long").alias("stop_id")).na.drop().join(stops.select("stop_id", "stop_name"), "stop_id", "left")
    return found.select("step", F.coalesce("stop_name", F.concat(F.lit("Stop-"), F.col("stop_id").cast("string"))).alias("stop_name"), "stop_id")


def first_legs(legs: DataFrame, most: int = 12) -> DataFrame:
    """step, src, dst, cost of the first legs: the preview where no path is given."""
    some = legs.orderBy("place").limit(most)
    return some.select(F.row_number().over(Window.orderBy("place")).alias("step"), "src", "dst", "cost")


def find_routes(catalog: DataFrame, token: str = "", origin: str | None = None) -> DataFrame:
    """The catalogue's rows of one origin that contain the token in name, id or destination; all rows if none do."""
    out = catalog if origin is None else catalog.filter(F.col("origin") == origin)
    if token.strip():
        out = search_catalog(out, token, ("route_name", "route_id", "destination"))
    return catalog if out.isEmpty() else out


def is_city(name: Column, city: str) -> Column:
    """Whether the whole name is the city, whatever the case."""
    return F.lower(name) == F.lit(city.lower())


def per_bus(points: DataFrame, bus: str = "bus_id", speed: str = "speed") -> DataFrame:
    return points.groupBy(bus).agg(F.count(F.lit(1)).alias("n"), F.avg(speed).alias("avg_speed"))


def dedup_counts(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: rows before and after duplicates go."""
    return table.agg(F.count(F.lit(1)).alias("rows_in")).join(F.broadcast((table.select(*keys) if keys else table).distinct().agg(F.count(F.lit(1)).alias("rows_out"))))


def prefer(*sources: DataFrame) -> DataFrame:
    """The first of several tables of one shape that has rows; the last if none has."""
    return next((t for t in sources[:-1] if not t.isEmpty()), sources[-1])


def union_typed(kinds: dict[str, DataFrame], name: str, columns: dict[str, str]) -> DataFrame:
    """Tables under one another, each with its name in a column, cast to one set of columns; what one lacks is null."""
    shaped = [t.select(F.lit(k).alias(name), *[(F.col(c).cast(t_) if c in t.columns else F.lit(None).cast(t_)).alias(c) for c, t_ in columns.items()]) for k, t in kinds.items()]
    return reduce(DataFrame.unionByName, shaped)
