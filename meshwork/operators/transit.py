"""Transit analytics: names and columns, routes, positions, traffic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions import scalars as S
from meshwork.operators.graph import Graph
from meshwork.operators.order import numbered
from meshwork.operators.iterate import connected_components, far_hops, pagerank

#: Other names of the columns that tables are brought to.
GPS_ALIASES = {"id": "bus_id", "timestamp": "ts", "time": "ts", "latitude": "lat", "longitude": "lon", "lng": "lon", "speed_kmh": "speed"}
STOP_ALIASES = {"id": "stop_id", "name": "stop_name", "stop": "stop_name", "latitude": "lat", "longitude": "lon", "lng": "lon"}
ROUTE_ALIASES = {"route": "route_id", "sequence": "seq", "stop_name": "stop", "latitude": "lat", "longitude": "lon", "lng": "lon"}


def normalize(df: DataFrame, aliases: dict[str, str], required: dict[str, str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Columns lower-cased, trimmed, renamed by ``aliases`` and cast to ``required`` (name -> type); bad values become null.

    A required column without a default that is missing gives the empty table of
    the required columns. The first of several columns that come to one name counts.
    """
    found: dict[str, str] = {}
    for c in df.columns:
        name = c.strip().lower()
        found.setdefault(aliases.get(name, name), c)
    defaults = defaults or {}
    if any(c not in found and c not in defaults for c in required):
        return df.sparkSession.createDataFrame([], ", ".join(f"{c} {t}" for c, t in required.items()))
    return df.select(*[(F.col(f"`{found[c]}`").cast("string").try_cast(t) if c in found else defaults[c].cast(t)).alias(c) for c, t in required.items()])


def normalize_gps(df: DataFrame) -> DataFrame:
    """bus_id, ts, lat, lon, speed: missing speeds come from the way to the point before, clipped to 0..110; what stays unknown goes."""
    base = normalize(df, GPS_ALIASES, {"bus_id": "string", "ts": "timestamp", "lat": "double", "lon": "double", "speed": "double"}, {"speed": F.lit(None)})
    return derive_speed(base.na.drop(subset=["bus_id", "ts", "lat", "lon"]))


def derive_speed(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("bus_id").orderBy("ts", "lat", "lon")
    hours = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 3.6e9
    km = S.haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    own = F.coalesce("speed", F.when(hours > 0, km / hours))
    return points.withColumn("speed", S.clip(own, 0.0, 110.0)).filter("speed IS NOT NULL")


def _with_places(df: DataFrame, aliases: dict[str, str], column: str) -> DataFrame:
    """``df`` with __n, its rows' places as they were read, if it has no ``column``."""
    names = {c.strip().lower() for c in df.columns}
    if column in {aliases.get(c, c) for c in names}:
        return df.withColumn("__n", F.lit(None).cast("long"))
    return numbered(df.withColumn("__row", F.monotonically_increasing_id()), "__row", name="__n")


def normalize_stops(df: DataFrame) -> DataFrame:
    """stop_id, stop_name, lat, lon; without ids, the rows' places."""
    df = _with_places(df, STOP_ALIASES, "stop_id")
    out = normalize(df, STOP_ALIASES, {"stop_id": "long", "stop_name": "string", "lat": "double", "lon": "double"}, {"stop_id": F.col("__n"), "stop_name": F.lit(None)})
    return out.withColumn("stop_name", F.coalesce(F.nullif(F.trim("stop_name"), F.lit("")), F.concat(F.lit("Stop-"), F.col("stop_id").cast("string")))).na.drop(subset=["stop_id", "lat", "lon"])


def normalize_routes(df: DataFrame) -> DataFrame:
    """route_id, seq, stop, lat, lon, trip_count; without a sequence, the rows' places."""
    df = _with_places(df, ROUTE_ALIASES, "seq")
    base = {"route_id": F.lit("R101"), "seq": F.col("__n"), "stop": F.lit(None), "trip_count": F.lit(1)}
    out = normalize(df, ROUTE_ALIASES, {"route_id": "string", "seq": "int", "stop": "string", "lat": "double", "lon": "double", "trip_count": "long"}, base)
    return placeholder_route(out.na.drop(subset=["lat", "lon"]))


def normalize_paths(df: DataFrame) -> DataFrame:
    """src, dst, distance (hops), cost: without a cost the hops, without hops 0."""
    out = normalize(df, {"source": "src", "origin": "src", "target": "dst", "destination": "dst", "hops": "distance", "weight": "cost"}, {"src": "string", "dst": "string", "distance": "int", "cost": "double"}, {"distance": F.lit(0), "cost": F.lit(None)})
    return out.na.drop(subset=["src", "dst"]).withColumn("cost", F.coalesce("cost", F.col("distance").cast("double")))


def normalize_ranks(df: DataFrame) -> DataFrame:
    """id, pagerank: rows without either go."""
    return normalize(df, {"stop_id": "id", "node": "id", "vertex": "id", "rank": "pagerank", "score": "pagerank"}, {"id": "string", "pagerank": "double"}).na.drop()


def normalize_predictions(df: DataFrame) -> DataFrame:
    """u, v, probability (held in 0 to 1): rows without ends or a number go."""
    out = normalize(df, {"src": "u", "source": "u", "dst": "v", "target": "v", "score": "probability", "prob": "probability"}, {"u": "string", "v": "string", "probability": "double"}).na.drop()
    return out.withColumn("probability", S.clip(F.col("probability"), 0.0, 1.0))


def placeholder_route(routes: DataFrame) -> DataFrame:
    """If all rows have one route id and it begins with 'route', it becomes R101."""
    one = routes.agg((F.countDistinct("route_id") == 1).alias("one"))
    return routes.join(F.broadcast(one)).withColumn("route_id", F.when(F.col("one") & F.lower("route_id").startswith("route"), "R101").otherwise(F.col("route_id"))).drop("one")


def dedupe(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def od_routes(trips: DataFrame) -> DataFrame:
    """route_id, route_name, origin, destination, trip_count of trips (origin, destination): names of two signs or more, ends that differ."""
    ok = trips.filter((F.length(F.trim("origin")) >= 2) & (F.length(F.trim("destination")) >= 2) & (F.col("origin") != F.col("destination")))
    name = F.concat_ws(" -> ", "origin", "destination")
    return ok.groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("trip_count")).select(S.route_id(name).alias("route_id"), name.alias("route_name"), "origin", "destination", "trip_count")


def control_point(a_lat, a_lon, b_lat, b_lon, index) -> tuple[Column, Column]:
    """The middle of the way, moved to one side, alternating by index, by a share of the distance."""
    dlat, dlon = b_lat - a_lat, b_lon - a_lon
    length = F.sqrt(dlat * dlat + dlon * dlon)
    offset = S.clip(0.12 * length, 0.05, 0.35) * F.when(index % 2 == 0, 1.0).otherwise(-1.0)
    unit = lambda x: F.coalesce(F.try_divide(x, F.nullif(length, F.lit(0.0))), F.lit(0.0))
    return (a_lat + b_lat) / 2 - unit(dlon) * offset, (a_lon + b_lon) / 2 + unit(dlat) * offset


def od_polylines(routes: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, skipped): three points a route whose ends have coordinates (city, lat, lon), and the routes that lack one."""
    at = lambda c, p: places.select(F.col("city").alias(c), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    known = routes.join(at("origin", "a"), "origin").join(at("destination", "b"), "destination")
    skipped = routes.join(known.select("route_id"), "route_id", "left_anti")
    known = known.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("trip_count"), "route_name")))
    mlat, mlon = control_point(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"), F.col("idx"))
    point = lambda k, stop, lat, lon: F.struct(F.lit(k).alias("seq"), stop.alias("stop"), lat.alias("lat"), lon.alias("lon"))
    rows = F.array(point(1, F.col("origin"), F.col("a_lat"), F.col("a_lon")), point(2, F.concat_ws(" ", "origin", "destination", F.lit("corridor")), mlat, mlon), point(3, F.col("destination"), F.col("b_lat"), F.col("b_lon")))
    points = known.select("route_id", "route_name", "trip_count", "idx", F.explode(rows).alias("p")).select("route_id", "route_name", "trip_count", F.col("p.seq").alias("seq"), F.col("p.stop").alias("stop"), F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"), (F.col("idx") * 10 + F.col("p.seq")).cast("long").alias("stop_id"))
    return points, skipped


def synthesize_coordinates(pairs: DataFrame, known: DataFrame, *, rounds: int = 3, spread: float = 0.18) -> DataFrame:
    """city, lat, lon: places without coordinates get their neighbours' mean, moved a little by a hash of the name."""
    both = pairs.select(F.col("origin").alias("city"), F.col("destination").alias("near")).union(pairs.select("destination", "origin")).distinct()
    out = known.select("city", "lat", "lon")
    part = lambda k: F.conv(F.substring(F.sha1("city"), k, 4), 16, 10).cast("double") / 65535 - 0.5
    for _ in range(rounds):
        new = both.join(out.select("city"), "city", "left_anti").join(out.withColumnRenamed("city", "near"), "near").groupBy("city").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
        out = out.unionByName(new.select("city", (F.col("lat") + part(1) * spread).alias("lat"), (F.col("lon") + part(5) * spread).alias("lon")))
    return out


def route_catalog(points: DataFrame) -> DataFrame:
    """route_id, origin, destination, stops, trip_count: first and last stop in order."""
    return points.groupBy("route_id").agg(F.min_by("stop", "seq").alias("origin"), F.max_by("stop", "seq").alias("destination"), F.count(F.lit(1)).alias("stops"), F.min_by("trip_count", "seq").alias("trip_count"))


def search_catalog(catalog: DataFrame, token: str, columns: tuple[str, ...] = ("route_id", "origin", "destination")) -> DataFrame:
    """Rows one of whose columns contains the token, whatever the case."""
    return catalog.filter(reduce(lambda a, b: a | b, [F.lower(c).contains(token.strip().lower()) for c in columns]))


def good_route_name(x: Column) -> Column:
    return (F.length(x) >= 7) & ~x.rlike(r"->\s*[A-Za-z]\.?$")


def _ring(points: DataFrame, loop: bool) -> DataFrame:
    """Each point with the next one (nlat, nlon); the last with the first in a loop, else with none."""
    w = Window.partitionBy("route_id").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) if loop else F.lead(c).over(w)
    return points.withColumns({"nlat": after("lat"), "nlon": after("lon"), "place": F.row_number().over(w) - 1})


def route_distance(points: DataFrame, loop: bool = False) -> DataFrame:
    km = S.haversine_km(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))
    return _ring(points, loop).groupBy("route_id").agg(F.round(F.coalesce(F.sum(km), F.lit(0.0)), 4).alias("distance_km"))


def interpolate(points: DataFrame, n: int, loop: bool = False) -> DataFrame:
    """route_id, place, k, lat, lon: n points from each stop towards the next, the stop included, the next not; the last stop of an open route ends it."""
    rows = _ring(points, loop).select("route_id", "place", "lat", "lon", F.coalesce("nlat", "lat").alias("nlat"), F.coalesce("nlon", "lon").alias("nlon"), F.explode(F.sequence(F.lit(0), F.when(F.col("nlat").isNull(), 0).otherwise(n - 1))).alias("k"))
    t = F.col("k") / n
    return rows.select("route_id", "place", "k", (F.col("lat") + (F.col("nlat") - F.col("lat")) * t).alias("lat"), (F.col("lon") + (F.col("nlon") - F.col("lon")) * t).alias("lon"))


def circular_slice(points: DataFrame, start: int, count: int) -> DataFrame:
    """``count`` points of each route from place ``start`` on, round and round: new seq, lat, lon."""
    w = Window.partitionBy("route_id")
    n = points.withColumn("place", F.row_number().over(w.orderBy("seq")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return n.withColumn("seq", F.pmod(F.col("place") - start, F.col("n")).cast("int") + 1).filter(F.col("seq") <= count).select("route_id", "seq", "stop", "lat", "lon")


def additional_routes(stops: DataFrame, routes: int = 4, window: int = 8) -> DataFrame:
    """route_id, seq, stop_id: circular windows over the ordered stops, shorter by one each time, odd ones backwards. For a dimension table."""
    w = Window.orderBy("stop_id")
    s = stops.select("stop_id", (F.row_number().over(w) - 1).alias("place"))
    n = stops.agg(F.count(F.lit(1)).alias("n"))
    wanted = F.broadcast(stops.sparkSession.range(routes).select(F.col("id").cast("int").alias("r")))
    rows = n.join(wanted).select("r", "n", F.greatest(F.lit(2), F.lit(window) - F.col("r")).alias("size")).select("r", "n", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("k"))
    rows = rows.withColumn("place", F.pmod(F.col("r") * window + F.when(F.col("r") % 2 == 1, F.col("size") - 1 - F.col("k")).otherwise(F.col("k")), F.col("n")))
    return rows.join(s, "place").select(F.concat(F.lit("X"), (F.col("r") + 1).cast("string")).alias("route_id"), (F.col("k") + 1).alias("seq"), "stop_id")


def segments(points: DataFrame, frame: int = 0, loop: bool = False) -> DataFrame:
    """route_id, segment, wave, traffic of each way between two stops."""
    wave = S.traffic_wave(frame, F.col("place"))
    return _ring(points, loop).filter("nlat IS NOT NULL").select("route_id", F.col("place").alias("segment"), F.round(wave, 6).alias("wave"), S.traffic_class(wave).alias("traffic"))


def bus_count(trips: int) -> int:
    return max(4, min(16, max(6, trips + 2)))


def bus_states(routes: DataFrame, buses: int, frame: int = 0) -> DataFrame:
    """route_id, bus, progress, speed, delay, status of ``buses`` buses on each route."""
    one = F.broadcast(routes.sparkSession.range(buses).select(F.col("id").cast("int").alias("bus")))
    wave = S.traffic_wave(frame, F.col("bus"))
    delay = F.greatest(F.lit(0.0), 16 * (wave - 0.48))
    status = F.when(delay >= 4, "Delayed").when(delay >= 1.5, "Moderate").otherwise("On Time")
    return routes.select("route_id").distinct().join(one).select("route_id", "bus", F.pmod(F.col("bus") / buses + F.lit(frame / 100.0), F.lit(1.0)).alias("progress"), F.round(20 + 36 * (1 - wave), 6).alias("speed"), F.round(delay, 6).alias("delay"), status.alias("status"))


def fleet_split(routes: DataFrame, fleet: int) -> DataFrame:
    """route_id, buses, first_bus: the fleet in equal parts, the rest one by one to the first ids. For a dimension table."""
    w = Window.orderBy("route_id")
    n = routes.agg(F.count(F.lit(1)).alias("n"))
    rows = routes.select("route_id", F.row_number().over(w).alias("i")).join(F.broadcast(n))
    rows = rows.withColumn("buses", (F.floor(F.lit(fleet) / F.col("n")) + (F.col("i") <= fleet % F.col("n")).cast("int")).cast("long"))
    return rows.select("route_id", "buses", (F.coalesce(F.sum("buses").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("long").alias("first_bus"))


def route_layer(points: DataFrame, chosen: str | None = None) -> DataFrame:
    """route_id, path [[lon, lat]...], width, colour of each route, the chosen one in front."""
    path = F.transform(F.sort_array(F.collect_list(F.struct("seq", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    hit = F.col("route_id").eqNullSafe(F.lit(chosen))
    return points.groupBy("route_id").agg(path.alias("path")).select("route_id", "path", F.when(hit, 8).otherwise(4).alias("width"), F.when(hit, "#ff7f0e").otherwise("#1f77b4").alias("colour"))


def skyline(points: DataFrame, density: int = 1) -> DataFrame:
    """route_id, seq, k, lat, lon, height: eight columns around each point."""
    rows = points.select("route_id", "seq", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(8 * density - 1))).alias("k"))
    angle = 2 * F.pi() * F.col("k") / (8 * density)
    return rows.select("route_id", "seq", "k", (F.col("lat") + 0.004 * F.sin(angle)).alias("lat"), (F.col("lon") + 0.004 * F.cos(angle)).alias("lon"), (20 + F.pmod(F.col("seq") * 37 + F.col("k") * 11, F.lit(60))).alias("height"))


def hourly(points: DataFrame, ts: str = "ts", value: str = "speed") -> DataFrame:
    return points.groupBy(F.hour(ts).alias("hour")).agg(F.avg(value).alias("avg_value"), F.count(F.lit(1)).alias("n"))


def bands(points: DataFrame, value: str = "speed") -> DataFrame:
    """band, n: all bands, empty ones too."""
    names = points.sparkSession.createDataFrame([(i, b) for i, b in enumerate(S.band_names())], "place int, band string")
    found = points.groupBy(S.speed_band(F.col(value)).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(found, "band", "left").select("place", "band", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def shares(points: DataFrame, value: str = "speed", slow: float = 20.0) -> DataFrame:
    v = F.col(value)
    return points.agg(F.avg(v).alias("avg_value"), (F.avg(F.when(v < slow, 1.0).otherwise(0.0)) * 100).alias("slow_share"), F.count_if(v >= 40).alias("low_traffic"), F.count_if((v >= 20) & (v < 40)).alias("medium_traffic"), F.count_if(v < 20).alias("high_traffic"))


def heat_weight(value: Column) -> Column:
    return 65 - S.clip(F.coalesce(value, F.lit(45.0)), 0.0, 65.0) + 1


def latest(points: DataFrame, key: str, ts: str, k: int = 50) -> DataFrame:
    """The k newest rows."""
    return points.orderBy(F.desc(ts), F.asc(key)).limit(k)


def latest_per(points: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    return points.groupBy(key).agg(F.max(ts).alias(ts), F.max_by(value, ts).alias(value))


def map_view(points: DataFrame) -> DataFrame:
    """lat, lon of the middle and the zoom that shows the span."""
    out = points.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")).alias("span"))
    zoom = F.when(F.col("span") > 4, 6).when(F.col("span") > 2, 7).when(F.col("span") > 1, 8).when(F.col("span") > 0.5, 9).when(F.col("span") > 0.2, 10).otherwise(11)
    return out.select("lat", "lon", "span", zoom.alias("zoom"))


def route_analysis(g: Graph, start=None, rounds: int = 5) -> DataFrame:
    """stop_id, pagerank, component_id, distance_from_source (null if it can't be reached); the source is the least id unless given."""
    source = g.vertices.agg(F.min("id").alias("id")) if not start or start <= 0 else g.vertices.filter(F.col("id") == start)
    dist = far_hops(g, source).withColumnRenamed("distance", "distance_from_source")
    return pagerank(g, max_iter=rounds).join(connected_components(g), "id", "left").join(dist, "id", "left").select(F.col("id").alias("stop_id"), "pagerank", F.col("component").alias("component_id"), "distance_from_source")


def hubs(ranks: DataFrame, stops: DataFrame, k: int = 10) -> DataFrame:
    """The k stops of the highest rank with their names, Stop-<id> where unknown."""
    best = ranks.orderBy(F.desc("pagerank"), "id").limit(k)
    return best.join(stops.select(F.col("stop_id").alias("id"), "stop_name"), "id", "left").select(F.col("id").alias("stop_id"), F.coalesce("stop_name", F.concat(F.lit("Stop-"), F.col("id").cast("string"))).alias("stop_name"), F.round("pagerank", 6).alias("rank_score"))


def demo_gps(spark, buses: int = 18, samples: int = 18) -> DataFrame:
    """bus_id, ts, lat, lon, speed, status: made positions, five minutes apart."""
    k, b = (F.col("id") % samples).cast("int"), F.floor(F.col("id") / samples).cast("int")
    speed = S.clip(36 + 18 * F.sin(k / 3.0 + b), 18.0, 54.0)
    return spark.range(buses * samples).select(F.format_string("BUS-%03d", b + 1).alias("bus_id"), F.timestamp_seconds(F.lit(1704067200) + k * 300).alias("ts"), (12.9 + 0.01 * b + 0.002 * k).alias("lat"), (77.5 + 0.008 * b + 0.003 * k).alias("lon"), F.round(speed, 2).alias("speed"), F.when(speed < 24, "delayed").otherwise("on_time").alias("status"))


def shift_minutes(start: Column, stop: Column) -> Column:
    """Minutes between two times of day 'HH:mm'; a shift that ends before it begins runs over midnight."""
    minutes = lambda t: F.get(F.split(t, ":"), F.lit(0)).try_cast("int") * 60 + F.get(F.split(t, ":"), F.lit(1)).try_cast("int")
    return F.pmod(minutes(stop) - minutes(start), F.lit(1440))
