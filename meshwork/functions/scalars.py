"""Column functions: names, numbers, geography, colours, comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def slugify(x: Column, mark: str = "-") -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", mark), F.lit(mark))


def dataset_slug(path: Column) -> Column:
    """The file's name without folders and data extensions, as a slug."""
    return slugify(F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(\.(txt|csv|tsv))?(\.gz)?$", ""))


def dataset_title(path: Column) -> Column:
    return F.initcap(F.replace(dataset_slug(path), F.lit("-"), F.lit(" ")))


def location_name(x: Column) -> Column:
    """Brackets, signs and trailing numbers removed, blanks squeezed, in title case."""
    x = F.regexp_replace(x, r"[\(\[].*?[\)\]]", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"[_./]+", " "), r"-\s*\d+\s*$", "")
    return F.initcap(F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))


def route_ends(name: Column) -> tuple[Column, Column]:
    """What stands before and after the first '->'."""
    return F.trim(F.get(F.split(name, "->", 2), F.lit(0))), F.trim(F.get(F.split(name, "->", 2), F.lit(1)))


def route_id(name: Column) -> Column:
    return F.concat(F.lit("OD-"), F.upper(F.substring(F.sha1(name), 1, 8)))


def digits(x: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit("")), F.lit("999999999999")).cast("long")


def with_separators(x: Column, places: int = 2) -> Column:
    """1234.50 -> 1,234.5."""
    return F.regexp_replace(F.format_number(x, places), r"(\.\d*?)0+$|\.0*$", "$1")


def to_number(x: Column) -> Column:
    return F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double")


def seconds_text(x: Column) -> Column:
    return F.concat(F.format_string("%.2f", x), F.lit(" s"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def clip(x: Column, low: float, high: float) -> Column:
    """Between the bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


#: The colours of communities, in order.
PALETTE = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf", "#aec7e8", "#ffbb78", "#98df8a", "#ff9896", "#c5b0d5", "#c49c94", "#f7b6d2", "#c7c7c7", "#dbdb8d", "#9edae5")


def colour(community: Column) -> Column:
    return F.get(F.array(*map(F.lit, PALETTE)), F.pmod(community, F.lit(len(PALETTE))).cast("int"))


def rgb(colour: Column) -> Column:
    part = lambda k: F.conv(F.substring(colour, k, 2), 16, 10).cast("int")
    return F.array(part(2), part(4), part(6))


def values_match(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """True, false, or null where one is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= tolerance)


def speed_band(x: Column, edges: tuple[float, ...] = (0, 10, 20, 30, 40, 50, 60, 80, 120)) -> Column:
    """'low-high', closed on the right, the first on both sides; null outside."""
    out = F.when((x >= edges[0]) & (x <= edges[1]), f"{edges[0]:g}-{edges[1]:g}")
    for low, high in zip(edges[1:], edges[2:], strict=False):
        out = out.when((x > low) & (x <= high), f"{low:g}-{high:g}")
    return out


def band_names(edges: tuple[float, ...] = (0, 10, 20, 30, 40, 50, 60, 80, 120)) -> list[str]:
    return [f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:], strict=False)]


def traffic_wave(frame: int, segment: Column) -> Column:
    return (F.sin(F.lit(frame / 7.0) + 0.95 * segment) + 1) / 2


def traffic_class(wave: Column) -> Column:
    return F.when(wave < 0.35, "Low").when(wave < 0.7, "Medium").otherwise("High")
