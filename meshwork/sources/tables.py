"""Tables by name, previews, and raw CSV files brought to typed Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.sources.edges import read_table

#: The raw tables, to be replaced by a caller whose files are named otherwise: file, the columns that must be there, and the types of those that aren't text.
RAW: dict[str, tuple[str, list[str], dict[str, str]]] = {
    "stops": ("stops.csv", ["stop_id", "stop_name"], {"stop_id": "long", "latitude": "double", "longitude": "double"}),
    "routes": ("routes.csv", [], {}),
    "gps": ("gps.csv", [], {}),
    "weather": ("weather.csv", [], {}),
    "schedule": ("schedule.csv", [], {}),
    "capacity": ("capacity.csv", [], {}),
}


def _readable(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def find_table(spark: SparkSession, name: str, *folders: str) -> DataFrame | None:
    """The CSV of that name, a file or Spark's folder of parts, in the first folder that has one."""
    for folder in folders:
        for path in (f"{folder}/{name}.csv", f"{folder}/{name}"):
            if _readable(spark, path):
                return read_table(spark, path)
    return None


def first_rows(table: DataFrame, n: int = 10) -> DataFrame:
    return table.limit(n)


def cleaned(table: DataFrame, required: list[str], types: dict[str, str]) -> DataFrame:
    """Rows once, without those that lack a required column; values that don't fit their type become null."""
    out = table.distinct().na.drop(subset=required) if required else table.distinct()
    return out.withColumns({c: F.col(c).cast("string").try_cast(t) for c, t in types.items() if c in out.columns})


def to_parquet(spark: SparkSession, raw: str, processed: str, tables: dict[str, tuple[str, list[str], dict[str, str]]] | None = None) -> dict[str, int]:
    """Writes each raw CSV, cleaned, as Parquet below ``processed``; returns the rows of each. Files that are missing are left out."""
    rows = {}
    for name, (file, required, types) in (tables or RAW).items():
        if not _readable(spark, f"{raw}/{file}"):
            continue
        cleaned(spark.read.option("header", True).csv(f"{raw}/{file}"), required, types).write.mode("overwrite").parquet(f"{processed}/{name}")
        rows[name] = spark.read.parquet(f"{processed}/{name}").count()
    return rows
