"""Intermediate tables: written once in the folder that the cluster shares, read back without lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_own: dict[str, str] = {}

#: With this setting a write's shuffle files go once the table is there; else those of all rounds stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode, where that is unset (tests), one made for this application."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", ""):
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    if sc.applicationId not in _own:
        made = tempfile.mkdtemp(prefix="meshwork-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own[sc.applicationId] = f"file://{made}"
    return _own[sc.applicationId]


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` as a written table: cuts the lineage of a loop, and survives lost executors."""
    return _written(df, label)[0]


class Rounds:
    """The tables of a loop: once a round's table is written, that of the round before under its label goes."""

    def __init__(self) -> None:
        self._last: dict[str, str] = {}

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        out, path = _written(df, label)
        self._drop(df.sparkSession, self._last.get(label))
        self._last[label] = path
        return out

    def observed(self, df: DataFrame, label: str, *of: Column) -> tuple[DataFrame, dict]:
        """As ``cut``, and the values of the aggregates ``of`` over the rows, from the table.

        Not by an ``Observation``: a session that has had one can't be serialised any
        more, and models of ``pyspark.ml`` that hold a summary carry their session.
        """
        out = self.cut(df, label)
        return out, out.agg(*of).first().asDict()

    def drop(self, spark: SparkSession, *labels: str) -> None:
        """Deletes the tables of these labels, once nothing reads them."""
        for label in labels:
            self._drop(spark, self._last.pop(label, None))

    @staticmethod
    def _drop(spark: SparkSession, path: str | None) -> None:
        if path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
