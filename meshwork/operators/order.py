"""Places in a global order, without one task that sorts all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.store import cut

#: The number of rows that a partition can have in monotonically_increasing_id.
_ROWS = 33


def numbered(df: DataFrame, *by: str | Column, name: str = "place") -> DataFrame:
    """``df`` with its place from 1 in the order of ``by``, gapless; rows that agree in all of ``by`` have any order.

    Rows are dealt out by ranges, sorted within them and written with their place
    there; the ranges' row counts, one for each, give the offsets. Make ``by``
    unique where one value may hold many rows: a range can't split a value.
    """
    at = F.col("__at")
    sorted_ = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    counts = sorted_.groupBy(F.shiftright(at, _ROWS).alias("__range")).agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect()
    before = list(zip([r["__range"] for r in counts], accumulate([0, *(r["n"] for r in counts)])))  # noqa: B905
    offsets = df.sparkSession.createDataFrame(before, "__range long, __before long")
    out = sorted_.withColumn("__range", F.shiftright(at, _ROWS)).join(F.broadcast(offsets), "__range")
    return out.select(*df.columns, (at.bitwiseAND((1 << _ROWS) - 1) + F.col("__before") + 1).alias(name))
