"""Shared pieces of the training-data operators: tables, text normalisation, samples, bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.store import cut as materialize

__all__ = ["LOWER", "UPPER", "arrow_map", "ascii_lower", "id_crc", "materialize", "materialize_filtered", "picked", "slices", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of a batch that goes to Python, and of the rows that become Python objects at once.
BATCH_BYTES, SLICE_BYTES = 8 << 20, 2 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

#: Spark's Bloom filters of the side of a join that is shuffled, at any size of it; 8 bits each for four million keys.
FILTERS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": str(1 << 25),
}


def materialize_filtered(df: DataFrame, label: str) -> DataFrame:
    """As ``materialize``, with FILTERS set while it is planned: rows whose key a filtered side of a join lacks mostly aren't shuffled."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in FILTERS}
    try:
        for k, v in FILTERS.items():
            conf.set(k, v)
        return materialize(df, label)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def id_crc(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def picked(share: float, *columns: str) -> Column:
    """Whether a hash of the columns falls into a share of all 63-bit numbers: no share above 0 is too small to pick any."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("picked"), *columns), 1) < F.lit(min((1 << 63) - 1, int(share * (1 << 63))))


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``df.mapInArrow``; the session's bound on the bytes of a batch becomes BATCH_BYTES where it is Spark's own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and ``most`` bytes of texts (one row at least), so that Python holds few at once."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right"))
            end = min(batch.num_rows, at + rows, max(at + 1, fits))
            yield batch.slice(at, end - at)
            at = end
