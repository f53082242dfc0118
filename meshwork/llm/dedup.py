"""Exact deduplication by skew-safe combining of salted digest groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import ascii_lower, materialize


def sha256_hex(text: Column) -> Column:
    """The digest of a text that isn't null; said to be never null, so that no filter computes it a second time."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("norm")).withColumn("digest", digest(F.col("norm")))


def winners(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per distinct text: digest, norm, keep_id, group_size.

    Three combines, each of which compares the whole text beside its digest: the
    map side of the first aggregation merges the copies that one task holds, its
    reduce side those of one salted digest group, the second one the winners of
    the salts. A text that fills a third of all rows so reaches each reducer as
    one row per map task at most, and the last one as ``salts`` rows.
    """
    salted = (
        _rows(docs, id_col, text_col, digest)
        .groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """Every row with the decision on it: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the largest doc_id stays (a null id only where no other has the
    text). Rows that repeat one doc_id with an equal text are one document and
    share its decision. An empty table gives no rows; other columns are ignored.

    The winners are written narrow (no text). Rows find theirs by digest; only if
    two different texts share a digest do the rows of that digest join by text.
    The one join key that may be hot is that of the row side of a plain equi-join,
    which adaptive execution splits.
    """
    best = materialize(
        winners(docs, id_col=id_col, text_col=text_col, salts=salts, digest=digest).drop("norm"),
        "dedup-winners",
    )
    shared = materialize(best.groupBy("digest").count().filter("count > 1").select("digest"), "dedup-collisions")
    rows = _rows(docs, id_col, text_col, digest)
    if shared.isEmpty():
        found = rows.drop("norm").join(best, "digest")
    else:
        alone, many = best.join(shared, "digest", "left_anti"), winners(docs, id_col=id_col, text_col=text_col, salts=salts, digest=digest).join(shared, "digest", "left_semi")
        found = rows.drop("norm").join(alone, "digest").unionByName(rows.join(many, ["digest", "norm"]).drop("norm"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The documents that stay, with all their columns.

    Texts are equal as in ``duplicate_groups``, and the row with the largest id
    stays; a null id only where no other has the text. Of rows that repeat an id
    and a text one stays, whichever. An empty table gives no rows; other columns
    have any name but those that begin with two underscores.

    The winners are written narrow, without texts. Rows that repeat an id are then
    merged, on the map side first, under the same keys by which rows find their
    winners, so whole documents are shuffled once more and a hot id sends one row
    a task.
    """
    of = lambda c: {"__none": F.col(c).isNull(), "__id": F.coalesce(F.col(c).cast("string"), F.lit(""))}
    keys = ["__none", "__id", "__digest"]
    best = winners(docs, id_col=id_col, text_col=text_col, salts=salts).select("keep_id", F.col("digest").alias("__digest"))
    best = materialize(best, "dedup-winners").withColumns(of("keep_id")).select(keys).distinct()
    once = docs.withColumns({**of(id_col), "__digest": sha256_hex(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))))}).dropDuplicates(keys)
    return once.join(best, keys).select(docs.columns)  # an inner join: Catalyst would move a semi-join before the merging
