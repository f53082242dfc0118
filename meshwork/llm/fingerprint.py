"""Document fingerprints: sketches of all shingle hashes below a fixed fraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.common import ascii_lower, materialize

WORDS = 5
#: Shingles whose 32-bit hash is under 2**32 / KEEP stay in the sketch.
KEEP = 4

_BLANK = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often the body's lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column) -> Column:
    """The sorted distinct 32-bit hashes of the text's five-word shingles that are below the fraction.

    Fewer than five words are one shingle; without words the sketch is empty. If
    no hash is below the fraction the smallest one stays, so every text with words
    has a sketch. Case of A-Z and white space don't count.
    """
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BLANK), lambda w: w != "")

    def hashes(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(h) - (WORDS - 1)), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(h, i, WORDS)), 32))
        return F.when(F.size(h) >= WORDS, runs).when(F.size(h) > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 32))).otherwise(F.array().cast("array<bigint>"))

    def kept(s: Column) -> Column:
        low = F.filter(s, lambda x: x < (1 << 32) // KEEP)
        return F.when(F.size(s) == 0, s).otherwise(_let(low, lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x))).otherwise(F.array(F.array_min(s)))))

    return _let(_let(F.transform(words, lambda w: F.xxhash64(w)), hashes), kept)


def text_of(sketched: Column) -> Column:
    """The fingerprint as text: eight hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketched, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts put together, without the shingles across their border."""
    return _let(F.array_distinct(F.concat(a, b)), lambda x: _let(F.filter(x, lambda h: h < (1 << 32) // KEEP), lambda low: F.when(F.size(low) > 0, F.array_sort(low)).when(F.size(x) > 0, F.array(F.array_min(x))).otherwise(x)))


def contained(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has; of an empty one 1 in an empty one, else 0."""
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """The containment of the text with fewer shingles in the other one, 0 to 1."""
    return F.when(F.size(a) <= F.size(b), contained(a, b)).otherwise(contained(b, a))


_NONE = -(1 << 63)
#: Copies of one row that a task writes out on its own; those of larger groups are dealt in chunks of as many.
COPIES = 4096


def _previous(keys: DataFrame) -> DataFrame:
    """To each (key, crc, sha, n_chars, copies), in descending key, the one before it; to the first the last.

    Keys are dealt by range, each range looks back within itself, and its first
    key takes the last of the range before, from a table of one row a range.
    """
    dealt = keys.repartitionByRange(F.desc("key"), F.asc("crc"), F.asc("sha")).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "fingerprint-keys")
    here = F.struct("key", "sha", "n_chars")
    tails = dealt.groupBy("part").agg(F.max_by(here, F.struct(F.bitwise_not("key"), F.col("crc"), F.col("sha"))).alias("tail"))
    by_part = Window.orderBy("part")
    tails = tails.select("part", F.coalesce(F.lag("tail").over(by_part), F.last("tail").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("tail"))
    within = Window.partitionBy("part").orderBy(F.desc("key"), F.asc("crc"), F.asc("sha"))
    before = dealt.withColumn("before", F.lag(here).over(within)).join(F.broadcast(tails), "part")
    return before.select("key", "sha", "n_chars", "copies", F.coalesce("before", "tail").alias("before"))


def _texts(base: DataFrame) -> DataFrame:
    """key, sha, text, sk: each text of an id once, with its sketch in 32-bit numbers."""
    return base.groupBy("key", "sha").agg(F.min("text").alias("text")).withColumn("sk", F.transform(sketch(F.col("text")), lambda x: (x - (1 << 31)).cast("int")))


def _head(text: str, n_chars: str) -> Column:
    """What a text lends to one of ``n_chars`` code points: as many of its first as that has in a third."""
    return F.substring(text, F.lit(1), F.floor(F.col(n_chars) / 3).cast("int"))


def _sketched(own: DataFrame) -> DataFrame:
    """The columns of the result and ``copies`` from key, text, n_chars, sk, copies and lent, next_sk, next_id."""
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")), F.col("lent"))
    both = own.select(F.nullif(F.col("key"), F.lit(_NONE)).alias("doc_id"), "n_chars", "next_id", "copies", _unsigned("sk").alias("sk"), _unsigned("next_sk").alias("next_sk"), edited.alias("edited"))
    both = both.select("doc_id", "n_chars", "next_id", "copies", "sk", "next_sk", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sk"))
    near = (likeness(F.col("sk"), F.col("edited_sk")).alias("near_edited"), likeness(F.col("sk"), F.col("next_sk")).alias("near_next"))
    return both.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("sk")).alias("fingerprint"), text_of(F.col("edited_sk")).alias("edited_fingerprint"), *near, "next_id", "copies")


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as its ``copies`` says."""
    return rows.withColumn("copies", F.explode(F.expr("sequence(1L, copies)"))).drop("copies")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id of every row.

    The edited text has the last third of the code points replaced by the first as
    many (or all) of the next document's, in descending doc_id; after the last
    comes the first, and rows of one id stand in the order of their texts'
    checksums, without an id last. Ids are whole numbers. Null counts as empty. A
    single document is its own next one; an empty table gives no rows; other
    columns are ignored. Texts of any length are sketched whole.

    Rows that repeat an id and a text have one answer but for the last of them, as
    the others are followed by their like: they are merged, on the map side first,
    and written out again, large groups in chunks that are dealt to all tasks.

    Texts are shuffled once; what a document lends to the one before it, a prefix
    and its sketch, once more. Only Spark's own functions run.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select(F.coalesce("doc_id", F.lit(_NONE)).alias("key"), "text", F.coalesce(F.sha2("text", 256), F.lit("")).alias("sha"))
    narrow = base.select("key", "sha", F.crc32(F.col("text").cast("binary")).alias("crc"), F.char_length("text").cast("long").alias("n_chars"))
    before = _previous(narrow.groupBy("key", "crc", "sha", "n_chars").agg(F.count(F.lit(1)).alias("copies")))
    own = _texts(base).join(before, ["key", "sha"])
    next_id = F.nullif(F.col("key"), F.lit(_NONE)).alias("next_id")
    lent = own.select(F.col("before.key").alias("key"), F.col("before.sha").alias("sha"), _head("text", "before.n_chars").alias("lent"), F.col("sk").alias("next_sk"), next_id)
    both = own.join(lent, ["key", "sha"])
    last = F.struct("lent", "next_sk", "next_id", F.lit(1).cast("long").alias("copies"))
    like = F.struct(_head("text", "n_chars").alias("lent"), F.col("sk").alias("next_sk"), next_id, (F.col("copies") - 1).alias("copies"))
    ways = F.when(F.col("copies").between(2, COPIES), F.array(last, like)).otherwise(F.array(last))
    out = _repeated(_sketched(both.select("key", "text", "n_chars", "sk", F.explode(ways).alias("way")).select("key", "text", "n_chars", "sk", "way.*")))
    large = materialize(before.filter(F.col("copies") > COPIES).select("key", "sha", "n_chars", "copies"), "fingerprint-large")
    if large.isEmpty():
        return out
    most = _texts(base.join(large.select("key", "sha"), ["key", "sha"], "left_semi")).join(large, ["key", "sha"])
    most = _sketched(most.select("key", "text", "n_chars", "sk", _head("text", "n_chars").alias("lent"), F.col("sk").alias("next_sk"), next_id, (F.col("copies") - 1).alias("copies")))
    most = materialize(most, "fingerprint-copies").withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    most = most.withColumn("copies", F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("chunk") * COPIES))
    return out.unionByName(_repeated(most.repartition("doc_id", "edited_sha256", "chunk").drop("chunk")))


def _unsigned(name: str) -> Column:
    return F.transform(F.col(name), lambda x: x.cast("bigint") + (1 << 31))
