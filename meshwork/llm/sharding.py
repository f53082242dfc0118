"""Sharding through fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.llm.common import materialize

SLOTS = 4096


def virtual_slot(doc_id: str, crc: str, slots: int = SLOTS) -> Column:
    """The record's slot by its id and its text's checksum, the same at every size and shard count: a repeated id spreads by its texts."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.col(crc)), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Slot number -> shard. Edited only by ``rebalance`` and ``grow``, each of which gives the next version."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @staticmethod
    def fresh(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, shards, tuple(s % shards for s in range(slots)))

    def loads(self, weights: list[int]) -> list[int]:
        total = [0] * self.shards
        for slot, shard in enumerate(self.owner):
            total[shard] += weights[slot]
        return total

    def rebalance(self, weights: list[int]) -> SlotMap:
        """Moves or swaps slots between the fullest and the emptiest shard while that brings them closer."""
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(self.owner):
            bisect.insort(held[shard], (weights[slot], slot))
        load = self.loads(weights)
        for _ in range(4 * len(self.owner)):
            high, low = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = load[high] - load[low]
            best: tuple[int, tuple[int, int] | None, tuple[int, int] | None] = (0, None, None)
            for back in [None, *held[low]]:  # what comes back in exchange, if anything
                want = gap / 2 + (back[0] if back else 0)
                i = bisect.bisect_left(held[high], (want, -1))
                for give in held[high][max(0, i - 1) : i + 1]:
                    moved = give[0] - (back[0] if back else 0)
                    if 0 < moved < gap and min(moved, gap - moved) > best[0]:
                        best = (min(moved, gap - moved), give, back)
            if best[1] is None:
                break
            for a, b, item in ((high, low, best[1]), (low, high, best[2])):
                if item:
                    held[a].remove(item)
                    bisect.insort(held[b], item)
                    load[a] -= item[0]
                    load[b] += item[0]
        owner = list(self.owner)
        for shard, items in enumerate(held):
            for _, slot in items:
                owner[slot] = shard
        return SlotMap(self.version + 1, self.shards, tuple(owner))

    def grow(self, weights: list[int]) -> SlotMap:
        """One more shard, which takes slots from the fullest shards; no slot moves between the old ones."""
        owner, load, goal = list(self.owner), [*self.loads(weights), 0], sum(weights) / (self.shards + 1)
        for slot in sorted(range(len(owner)), key=lambda s: (-weights[s], s)):
            if load[-1] + weights[slot] <= goal and load[owner[slot]] - weights[slot] >= goal * 0.99:
                load[owner[slot]] -= weights[slot]
                load[-1] += weights[slot]
                owner[slot] = self.shards
        return SlotMap(self.version + 1, self.shards + 1, tuple(owner))

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table at ``path``: version, slots, shards, virtual_slot, shard.

        A version that is there already is refused; one that a lost driver left
        unfinished is written over.
        """
        if self.version in SlotMap.versions(spark, path):
            raise ValueError(f"version {self.version} of the slot map is stored already")
        rows = spark.range(1).select(F.lit(len(self.owner)).alias("slots"), F.lit(self.shards).alias("shards"), F.posexplode(F.expr(f"array({','.join(map(str, self.owner))})")).alias("virtual_slot", "shard"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @staticmethod
    def stored(spark: SparkSession, path: str) -> DataFrame | None:
        """All rows of the table at ``path``, unfinished versions among them; none where there is no table."""
        try:
            found = spark.read.schema("slots int, shards int, virtual_slot int, shard int").parquet(path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return found if "version" in found.columns else None

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """The versions that have all of their slots, oldest first."""
        found = SlotMap.stored(spark, path)
        if found is None:
            return []
        whole = found.groupBy("version").agg(F.countDistinct("virtual_slot").alias("n"), F.max("slots").alias("slots")).filter("n = slots")
        return sorted(int(r["version"]) for r in whole.select("version").collect())  # one row a version

    @staticmethod
    def table(spark: SparkSession, path: str, version: int) -> DataFrame:
        """virtual_slot, shard of one stored version."""
        return spark.read.parquet(f"{path}/version={version}").select("virtual_slot", "shard")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SlotMap | None:
        """The newest finished version in the table at ``path``; none where there is none."""
        known = SlotMap.versions(spark, path)
        if not known:
            return None
        rows = SlotMap.stored(spark, path).filter(F.col("version") == known[-1]).orderBy("virtual_slot").collect()  # one row a slot
        return SlotMap(known[-1], rows[0]["shards"], tuple(r["shard"] for r in rows))


def records(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8; a null text has none), text_crc32, virtual_slot."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    out = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return out.withColumn("virtual_slot", virtual_slot("doc_id", "text_crc32", slots))


def slot_weights(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot. At most ``slots`` rows reach the driver, whatever the input."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect():
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["size"], r["rows"]
    return size, count


def assign(docs: DataFrame, shards: int, store: str, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """Puts every document into a shard so that the shards hold nearly equal bytes; returns the rows and the map's version.

    Records hash into ``slots`` virtual slots. The newest version of the map from
    slots to shards in the table at ``store``, or a fresh one where there is none
    of as many slots and shards, is rebalanced by the bytes measured in each slot;
    if that moves any slot the outcome is stored as the next version. Rows take
    their shard from the stored table. They come back with shard and slot, their
    place in the shard (from 0, gapless): rows are numbered within their virtual
    slot, and the slots of a shard stand behind each other, so no task sees more
    than one slot at once.

    Null texts have size 8; texts of any length count whole; repeated rows are
    separate records; rows that repeat an id spread by their texts; an empty table
    gives no rows; other columns are ignored. Only Spark's own functions touch the
    rows.
    """
    spark = docs.sparkSession
    rows = materialize(records(docs, id_col=id_col, text_col=text_col, slots=slots), "shard-records")
    size, count = slot_weights(rows, slots)
    known = SlotMap.load(spark, store)
    if known is None or (known.shards, len(known.owner)) != (shards, slots):
        known = SlotMap((known.version if known else 0) + 1, shards, SlotMap.fresh(shards, slots).owner)
        known.save(spark, store)
    edited = known.rebalance(size)
    if edited.owner == known.owner:
        edited = known
    else:
        edited.save(spark, store)
    # slots, and so the rows that are broadcast, are as many as ``slots`` says
    filled = spark.range(1).select(F.posexplode(F.expr(f"array({','.join(f'{n}L' for n in count)})")).alias("virtual_slot", "rows"))
    behind = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = SlotMap.table(spark, store, edited.version).join(filled, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(behind), F.lit(0)).alias("start"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(within) - 1).join(F.broadcast(places), "virtual_slot")
    return placed.withColumn("slot", F.col("start") + F.col("place")).drop("start", "place"), edited
