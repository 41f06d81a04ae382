"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into thousands of virtual slots by their text, so that equal texts share a slot. Bytes are summed per slot, and a
map assigns slots to shards of nearly equal bytes. Later data only edits that map: a rebalance moves single slots and stores
the result as the next version, so most records stay where they are.

A record's slot depends on its text alone, unless its group of equal texts has more bytes than a shard's fair share: such a group can't
be kept together with shards nearly equal, and its records hash by text and id into all slots. All other groups stay together.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, slim, unsigned_crc32

SLOTS = 8192


@dataclass
class SlotMap:
    """Which shard each virtual slot belongs to, and how many bytes it held when the version was made."""

    version: int
    shards: int
    shard_of: list[int]
    bytes_of: list[int] = field(default_factory=list)

    @classmethod
    def balanced(cls, bytes_of: list[int], shards: int) -> SlotMap:
        """Largest slot first onto the lightest shard; ties to the lower number."""
        heap, shard_of = [(0, s) for s in range(shards)], [0] * len(bytes_of)
        for slot in sorted(range(len(bytes_of)), key=lambda i: (-bytes_of[i], i)):
            load, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (load + bytes_of[slot], shard))
        return cls(1, shards, shard_of, list(bytes_of))

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += self.bytes_of[slot]
        return out

    def rebalanced(self, bytes_of: list[int], shards: int | None = None) -> SlotMap:
        """The next version for new sizes or more shards: slots move, one by one, from the heaviest to the lightest shard while that brings the two closer."""
        now = SlotMap(self.version + 1, shards or self.shards, list(self.shard_of), list(bytes_of))
        if now.shards < self.shards:
            raise ValueError("shards can be added, not taken away")
        held: list[list[int]] = [[] for _ in range(now.shards)]
        for slot, shard in enumerate(now.shard_of):
            held[shard].append(slot)
        loads = now.loads()
        for _ in range(4 * len(bytes_of)):
            high, low = max(range(now.shards), key=lambda s: (loads[s], -s)), min(range(now.shards), key=lambda s: (loads[s], s))
            gap = loads[high] - loads[low]
            fits = [s for s in held[high] if 0 < bytes_of[s] < gap]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(2 * bytes_of[s] - gap), s))
            held[high].remove(slot)
            held[low].append(slot)
            now.shard_of[slot] = low
            loads[high] -= bytes_of[slot]
            loads[low] += bytes_of[slot]
        return now

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, slot, shard, int(size)) for slot, (shard, size) in enumerate(zip(self.shard_of, self.bytes_of, strict=True))]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int, bytes long")

    @classmethod
    def dealt(cls, shards: int, slots: int) -> SlotMap:
        """The first version, before any sizes are known: slots in turn."""
        return cls(1, shards, [slot % shards for slot in range(slots)], [0] * slots)

    def store(self, spark: SparkSession, path: str) -> None:
        """Write this version to the table at ``path``, over what may stand there for it; other versions stay as they are."""
        self.frame(spark).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)

    @classmethod
    def latest(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The latest stored version, if there is one."""
        versions = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*")
        return cls.load(spark, path) if versions.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(versions) else None

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, by default the latest."""
        rows = spark.read.parquet(path)
        if version is None:
            version = rows.agg(F.max("version")).first()[0]
        found = rows.where(F.col("version") == version).orderBy("virtual_slot").collect()  # one row a slot, thousands at most
        if not found or [r.virtual_slot for r in found] != list(range(len(found))):
            raise ValueError(f"version {version} of the slot map at {path} isn't whole")
        return cls(version, found[0].shards, [r.shard for r in found], [r.bytes for r in found])


def slotted(docs: DataFrame, shards: int, slots: int = SLOTS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, row): each record's virtual slot, and a number of its own."""
    rows = slim(docs, doc_id=id_col, text=text_col)
    base = saved(
        rows.select(
            F.col("doc_id").cast("long"),
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
            unsigned_crc32(F.col("text")).alias("text_crc32"),
            F.xxhash64("text", F.col("text").isNull()).alias("h"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = base.groupBy("h").agg(F.sum("size").alias("bytes"))
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # fewer than ``shards`` groups can be this large
    hot = groups.where(F.col("bytes") * shards > total).select("h", F.lit(True).alias("hot"))
    salted = base.join(F.broadcast(hot), "h", "left")
    own = F.coalesce("doc_id", "row")  # rows without id are told apart by where they stand
    salt = F.when(F.col("hot"), F.xxhash64(own)).otherwise(F.lit(0))
    return salted.select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("h", salt), F.lit(slots)).cast("int").alias("virtual_slot"), "row")


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, *, id_col: str = "doc_id", text_col: str = "text", slot_map: SlotMap | None = None, store: str | None = None) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    The law is ``bytes``: shards hold nearly equal sizes. size: the text's UTF-8 bytes (null: none) plus 16. slot: the record's
    place in its shard, without gaps from 0, by virtual slot and then id. slot_map: an earlier version, which is then
    rebalanced; without one, slots are given out by size. store: a folder of versions: its latest (the first, if it has none, deals
    slots in turn) is read, rebalanced to the sizes measured, written as the next version, and that is what records are placed by. Null and empty texts are two groups of their own; equal
    ids or repeated rows are placed row by row; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    placed = slotted(docs, shards, slots, id_col=id_col, text_col=text_col)
    sums = placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # at most ``slots`` rows
    sizes, counts = [0] * slots, [0] * slots
    for r in sums:
        sizes[r.virtual_slot], counts[r.virtual_slot] = r.bytes, r.n
    if store:
        slot_map = slot_map or SlotMap.latest(spark, store)
        if slot_map is None:
            slot_map = SlotMap.dealt(shards, slots)
            slot_map.store(spark, store)
        slot_map.rebalanced(sizes, shards).store(spark, store)
        now = SlotMap.load(spark, store)
    else:
        now = slot_map.rebalanced(sizes, shards) if slot_map else SlotMap.balanced(sizes, shards)
    usual = max(1, -(-2 * sum(counts) // slots))
    rows = [(slot, now.shard_of[slot], max(1, -(-counts[slot] // usual))) for slot in range(slots)]
    lookup = spark.createDataFrame(rows, "virtual_slot int, shard int, pieces int")  # ``slots`` rows
    # places in a shard: slots of many rows are counted in pieces, so that none is numbered in one task
    dealt = placed.join(F.broadcast(lookup), "virtual_slot").withColumn("piece", F.pmod(F.xxhash64(F.coalesce("doc_id", "row")), F.col("pieces")).cast("int"))
    ahead = Window.partitionBy("shard").orderBy("virtual_slot", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "virtual_slot", "piece").agg(F.count("*").alias("n"))  # at most 1.5 x ``slots`` rows
    starts = starts.select("virtual_slot", "piece", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy("virtual_slot", "piece").orderBy("doc_id", "text_crc32", "row")
    numbered = dealt.withColumn("place", F.row_number().over(within)).join(F.broadcast(starts), ["virtual_slot", "piece"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(now.version).alias("map_version"),
    )
