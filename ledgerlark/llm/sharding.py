"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into SLOTS slots; the slots' bytes are summed; a map of at most SLOTS rows says which shard owns each slot. The map is
a table with a version, and rebalancing edits it: only slots that must move change owner. Law: bytes (shard sizes near equal).

Defined results: a null text has no bytes; a null id hashes as empty text; repeated rows go to the same slot and each gets a place of
its own; an empty table gives an empty result and a map without load.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, scratch_path, written

SLOTS = 4096


def keyed(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """key, size in bytes plus 1, CRC of the text, and the virtual slot. The hash takes the id and the text's CRC, so that neither
    copies of one text nor rows without an id share a slot."""
    t = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return df.select(F.col(key), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32")).withColumn(
        "virtual_slot", F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), "text_crc32"), F.lit(slots)).cast("int")
    )


def slot_load(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot; at most SLOTS rows whatever the input."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


@dataclass
class SlotMap:
    """Which shard owns each virtual slot. Held on the driver: its length is the number of slots, not of records."""

    shards: int
    owner: dict[int, int]
    version: int = 1
    load: dict[int, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def fit(cls, load: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> SlotMap:
        """Slots by falling bytes, each to the shard with the fewest bytes so far; slots without rows spread over all."""
        heap = [(0, s) for s in range(shards)]
        owner = {}
        for slot in sorted(range(slots), key=lambda s: (-load.get(s, (0, 0))[0], s)):
            size, s = heapq.heappop(heap)
            owner[slot] = s
            heapq.heappush(heap, (size + max(1, load.get(slot, (0, 0))[0]), s))
        return cls(shards, owner, 1, load)

    def rebalanced(self, shards: int, load: dict[int, tuple[int, int]] | None = None) -> SlotMap:
        """The next version for another number of shards or new loads: slots leave shards above the mean (or that are gone), largest
        that fits first, for the emptiest shard; all others stay where they are."""
        load = self.load if load is None else load
        size = lambda s: max(1, load.get(s, (0, 0))[0])
        owner, held = dict(self.owner), {s: 0 for s in range(shards)}
        homeless = []
        for slot, s in owner.items():
            if s < shards:
                held[s] += size(slot)
            else:
                homeless.append(slot)
        mean = sum(map(size, owner)) / shards
        by: dict[int, list[int]] = {s: [] for s in held}
        for slot, s in sorted(owner.items(), key=lambda x: (-size(x[0]), x[0])):
            if s in by:
                by[s].append(slot)
        for s, slots in by.items():
            for slot in slots:
                if held[s] - size(slot) >= mean:
                    held[s] -= size(slot)
                    homeless.append(slot)
        for slot in sorted(homeless, key=lambda x: (-size(x), x)):
            s = min(held, key=lambda x: (held[x], x))
            owner[slot] = s
            held[s] += size(slot)
        return SlotMap(shards, owner, self.version + 1, load)

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows of the map, with the number of records that stand before each slot's own in its shard."""
        rows, seen = [], [0] * self.shards
        for slot, s in sorted(self.owner.items()):
            b, n = self.load.get(slot, (0, 0))
            rows.append((self.version, slot, s, b, n, seen[s]))
            seen[s] += n
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int, bytes long, rows long, first_place long")

    def store(self, spark: SparkSession, path: str) -> str:
        """Write this version beside the earlier ones; versions are never rewritten."""
        self.table(spark).coalesce(1).drop("version").write.parquet(f"{path}/version={self.version}")
        return path

    @classmethod
    def stored(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the latest by default."""
        df = spark.read.parquet(path)
        version = df.agg(F.max("version")).first()[0] if version is None else version
        rows = df.where(F.col("version") == version).collect()  # `slots` rows
        if not rows:
            raise ValueError(f"{path} has no version {version}")
        return cls(1 + max(r.shard for r in rows), {r.virtual_slot: r.shard for r in rows}, version, {r.virtual_slot: (r.bytes, r.rows) for r in rows})


def assign(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None, version: int | None = None) -> DataFrame:
    """All records with shard and place: key, size, text_crc32, virtual_slot, shard, slot (gapless from 0 in each shard); a result that has
    the key's name gets an underscore behind it. A map stored under map_path decides (its `version`, the latest by default), its length is
    the number of slots, and `shards` and `slots` do not count then. Where there is no map, one is fitted to the slots' bytes and stored
    there as version 1; a version that is asked for and isn't there is an error. Places are counted inside each virtual slot and moved by
    the rows of the slots before it, so no task holds a shard."""
    spark = df.sparkSession
    held = SlotMap.stored(spark, map_path, version) if map_path and there(spark, map_path) else None
    if held is None and version is not None:
        raise ValueError(f"no slot map with version {version} at {map_path}")
    slots = len(held.owner) if held else slots
    rows = written(keyed(df.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__key", "__text", slots), "slots")
    load = {r.virtual_slot: (r.bytes, r.rows) for r in slot_load(rows).collect()}  # at most `slots` rows
    if held:
        held = SlotMap(held.shards, held.owner, held.version, load)
    else:
        held = SlotMap.fit(load, shards, slots)
        held.store(spark, map_path or scratch_path(spark, "slot-map"))
    owner = held.table(spark).select("virtual_slot", "shard", "first_place")
    inside = Window.partitionBy("virtual_slot").orderBy(F.col("__key").asc_nulls_first(), "text_crc32", "size")
    out = rows.withColumn("__at", F.row_number().over(inside)).join(F.broadcast(owner), "virtual_slot")  # `slots` rows at most
    names = free(["size", "text_crc32", "virtual_slot", "shard", "slot"], [key])
    return out.select("__key", "size", "text_crc32", "virtual_slot", "shard", (F.col("first_place") + F.col("__at") - 1).cast("long").alias("slot")).toDF(key, *names)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a map has been stored under path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
