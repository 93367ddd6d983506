"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots, bytes and rows are summed per slot, and a versioned map says which
shard holds which slot. Rebalancing and growing edit the map: they move whole slots, and only as many as are needed.
The map has one entry a slot whatever the data's size, so it is kept on the driver and broadcast.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm.common import cut, spread_rank

SLOTS = 16384


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """shards[i] is the shard of virtual slot i. Every edit gives a new version and keeps the moves it made."""

    version: int
    count: int
    shards: tuple[int, ...]
    moved: tuple[tuple[int, int, int], ...] = field(default=())  # slot, from, to

    @staticmethod
    def fresh(slots: int, count: int) -> SlotMap:
        return SlotMap(1, count, tuple(i % count for i in range(slots)))

    @staticmethod
    def packed(weights: list[int], count: int) -> SlotMap:
        """A first map by weight: heaviest slot first, each to the lightest shard, then rebalanced."""
        heap, shards = [(0, 0, s) for s in range(count)], [0] * len(weights)
        for slot in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
            load, held, shard = heapq.heappop(heap)
            shards[slot] = shard
            heapq.heappush(heap, (load + weights[slot], held + 1, shard))
        return SlotMap(1, count, tuple(shards))

    def _loads(self, weights: list[int]) -> list[int]:
        loads = [0] * self.count
        for slot, shard in enumerate(self.shards):
            loads[shard] += weights[slot]
        return loads

    def rebalanced(self, weights: list[int], tolerance: float = 0.01) -> SlotMap:
        """Moves slots from the heaviest to the lightest shard until none is over (1 + tolerance) x the mean."""
        shards, loads, moves = list(self.shards), self._loads(weights), []
        held: list[list[int]] = [[] for _ in range(self.count)]
        for slot, shard in enumerate(shards):
            held[shard].append(slot)
        most = sum(loads) / self.count * (1 + tolerance)
        while True:
            heavy, light = max(range(self.count), key=lambda s: (loads[s], -s)), min(range(self.count), key=lambda s: (loads[s], s))
            gap = loads[heavy] - loads[light]
            fits = [s for s in held[heavy] if 0 < weights[s] < gap]
            if loads[heavy] <= most or not fits:
                break
            slot = min(fits, key=lambda s: (abs(2 * weights[s] - gap), s))
            held[heavy].remove(slot)
            held[light].append(slot)
            shards[slot] = light
            moves.append((slot, heavy, light))
            loads[heavy] -= weights[slot]
            loads[light] += weights[slot]
        return SlotMap(self.version + 1, self.count, tuple(shards), tuple(moves))

    def grown(self, weights: list[int]) -> SlotMap:
        """One more shard, which takes slots from the heaviest shards until it has its share; nothing else moves."""
        shards, loads, moves = list(self.shards), self._loads(weights), []
        new, load, share = self.count, 0, sum(weights) / (self.count + 1)
        held: list[list[int]] = [[] for _ in range(self.count)]
        for slot, shard in enumerate(shards):
            held[shard].append(slot)
        while load < share:
            heavy = max(range(self.count), key=lambda s: (loads[s], -s))
            fits = [s for s in held[heavy] if 0 < weights[s] and load + weights[s] <= share + weights[s] / 2]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(loads[heavy] - share - weights[s]), s))
            held[heavy].remove(slot)
            shards[slot] = new
            moves.append((slot, heavy, new))
            loads[heavy] -= weights[slot]
            load += weights[slot]
        return SlotMap(self.version + 1, self.count + 1, tuple(shards), tuple(moves))

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "count": self.count, "shards": self.shards, "moved": self.moved})

    @staticmethod
    def from_json(text: str) -> SlotMap:
        x = json.loads(text)
        return SlotMap(x["version"], x["count"], tuple(x["shards"]), tuple(map(tuple, x["moved"])))


def slot_weights(sized: DataFrame, slots: int, column: str = "size") -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot of a table with virtual_slot and size: one row a slot reaches the driver."""
    weights, rows = [0] * slots, [0] * slots
    for r in sized.groupBy("virtual_slot").agg(F.sum(column).alias("w"), F.count("*").alias("n")).collect():
        weights[r["virtual_slot"]], rows[r["virtual_slot"]] = int(r["w"] or 0), r["n"]
    return weights, rows


def sized_records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(id_col, size, text_crc32, virtual_slot) of every row: UTF-8 bytes plus overhead; null texts count as no bytes.

    Null ids hash by their text's checksum, other columns are not read. Rows repeated with one id share a slot.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    crc = F.crc32(text)
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("crc:"), crc.cast("string")))
    return docs.select(F.col(id_col), (F.octet_length(text) + overhead).cast("long").alias("size"), crc.alias("text_crc32"), slot_of(key, slots).alias("virtual_slot"))


def save_map(spark: SparkSession, folder: str, slot_map: SlotMap) -> None:
    """Adds a version to the stored map; versions are never written twice."""
    if slot_map.version in versions(spark, folder):
        raise ValueError(f"{folder} has version {slot_map.version} already")
    rows = [(slot_map.version, slot_map.count, slot, shard) for slot, shard in enumerate(slot_map.shards)]
    spark.createDataFrame(rows, "version int, count int, slot int, shard int").coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions stored in folder, in order; none if there is no map yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return sorted(r["version"] for r in spark.read.parquet(folder).select("version").distinct().collect())  # one row a version


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
    """A stored version, the latest if none is given."""
    chosen = versions(spark, folder)[-1] if version is None else version
    rows = sorted((r["slot"], r["shard"], r["count"]) for r in spark.read.parquet(folder).where(F.col("version") == chosen).collect())  # one row a slot
    return SlotMap(chosen, rows[0][2], tuple(shard for _, shard, _ in rows))


def shard_documents(docs: DataFrame, count: int = 40, slot_map: SlotMap | None = None, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, SlotMap]:
    """One row per row of docs: id_col, size, text_crc32, virtual_slot, shard, slot (its place in its shard); and the map.

    With slot_map, or where folder holds a map, that one is used; a stored one is edited, and stored as the next version,
    where shards are over 1 % from equal bytes. Else a map is packed from the bytes of each virtual slot and rebalanced,
    and both versions are stored in folder, if there is one. Places are gapless from 0 in each shard: a slot's first place
    follows from the rows of the slots before it in its shard, so a shard is never ordered in one task. An empty table
    gives an empty result and a map of empty slots.
    """
    spark = docs.sparkSession
    sized = cut(sized_records(docs, slots, id_col, text_col))
    weights, rows = slot_weights(sized, slots)
    if slot_map is None and folder is not None and versions(spark, folder):
        slot_map = load_map(spark, folder)
        edited = slot_map.rebalanced(weights)
        if edited.moved:
            save_map(spark, folder, edited)
            slot_map = load_map(spark, folder)
    elif slot_map is None:
        slot_map = SlotMap.packed(weights, count)
        edited = slot_map.rebalanced(weights, 0.0001)
        for m in (slot_map, edited) if folder is not None else ():
            save_map(spark, folder, m)
        slot_map = edited if folder is None else load_map(spark, folder)
    if len(slot_map.shards) != slots:
        raise ValueError(f"the map has {len(slot_map.shards)} slots, not {slots}")
    first, filled = [], [0] * slot_map.count
    for slot, shard in enumerate(slot_map.shards):
        first.append((slot, shard, filled[shard]))
        filled[shard] += rows[slot]
    layout = F.broadcast(spark.createDataFrame(first, "virtual_slot int, shard int, _first long"))  # one row a slot
    ranked = spread_rank(sized, ["virtual_slot"], [F.col(id_col), F.col("text_crc32"), F.col("size")], "_inside")
    placed = ranked.join(layout, "virtual_slot")
    return placed.select(id_col, "size", "text_crc32", "virtual_slot", "shard", (F.col("_first") + F.col("_inside")).cast("long").alias("slot")), slot_map
