"""Sharding by fixed virtual slots: records hash into slots, a versioned map gives slots to shards."""

from __future__ import annotations

import heapq
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspan.functions.copies import written_out
from fieldspan.llm.common import Stages

#: Virtual slots; fixed for the life of a data set.
SLOTS = 16_384
#: Parts of a slot that number their rows independently.
PARTS = 4


class SlotMap(NamedTuple):
    """Which shard holds a slot, as of a version. ``shard_of`` has one entry for each slot."""

    version: int
    shards: int
    shard_of: list[int]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(version, shards, virtual_slot, shard): at most as many rows as there are slots."""
        rows = [(self.version, self.shards, slot, shard) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot long, shard int")


def build_map(slot_bytes: list[int], shards: int) -> SlotMap:
    """Version 0: slots by falling size, each to the shard that holds least; ties to the smaller number."""
    load = [(0, s) for s in range(shards)]
    shard_of = [0] * len(slot_bytes)
    for slot in sorted(range(len(slot_bytes)), key=lambda x: (-slot_bytes[x], x)):
        held, shard = load[0]
        shard_of[slot] = shard
        heapq.heapreplace(load, (held + slot_bytes[slot], shard))
    return SlotMap(0, shards, shard_of)


def rebalance(current: SlotMap, slot_bytes: list[int], shards: int, slack: float = 0.01) -> SlotMap:
    """The next version, edited from the current one: only what is too much anywhere moves.

    Shards beyond ``shards`` are emptied. A shard above its even share by more than
    ``slack`` gives its largest slots that fit into the emptiest shard, until no move
    narrows the gap. All other slots stay where they are.
    """
    shard_of, load = list(current.shard_of), [0] * max(shards, current.shards)
    slots: list[list[int]] = [[] for _ in load]
    for slot, shard in enumerate(shard_of):
        load[shard] += slot_bytes[slot]
        slots[shard].append(slot)

    def move(slot: int, to: int) -> None:
        old = shard_of[slot]
        slots[old].remove(slot)
        slots[to].append(slot)
        load[old] -= slot_bytes[slot]
        load[to] += slot_bytes[slot]
        shard_of[slot] = to

    for shard in range(shards, len(load)):
        for slot in sorted(slots[shard], key=lambda x: (-slot_bytes[x], x)):
            move(slot, min(range(shards), key=lambda s: (load[s], s)))
    even = sum(load) / shards
    for _ in range(len(shard_of)):
        full, empty = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        fitting = [x for x in slots[full] if 0 < slot_bytes[x] < gap]
        if load[full] <= even * (1 + slack) or not fitting:
            break
        room = max(even - load[empty], min(slot_bytes[x] for x in fitting))
        move(max((x for x in fitting if slot_bytes[x] <= room), key=lambda x: (slot_bytes[x], -x)), empty)
    return SlotMap(current.version + 1, shards, shard_of)


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Add a version to the table of maps; earlier versions stay readable."""
    slot_map.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the table of maps, by default the latest."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    rows = maps.where(F.col("version") == version).orderBy("virtual_slot").collect()
    return SlotMap(version, rows[0].shards, [r.shard for r in rows])


def virtual_slot(*columns: Column | str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots))


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of every slot, from rows with virtual_slot and size; summed before they move."""
    sizes = [0] * slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("size")).collect():
        sizes[r.virtual_slot] = r.size
    return sizes


def slotted_rows(docs: DataFrame, stages: Stages, *, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(key, size, text_crc32, _part, virtual_slot) of every row, written once; texts are read here and nowhere else.

    A record's slot is a hash of its key and its text's checksum and size, so a group of equal texts spreads.
    Null text: size 1 and checksum 0, like the empty text. Null keys are hashed like any other value.
    """
    crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(key, size.alias("size"), crc.alias("text_crc32"))
    fine = F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(slots * PARTS))
    return stages.keep(rows.withColumn("_part", fine).withColumn("virtual_slot", F.floor(F.col("_part") / PARTS)), "rows")


def place_rows(rows: DataFrame, slot_map: SlotMap, stages: Stages, *, key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, virtual_slot, shard, slot) of slotted rows by a map, of whatever version.

    ``slot`` is the row's place in its shard, gapless from 0, ordered by virtual slot; it comes from counts of
    parts of slots and row numbers within a part, so no task sorts a shard. Equal rows stand
    together: they are counted before they are numbered, and written out in blocks of copies.
    """
    spark = rows.sparkSession
    alike = stages.keep(rows.groupBy(key, "size", "text_crc32", "_part", "virtual_slot").agg(F.count(F.lit(1)).alias("_copies")), "alike")
    shard_of = F.broadcast(slot_map.frame(spark).select("virtual_slot", "shard"))
    parts = alike.groupBy("_part", "virtual_slot").agg(F.sum("_copies").alias("n")).join(shard_of, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stages.keep(parts.select("_part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")), "parts")

    within = Window.partitionBy("_part").orderBy(key, "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = alike.withColumn("_place", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    placed = stages.keep(numbered.join(F.broadcast(parts), "_part"), "placed")
    copies = written_out(placed, "_copies", "_copy")
    return copies.select(key, "size", "text_crc32", "virtual_slot", "shard", (F.col("_first") + F.col("_place") + F.col("_copy") - 1).alias("slot"))


def shard_rows(
    docs: DataFrame, *, shards: int = 16, key: str = "doc_id", text: str = "text", slots: int = SLOTS, slot_map: SlotMap | None = None
) -> tuple[DataFrame, SlotMap]:
    """The placement of every row (``place_rows``), and the slot map it follows: the given one, or version 0, which evens out bytes.

    With a map that was edited only the rows of the edited slots change their shard. Repeated rows share
    a slot and each get a place of their own; which of them comes first makes no difference, as
    they are equal. Texts are never shuffled. Runs jobs when called; the driver sees one number for each slot.
    """
    if slot_map is not None and len(slot_map.shard_of) != slots:
        raise ValueError(f"the map has {len(slot_map.shard_of)} slots, not {slots}")
    stages = Stages(docs.sparkSession)
    rows = slotted_rows(docs, stages, key=key, text=text, slots=slots)
    slot_map = slot_map or build_map(slot_sizes(rows, slots), shards)
    return place_rows(rows, slot_map, stages, key=key), slot_map


def shard_by_stored_map(docs: DataFrame, path: str, *, shards: int = 16, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """The placement by the latest map stored under ``path``; where none is, version 0 is built from the rows, stored, and read back."""
    spark, stages = docs.sparkSession, Stages(docs.sparkSession)
    rows = slotted_rows(docs, stages, key=key, text=text, slots=slots)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        save_map(spark, build_map(slot_sizes(rows, slots), shards), path)
    return place_rows(rows, load_map(spark, path), stages, key=key)
