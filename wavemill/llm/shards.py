"""Sharding by fixed virtual slots, with DataFrame operations only.

Records are hashed into a fixed number of slots by their id and their text's checksum, so rows that repeat an id
(or have none) spread as well; bytes are summed for each slot; a versioned table maps every slot to
a shard and is stored beside the dataset. Rebalancing edits that table: a record's slot never changes.

Law: ``bytes``. Slots go, largest first, to the shard with the fewest bytes, so shard sizes differ by
no more than one slot; slots without bytes go to the shards with the fewest slots. A map that is used again keeps
every slot where it is. If it is to be rebalanced, the heaviest shards give slots away, the largest that fit first, until
all are within ``SLACK`` of the mean or within a slot of each other, and the version grows with the edit.

Rows alike in id and text share a slot, unless they are a thousandth of all rows or more: then each copy after the
first has a slot of its own number. Defined results: a null text has 0 bytes (8 with the header) and the checksum
of nothing; rows that repeat an id are placed each; texts of any length count whole; an empty table gives an empty
result and a map without bytes; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavemill.llm.shared import require_columns, settle

#: Virtual slots. Fixed for the life of a dataset; the driver holds one small row for each.
SLOTS = 4096
#: Bytes that each record has besides its text.
HEADER = 8
#: Neighbouring rows in which copies are numbered together, a power of two.
ROWS_A_GROUP = 1 << 16


#: How far a shard may be above the mean before a map that is used again is edited.
SLACK = 0.02


@dataclass
class SlotMap:
    """slot -> (shard, records, bytes) of all slots; ``version`` grows with each edit of a shard."""

    shards: int
    version: int
    slots: dict[int, tuple[int, int, int]] = field(default_factory=dict)

    @classmethod
    def balanced(cls, sizes: Iterable[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> SlotMap:
        """``sizes``: (slot, records, bytes); slots that aren't named are empty."""
        found = {slot: (n, size) for slot, n, size in sizes}
        loads, counts = [(0, s) for s in range(shards)], [0] * shards
        out = cls(shards, 1)
        for slot, (n, size) in sorted(found.items(), key=lambda x: (-x[1][1], x[0])):
            load, shard = heapq.heappop(loads)
            out.slots[slot] = (shard, n, size)
            counts[shard] += 1
            heapq.heappush(loads, (load + size, shard))
        fewest = [(n, s) for s, n in enumerate(counts)]
        heapq.heapify(fewest)
        for slot in (x for x in range(slots) if x not in found):
            n, shard = heapq.heappop(fewest)
            out.slots[slot] = (shard, 0, 0)
            heapq.heappush(fewest, (n + 1, shard))
        return out

    def with_sizes(self, sizes: Iterable[tuple[int, int, int]]) -> SlotMap:
        """The same map with other records and bytes."""
        found = {slot: (n, size) for slot, n, size in sizes}
        return SlotMap(self.shards, self.version, {k: (shard, *found.get(k, (0, 0))) for k, (shard, _, _) in self.slots.items()})

    def rebalanced(self) -> SlotMap:
        """The map edited as far as its balance asks for: the next version, if any slot moves."""
        out = SlotMap(self.shards, self.version, dict(self.slots))
        loads = out.loads()
        mean = sum(loads) / self.shards
        own: dict[int, list[tuple[int, int]]] = {}
        for slot, (shard, _, size) in sorted(out.slots.items(), key=lambda x: (x[1][2], x[0])):
            own.setdefault(shard, []).append((size, slot))
        edited, open_ = False, set(range(self.shards))
        while open_:
            full = max(open_, key=lambda s: (loads[s], -s))
            least = min(range(self.shards), key=lambda s: (loads[s], s))
            if loads[full] <= mean * (1 + SLACK):
                break
            # The largest slot that leaves its shard no lighter than the one that takes it.
            place = next((i for i in range(len(own[full]) - 1, -1, -1) if 0 < own[full][i][0] <= (loads[full] - loads[least]) / 2), None)
            if place is None:
                open_.discard(full)
                continue
            size, slot = own[full].pop(place)
            out.slots[slot] = (least, *out.slots[slot][1:])
            loads[full] -= size
            loads[least] += size
            edited = True
        out.version += edited
        return out

    def store(self, spark: SparkSession, folder: str) -> None:
        """Put the map into ``folder``, beside its earlier versions."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={self.version}")

    @classmethod
    def stored(cls, spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """The map of that version, or the latest."""
        rows = spark.read.parquet(folder).select("version", "vslot", "shard", "records", "bytes", "shards")
        at = version if version is not None else rows.agg(F.max("version")).first()[0]
        found = rows.where(F.col("version") == at).collect()
        if not found:
            raise ValueError(f"no map of version {at}")
        return cls(found[0].shards, at, {r.vslot: (r.shard, r.records, r.bytes) for r in found})

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for shard, _, size in self.slots.values():
            out[shard] += size
        return out

    def grown(self) -> SlotMap:
        """The next version with one more shard, which takes slots from the fullest until it has its share."""
        out = SlotMap(self.shards + 1, self.version + 1, dict(self.slots))
        loads, new = out.loads(), self.shards
        share = sum(loads) / out.shards
        by_shard: dict[int, list[tuple[int, int]]] = {}
        for slot, (shard, _, size) in sorted(out.slots.items(), key=lambda x: (x[1][2], x[0])):
            by_shard.setdefault(shard, []).append((size, slot))
        while loads[new] < share and (open_ := [s for s in range(new) if by_shard.get(s)]):
            full = max(open_, key=lambda s: (loads[s], -s))
            size, slot = by_shard[full].pop()
            if loads[new] + size > share + size / 2:
                continue
            out.slots[slot] = (new, *out.slots[slot][1:])
            loads[full] -= size
            loads[new] += size
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """shards, slot, shard, records, bytes, and first: the shard's records in slots before."""
        rows, seen = [], [0] * self.shards
        for slot in sorted(self.slots):
            shard, n, size = self.slots[slot]
            rows.append((self.shards, slot, shard, n, size, seen[shard]))
            seen[shard] += n
        return spark.createDataFrame(rows, "shards int, vslot int, shard int, records long, bytes long, first long")


def _copy_numbers(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (with ``_row``) and ``_copy``, their place among the rows of their ``key``, counted in parts of ROWS_A_GROUP."""
    parted = rows.withColumn("_part", F.shiftright("_row", ROWS_A_GROUP.bit_length() - 1))
    counts = parted.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(key, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_row"))
    return parted.withColumn("_place", place).join(starts, [key, "_part"]).withColumn("_copy", F.col("_before") + F.col("_place") - 1).select(*rows.columns, "_copy")


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, size, text_crc32, vslot: what sharding needs of each record, without its text."""
    require_columns(docs, [id_col, text_col])
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + HEADER).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    rows = settle(sized.withColumn("_key", F.xxhash64("_id", "text_crc32")).withColumn("_row", F.monotonically_increasing_id()))
    # Keys with a thousandth of all rows: at most a thousand.
    often = settle(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & (F.col("_n") * 1000 >= rows.count())).select("_key"))
    hash_ = lambda *more: F.pmod(F.xxhash64("_id", "text_crc32", *more), F.lit(slots)).cast("int").alias("vslot")
    columns = ["_id", "size", "text_crc32"]
    if not often.count():
        return rows.select(*columns, hash_())
    rest = rows.join(F.broadcast(often), "_key", "left_anti").select(*columns, hash_())
    copies = _copy_numbers(rows.join(F.broadcast(often), "_key", "left_semi"), "_key")
    return settle(rest.unionByName(copies.select(*columns, hash_(F.nullif("_copy", F.lit(0))))))  # a null leaves the hash as it is


def shard_documents(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, slot_map: SlotMap | None = None, rebalance: bool = False
) -> tuple[DataFrame, SlotMap]:
    """(id, size, text_crc32, shard, slot, vslot) and the map used; a ``slot_map`` given decides on slots and shards. ``slot``: the record's place in its shard, from 0.

    Places are numbered within each virtual slot and shifted by the map, so no task sorts a whole
    shard. The map has ``slots`` rows, which bounds what is collected and broadcast.
    """
    spark = docs.sparkSession
    rows = slotted(docs, id_col, text_col, slots if slot_map is None else len(slot_map.slots))
    sizes = rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    found = [tuple(r) for r in sizes.collect()]
    if slot_map is None:
        slot_map = SlotMap.balanced(found, shards, slots)
    else:
        slot_map = slot_map.with_sizes(found)
        slot_map = slot_map.rebalanced() if rebalance else slot_map
    where = slot_map.table(spark).select("vslot", "shard", "first")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("_id", "text_crc32", "size"))
    out = rows.withColumn("_place", place).join(F.broadcast(where), "vslot")
    return (
        out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("_place") - 1).alias("slot"), "vslot"),
        slot_map,
    )
