"""Sharding over fixed virtual slots.

Every record falls into one of ``n_slots`` virtual slots by the hash of its id and content group.
Bytes and rows are aggregated by slot (at most ``n_slots`` rows reach the driver, whatever the input),
and a versioned map says which shard holds each slot. Version 0 deals slots round robin; rebalancing
edits single entries, moving slots from the fullest to the emptiest shard while that evens out
bytes, and raises the version. The law is ``bytes``: shard sizes are near equal.

Groups (equal texts) are not kept together: a text with many copies would make its shard the fullest, so a
slot follows from id and text, and only rows equal in both share one.

Defined results: a null text has no bytes and the crc32 of the empty text; a null id hashes as an id of
its own; equal rows share a slot and are numbered one after the other; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

N_SLOTS = 4096


@dataclass
class SlotMap:
    """Slot-to-shard map; ``edits`` holds (version, slot, from, to) of each moved slot."""

    shards: list[int]
    n_shards: int
    version: int = 0
    edits: list[tuple[int, int, int, int]] = field(default_factory=list)

    @classmethod
    def round_robin(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls([s % n_shards for s in range(n_slots)], n_shards)

    def rebalance(self, weights: list[int]) -> SlotMap:
        """A next version whose shard weights are near equal; moves only what evens them out."""
        shards, version = list(self.shards), self.version + 1
        load = [0] * self.n_shards
        held: list[set[int]] = [set() for _ in load]
        for slot, shard in enumerate(shards):
            load[shard] += weights[slot]
            if weights[slot]:
                held[shard].add(slot)
        edits = list(self.edits)
        mean = sum(load) / max(1, self.n_shards)

        def put(slot: int, shard: int) -> None:
            was = shards[slot]
            held[was].discard(slot)
            held[shard].add(slot)
            load[was] -= weights[slot]
            load[shard] += weights[slot]
            shards[slot] = shard
            edits.append((version, slot, was, shard))

        for _ in range(8 * len(shards)):
            full = max(range(self.n_shards), key=lambda s: (load[s], -s))
            low = min(range(self.n_shards), key=lambda s: (load[s], s))
            gap = load[full] - load[low]
            if gap <= max(1, mean * 1e-4):
                break
            one = min(((abs(gap - 2 * weights[s]), s) for s in held[full] if weights[s] < gap), default=None)
            small = sorted(held[low], key=lambda s: (weights[s], s))
            best = None
            if one is None or one[0] > gap // 4:  # a swap may even out what no single slot can
                for s in sorted(held[full], key=lambda s: (-weights[s], s))[:64]:
                    for x in small[:64]:
                        d = weights[s] - weights[x]
                        if 0 < d < gap and (best is None or abs(gap - 2 * d) < best[0]):
                            best = (abs(gap - 2 * d), s, x)
            if best is not None and (one is None or best[0] < one[0]):
                put(best[1], low)
                put(best[2], full)
            elif one is not None:
                put(one[1], low)
            else:
                break
        return SlotMap(shards, self.n_shards, version, edits)

    def grow(self, weights: list[int]) -> SlotMap:
        """A next version with one more shard, which takes slots only into itself."""
        n, version = self.n_shards + 1, self.version + 1
        shards, edits = list(self.shards), list(self.edits)
        load = [0] * n
        for slot, shard in enumerate(shards):
            load[shard] += weights[slot]
        share = sum(load) / n
        for slot in sorted(range(len(shards)), key=lambda s: (-weights[s], s)):
            was = shards[slot]
            if load[was] > share and load[n - 1] + weights[slot] <= share:
                load[was] -= weights[slot]
                load[n - 1] += weights[slot]
                shards[slot] = n - 1
                edits.append((version, slot, was, n - 1))
        return SlotMap(shards, n, version, edits)

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"version": self.version, "n_shards": self.n_shards, "shards": self.shards, "edits": self.edits})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/version={self.version}")

    @classmethod
    def latest(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The map of the highest version under ``path``; None where there is none yet."""
        try:
            found = spark.read.text(path).agg(F.max("version")).first()[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return cls.load(spark, path, found)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        x = json.loads(spark.read.text(f"{path}/version={version}").first()[0])
        return cls(x["shards"], x["n_shards"], x["version"], [tuple(e) for e in x["edits"]])


def slot_of(n_slots: int):
    return F.pmod(F.xxhash64(F.col("doc_id"), F.col("text_crc32"), F.lit(20)), F.lit(n_slots)).cast("int")


def shard_records(records: DataFrame, n_shards: int, n_slots: int = N_SLOTS, map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """(rows with virtual_slot, shard and slot, the map). ``records``: doc_id, size, text_crc32.

    ``map_path``: where the versions of the map are kept; the latest one there is edited, and the result is
    saved beside it. Without a path, or with none there, slots start round robin.

    ``slot`` is a row's place in its shard, gapless from 0: places of a virtual slot follow those of the
    shard's lower virtual slots, and within one they follow the id. Equal rows are counted before the
    shuffle and dealt out again after it, so that a much repeated row is no hot key.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "shards")
    alike = records.withColumn("virtual_slot", slot_of(n_slots)).groupBy("virtual_slot", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    alike = scratch.write(alike, "alike")
    stats = alike.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows")).collect()
    weights, counts = [0] * n_slots, [0] * n_slots
    for r in stats:
        weights[r["virtual_slot"]], counts[r["virtual_slot"]] = r["bytes"], r["rows"]
    kept = map_path or f"{scratch.path}/map"
    first = SlotMap.latest(spark, kept)
    if first is None:
        first = SlotMap.round_robin(n_slots, n_shards)
        first.save(spark, kept)
    if (len(first.shards), first.n_shards) != (n_slots, n_shards):
        raise ValueError("the saved map has other numbers of slots or shards")
    chosen = first.rebalance(weights)
    chosen.save(spark, kept)
    offset, filled = [], [0] * chosen.n_shards
    for slot, shard in enumerate(chosen.shards):
        offset.append(filled[shard])
        filled[shard] += counts[slot]
    table = spark.createDataFrame(list(zip(range(n_slots), chosen.shards, offset, strict=True)), "virtual_slot int, shard int, slots_before long")
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    placed = alike.withColumn("end", F.sum("copies").over(place)).join(F.broadcast(table), "virtual_slot")  # n_slots rows, fixed
    first_place = F.col("slots_before") + F.col("end") - F.col("copies")
    rows = placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", F.explode(F.sequence(first_place, first_place + F.col("copies") - 1)).alias("slot"))
    return rows.withColumn("map_version", F.lit(chosen.version)), chosen


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    records = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, _ = shard_records(records, 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
