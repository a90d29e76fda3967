"""Sharding by fixed virtual slots.

Every record is hashed into one of ``n_slots`` virtual slots; a slot never changes. What can change is the
versioned map from slots to shards: it is computed from the bytes that each slot holds, edited when shards are
rebalanced or added, and stored with a version number. The corpus is only scanned for the aggregate (at most
``n_slots`` rows reach the driver, however large the corpus is) and for the final placement.

Law: ``bytes`` - the shards' sizes are near equal, as the first map places the largest slots first, each on the shard
that holds least. A record's slot comes from its id and its text's crc, so null ids and equal texts spread over slots
and shards; only rows that agree in both share a slot.

A slot's records are ranked in ``PARTS`` parts of it by themselves; counts of the parts (``n_slots * PARTS`` rows at most,
whatever the corpus) give each part's first place. So no shard and no slot is ever sorted as a whole.

Defined results: a null text has no bytes, so its record weighs ``overhead`` bytes and its crc is null; null ids
are ids like others; repeated rows are all placed, side by side in the same slot; an empty table
gives an empty result with the same columns; other columns of the input pass through untouched, whatever their names,
and an input column that has the name of an added column is replaced.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.columns import unused
from textloom.session import ensure_checkpoint_dir

N_SLOTS = 4096
PARTS = 16
TOLERANCE = 0.02
OVERHEAD = 8

MAP_SCHEMA = T.StructType(
    [
        T.StructField("vslot", T.IntegerType(), False),
        T.StructField("shard", T.IntegerType(), False),
        T.StructField("version", T.IntegerType(), False),
    ]
)


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map; ``shards[v]`` is the shard of virtual slot ``v``."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table with a row for each virtual slot."""
        return spark.createDataFrame([(v, s, self.version) for v, s in enumerate(self.shards)], MAP_SCHEMA)


def virtual_slot(key: Column, crc: Column, n_slots: int = N_SLOTS) -> Column:
    """The fixed slot of a record."""
    return F.pmod(F.xxhash64(key, crc), F.lit(n_slots)).cast("int")


def balanced_map(slot_bytes: dict[int, int], n_shards: int, n_slots: int = N_SLOTS, version: int = 1) -> SlotMap:
    """Place slots from the largest down, each on the shard with the fewest bytes so far."""
    heap = [(0, 0, shard) for shard in range(n_shards)]
    shards = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda v: (-slot_bytes.get(v, 0), v)):
        held, count, shard = heapq.heappop(heap)
        shards[slot] = shard
        heapq.heappush(heap, (held + slot_bytes.get(slot, 0), count + 1, shard))
    return SlotMap(version, n_shards, tuple(shards))


def edited_map(old: SlotMap, slot_bytes: dict[int, int], n_shards: int, tolerance: float = TOLERANCE) -> SlotMap:
    """A new version in which as few slots as possible move.

    Slots leave shards that hold more than the mean by ``tolerance``, largest fitting slot first, for the shard
    that holds least. More shards than before start empty, so growth takes slots only into the new ones as long as
    the old ones are balanced.
    """
    shards = [min(s, n_shards - 1) for s in old.shards]
    held = [0] * n_shards
    members: list[list[int]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(shards):
        held[shard] += slot_bytes.get(slot, 0)
        members[shard].append(slot)
    mean = sum(held) / n_shards
    for shard in sorted(range(n_shards), key=lambda s: -held[s]):
        for slot in sorted(members[shard], key=lambda v: (-slot_bytes.get(v, 0), v)):
            size = slot_bytes.get(slot, 0)
            target = min(range(n_shards), key=lambda s: (held[s], s))
            if held[shard] <= mean * (1 + tolerance) or not size:
                break
            if held[shard] - size >= mean * (1 - tolerance) and held[target] + size <= mean * (1 + tolerance):
                held[shard] -= size
                held[target] += size
                shards[slot] = target
    return SlotMap(old.version + 1, n_shards, tuple(shards))


def write_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Store a version; written again (a retry), it takes its own place."""
    frame = slot_map.frame(spark).drop("version")
    frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={slot_map.version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The newest stored map, or the given version."""
    stored = spark.read.parquet(path)
    wanted = version if version is not None else stored.agg(F.max("version")).first()[0]
    rows = stored.filter(F.col("version") == wanted).orderBy("vslot").collect()
    shards = tuple(r["shard"] for r in rows)
    return SlotMap(wanted, max(shards) + 1, shards)


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether a version is at ``path``, a folder of any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(where) and any("version=" in s.getPath().getName() for s in files.listStatus(where))


def current_map(spark: SparkSession, path: str, slot_bytes: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """The stored map at ``path``, first made or edited to a new version where the shards are out of balance."""
    if not is_stored(spark, path):
        write_map(spark, balanced_map(slot_bytes, n_shards, n_slots), path)
    stored = read_map(spark, path)
    held = [0] * max(n_shards, stored.n_shards)
    for slot, shard in enumerate(stored.shards):
        held[shard] += slot_bytes.get(slot, 0)
    mean = sum(held) / n_shards
    if len(held) != n_shards or max(held) > mean * (1 + TOLERANCE):
        edited = edited_map(stored, slot_bytes, n_shards)
        if edited.shards != stored.shards:
            write_map(spark, edited, path)
            stored = read_map(spark, path)
    return stored


_ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "vslot", "map_version"]


def shard(
    docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS, store: str | None = None
) -> DataFrame:
    """Place every record; adds ``size, text_crc32, law, shard, slot, grown_shard, vslot, map_version``.

    ``slot`` is the record's position in its shard, gapless from 0: virtual slots lie one after another in a
    shard, and a slot's parts one after another in the slot. ``store`` is the folder of the versioned map; without one
    the map is stored in a folder of its own in the shared checkpoint folder.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    store = store or f"{spark.sparkContext.getCheckpointDir()}/slot-map-{uuid.uuid4().hex}"
    own = [c for c in docs.columns if c.lower() not in _ADDED or c in (key, text)]
    part, first = unused([*own, *_ADDED], "__part"), unused([*own, *_ADDED], "__first")
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + OVERHEAD
    crc = F.crc32(F.col(text).cast("binary"))
    sized = docs.select(*own).withColumns({"size": size, "text_crc32": crc})
    sized = sized.withColumns(
        {"vslot": virtual_slot(F.col(key), F.col("text_crc32"), n_slots),
         part: F.pmod(F.xxhash64(F.col("text_crc32"), F.col(key), F.lit(1)), F.lit(PARTS)).cast("int")}
    )
    counts = sized.groupBy("vslot", part).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).checkpoint()
    totals = {r["vslot"]: (r["b"], r["n"]) for r in counts.groupBy("vslot").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()}
    placed = current_map(spark, store, {v: b for v, (b, _) in totals.items()}, n_shards, n_slots)
    offset, rows = [0] * placed.n_shards, []
    for vslot, home in enumerate(placed.shards):
        rows.append((vslot, home, offset[home]))
        offset[home] += totals.get(vslot, (0, 0))[1]
    homes = spark.createDataFrame(rows, "vslot int, shard int, slot_first long")
    before = Window.partitionBy("vslot").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("n", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(homes), "vslot")
    starts = starts.select("vslot", part, "shard", (F.col("slot_first") + F.col("n")).alias(first))
    within = Window.partitionBy("vslot", part).orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    # n_slots * PARTS rows, fixed parameters: safe to broadcast at any corpus size
    return (
        sized.join(F.broadcast(starts), ["vslot", part])
        .withColumns(
            {
                "law": F.lit("bytes"),
                "slot": F.col(first) + F.row_number().over(within) - 1,
                "grown_shard": F.lit(None).cast("int"),
                "map_version": F.lit(placed.version),
            }
        )
        .select(*own, *[c for c in _ADDED if c not in own])
    )


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs, 24).select("doc_id", *_ADDED)
