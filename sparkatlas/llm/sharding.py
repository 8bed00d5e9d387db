"""Sharding over fixed virtual slots.

Records hash into a fixed number of virtual slots. Rows and bytes are summed
per slot, a table as long as the number of slots whatever the corpus, and a
versioned map sends each slot to a shard. Rebalancing writes a new version of
the map that moves few slots; records never hash anew.

Only DataFrame operations touch records. The map is control data of at most
``n_slots`` rows and is planned on the driver.

Defined cases: a null or empty text has no bytes (size 1, CRC 0); a null doc_id
is a value like any other; repeated rows are separate records, placed one after
the other; ties of doc_id go by CRC, then size; a very long text counts with all
of its bytes; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkatlas.llm.common import fresh_path, stored

N_SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long, first_place long"


@dataclass(frozen=True)
class Slot:
    slot: int
    bytes: int
    rows: int
    shard: int | None = None


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row, without the text."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return slim.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_totals(recs: DataFrame) -> list[Slot]:
    """Bytes and rows per slot: at most n_slots rows, summed before the shuffle."""
    sums = recs.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return [Slot(r.virtual_slot, r.b, r.n) for r in sums.collect()]


def plan(slots: list[Slot], n_shards: int) -> list[Slot]:
    """First map: heaviest slot first, each to the shard with the least bytes."""
    heap = [(0, shard) for shard in range(n_shards)]
    out = []
    for s in sorted(slots, key=lambda s: (-s.bytes, s.slot)):
        load, shard = heapq.heappop(heap)
        out.append(Slot(s.slot, s.bytes, s.rows, shard))
        heapq.heappush(heap, (load + s.bytes, shard))
    return out


def rebalance(current: list[Slot], slots: list[Slot], n_shards: int, slack: float = 0.002) -> list[Slot]:
    """Edit a map for new totals or another number of shards, moving few slots.

    Slots of shards that are gone or above their share (plus slack) move, the
    smallest first, to the shard with the least bytes.
    """
    known = {s.slot: s.shard for s in current}
    share = sum(s.bytes for s in slots) / n_shards * (1 + slack)
    load, kept, moving = [0] * n_shards, [], []
    for s in sorted(slots, key=lambda s: (-s.bytes, s.slot)):
        shard = known.get(s.slot)
        if shard is not None and shard < n_shards and load[shard] + s.bytes <= share:
            load[shard] += s.bytes
            kept.append(Slot(s.slot, s.bytes, s.rows, shard))
        else:
            moving.append(s)
    heap = [(b, shard) for shard, b in enumerate(load)]
    heapq.heapify(heap)
    for s in moving:
        b, shard = heapq.heappop(heap)
        kept.append(Slot(s.slot, s.bytes, s.rows, shard))
        heapq.heappush(heap, (b + s.bytes, shard))
    return kept


def store_map(spark: SparkSession, slots: list[Slot], version: int, path: str | None = None) -> DataFrame:
    """Write one version of the slot map, with the place of each slot's first row in its shard."""
    place: dict[int, int] = {}
    rows = []
    for s in sorted(slots, key=lambda s: s.slot):
        rows.append((version, s.slot, s.shard, s.bytes, s.rows, place.get(s.shard, 0)))
        place[s.shard] = place.get(s.shard, 0) + s.rows
    path = path or fresh_path(spark, "slot-map")
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/v{version}")
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v{version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the map below path, oldest first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[1:]) for n in found if n[:1] == "v" and n[1:].isdigit() and fs.exists(done(f"{path}/{n}/_SUCCESS")))


def read_map(spark: SparkSession, path: str, version: int) -> list[Slot]:
    """A stored version: one row for each slot."""
    rows = spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v{version}").collect()
    return [Slot(r.slot, r.bytes, r.rows, r.shard) for r in rows]


def changes(spark: SparkSession, path: str) -> DataFrame:
    """(slot, bytes, before, after, moved) between the two newest versions of the map."""
    old, new = versions(spark, path)[-2:]
    a, b = (spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v{v}") for v in (old, new))
    both = b.select("slot", "bytes", F.col("shard").alias("after")).join(a.select("slot", F.col("shard").alias("before")), "slot", "left")
    return both.select("slot", "bytes", "before", "after", (~F.col("before").eqNullSafe(F.col("after"))).alias("moved"))


def assign(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard and its place there (gapless from 0)."""
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    at = F.broadcast(slot_map.select(F.col("slot").alias("virtual_slot"), "shard", "first_place", "version"))
    return (
        recs.withColumn("_n", F.row_number().over(order))
        .join(at, "virtual_slot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first_place") + F.col("_n") - 1).alias("slot"), "virtual_slot", F.col("version").alias("map_version"))
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """Shard by bytes: sizes of shards are near equal.

    path: where versions of the map lie. The newest is edited for the totals
    and shards of now and written as the next version; without one, a first
    version is planned.
    """
    spark = docs.sparkSession
    recs = stored(records(docs, n_slots), "records")
    totals = slot_totals(recs)
    known = versions(spark, path) if path else []
    slots = rebalance(read_map(spark, path, known[-1]), totals, n_shards) if known else plan(totals, n_shards)
    return assign(recs, store_map(spark, slots, known[-1] + 1 if known else 1, path))
