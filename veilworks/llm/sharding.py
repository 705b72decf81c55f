"""Sharding by fixed virtual slots.

A record hashes into one of `SLOTS` virtual slots by its key alone, and a versioned map says which shard owns each
slot. The first map of n shards is a function of n only (it is grown from one shard, step by step), so key and shard
count decide a record's shard and one more shard takes slots from the others and gives none away. `rebalance` edits a
map by the bytes that each slot holds. Each edit is a new version, stored beside the old ones, which never change.

Cases: null text counts as no bytes (size 8, crc 0); null keys share one slot, whose rows are ranked in `CELLS` parts,
as those of every slot are; repeated rows get places of their own; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilworks.llm.common import documents, shared_dir, text_of, written

SLOTS = 4096
SHARDS = 24
#: Parts of a slot that are ranked apart.
CELLS = 16
#: Bytes of a record besides its text.
ROW_BYTES = 8


def grow(owners: list[int]) -> list[int]:
    """One more shard: it takes its even share of slots, each from the shard that then owns most."""
    new = max(owners) + 1
    held: list[list[int]] = [[] for _ in range(new)]
    for slot, shard in enumerate(owners):
        held[shard].append(slot)
    out = list(owners)
    for _ in range(len(owners) // (new + 1)):
        donor = max(range(new), key=lambda s: (len(held[s]), -s))
        out[held[donor].pop()] = new
    return out


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    owners = [0] * slots
    for _ in range(shards - 1):
        owners = grow(owners)
    return owners


def rebalance(owners: list[int], slot_bytes: list[int], tolerance: float = 0.02) -> list[int]:
    """Move slots from the fullest to the emptiest shard while that narrows the gap and it exceeds the tolerance."""
    shards = max(owners) + 1
    out, load = list(owners), [0] * shards
    for slot, shard in enumerate(out):
        load[shard] += slot_bytes[slot]
    mean = sum(load) / shards
    for _ in range(len(owners)):
        high, low = max(range(shards), key=lambda s: load[s]), min(range(shards), key=lambda s: load[s])
        gap = load[high] - load[low]
        if gap <= tolerance * mean:
            break
        fit = [s for s, o in enumerate(out) if o == high and 0 < slot_bytes[s] < gap]
        if not fit:
            break
        slot = min(fit, key=lambda s: (abs(gap / 2 - slot_bytes[s]), s))
        out[slot] = low
        load[high] -= slot_bytes[slot]
        load[low] += slot_bytes[slot]
    return out


def map_frame(spark: SparkSession, owners: list[int], version: int) -> DataFrame:
    """The map as rows; their number is fixed by the number of slots."""
    return spark.createDataFrame([(version, s, o) for s, o in enumerate(owners)], "version int, vslot int, shard int")


def save_map(spark: SparkSession, owners: list[int], version: int, path: str) -> None:
    """Add a version; one that exists can't be written again."""
    map_frame(spark, owners, version).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    rows = maps.filter(F.col("version") == version).select("vslot", "shard").orderBy("vslot").collect()
    return [r.shard for r in rows]


def with_slots(df: DataFrame, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    hashed = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return df.withColumn("vslot", F.pmod(hashed, F.lit(slots)).cast("int"))


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot and cell, a part of the slot."""
    text = text_of(docs)
    sized = docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return with_slots(sized, slots=slots).withColumn("cell", F.pmod(F.xxhash64("text_crc32", "size"), F.lit(CELLS)).cast("int"))


def slot_stats(base: DataFrame) -> DataFrame:
    """Rows and bytes of each slot: as many rows as slots at most."""
    return base.groupBy("vslot").agg(F.count(F.lit(1)).alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def place(base: DataFrame, owners: list[int], **others: list[int]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the record's place in its shard), a column for each other map, vslot
    and slot_bytes. base: of `slotted`, written.

    A place is the number of rows in the shard's earlier cells plus the row's rank in its own, so that no task ever
    holds more than a cell.
    """
    spark = base.sparkSession
    names = ["vslot", "shard", *others]
    table = spark.createDataFrame(list(zip(range(len(owners)), owners, *others.values(), strict=True)), ", ".join(f"{n} int" for n in names))
    cells = base.groupBy("vslot", "cell").agg(F.count(F.lit(1)).alias("cell_rows"), F.sum("size").alias("cell_bytes"))
    before = Window.partitionBy("shard").orderBy("vslot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = table.join(cells, "vslot").withColumn("first", F.coalesce(F.sum("cell_rows").over(before), F.lit(0)))
    placed = placed.withColumn("slot_bytes", F.sum("cell_bytes").over(Window.partitionBy("vslot"))).drop("cell_rows", "cell_bytes")
    inside = Window.partitionBy("vslot", "cell").orderBy("doc_id", "text_crc32", "size")
    rows = base.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(placed), ["vslot", "cell"])  # SLOTS * CELLS rows
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank")).alias("slot"), *others, "vslot", "slot_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of the map: the first, that with one more shard, and the first evened out by the bytes of slots.
    `balanced_shard` is by the last; it depends on the table and so isn't the shard of the law."""
    where = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    base = written(slotted(documents(spark, sf_dir)), "slots")
    sizes = {r.vslot: r.slot_bytes for r in slot_stats(base).collect()}
    first = first_map(SHARDS)
    for version, owners in enumerate((first, grow(first), rebalance(first, [sizes.get(s, 0) for s in range(SLOTS)]))):
        save_map(spark, owners, version, where)
    maps = [load_map(spark, where, v) for v in range(3)]
    return place(base, maps[0], grown_shard=maps[1], balanced_shard=maps[2])
