"""Sharding, native: fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into `SLOTS` slots for good; bytes and rows are summed per slot; the map says which shard holds a slot.
Version 1 deals slots out by number. `rebalance` edits the map from the slots' bytes, a slot at a time, until no move or
exchange of slots brings the fullest and the emptiest shard closer; `add_shard` moves slots into a new shard only. The map
has SLOTS entries whatever the data, so the driver may hold it and executors get it by broadcast.

With a folder for its map, `shard` goes on from the map's last version there: records stay in the slots they have, slots in
the shards they are in, but for those that the new version moves, and the new version is stored beside the old ones.

Null ids and texts hash like any value (size of a null text: 1). Rows that repeat an id and text are dealt to slots by their
row number too, so that many of them fill many slots; equal texts of different ids are not kept together. Empty tables give
empty results; other columns and their names don't matter."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_or_empty, written

SLOTS = 4096


def records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row."""
    text = text_or_empty(text_col)
    slim = df.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return slim.withColumn("virtual_slot", slot_of(slots, "doc_id", "text_crc32"))


def slot_of(slots: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def spread(rows: DataFrame, slots: int) -> DataFrame:
    """records (with rid, their row number) with another slot for rows that repeat an id, size and checksum."""
    same = ("doc_id", "text_crc32", "size")
    several = rows.groupBy(*(F.col(c).alias("__" + c) for c in same)).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n").withColumn("__again", F.lit(True))
    match = [F.col(c).eqNullSafe(F.col("__" + c)) for c in same]
    told = rows.join(several, match[0] & match[1] & match[2], "left")
    return told.withColumn("virtual_slot", F.when(F.col("__again"), slot_of(slots, "doc_id", "text_crc32", "rid")).otherwise(F.col("virtual_slot"))).drop("__again", "rid", *("__" + c for c in same))


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    return [slot * shards // slots for slot in range(slots)]


def loads(slot_map: list[int], weight: list[int], shards: int) -> list[int]:
    out = [0] * shards
    for slot, shard in enumerate(slot_map):
        out[shard] += weight[slot]
    return out


def rebalance(slot_map: list[int], weight: list[int], shards: int) -> list[int]:
    """An edited map with near equal loads. Each edit moves one slot from the fullest to the emptiest shard, or exchanges
    a heavier slot of the one for a lighter slot of the other, whichever comes closest to half their difference."""
    out = list(slot_map)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        if weight[slot]:
            bisect.insort(held[shard], (weight[slot], slot))
    load = loads(out, weight, shards)
    while True:
        full, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        half, best = (load[full] - load[low]) / 2, None
        if half < 1:
            return out
        for given in held[full]:
            at = bisect.bisect_left(held[low], (given[0] - half, -1))
            for back in (None, *held[low][max(0, at - 1) : at + 2]):
                moved = given[0] - (back[0] if back else 0)
                if 0 < moved < 2 * half and (best is None or abs(moved - half) < best[0]):
                    best = (abs(moved - half), given, back)
        if best is None:
            return out
        _, given, back = best
        for item, a, b in ((given, full, low), (back, low, full)):
            if item:
                held[a].remove(item)
                bisect.insort(held[b], item)
                out[item[1]] = b
                load[a] -= item[0]
                load[b] += item[0]


def add_shard(slot_map: list[int], shards: int) -> list[int]:
    """A map with one more shard, which takes an even part of every other shard's slots; no other slot moves."""
    out, seen = list(slot_map), [0] * shards
    for slot, shard in enumerate(out):
        seen[shard] += 1
        if seen[shard] // (shards + 1) > (seen[shard] - 1) // (shards + 1):
            out[slot] = shards
    return out


MAP = "version int, virtual_slot int, shard int"


def map_table(spark: SparkSession, version: int, slot_map: list[int]) -> DataFrame:
    return spark.createDataFrame([(version, slot, at) for slot, at in enumerate(slot_map)], MAP).coalesce(1)


def save_map(spark: SparkSession, path: str, version: int, slot_map: list[int]) -> None:
    """Stores a version of a map: a row for each slot, in a folder of its own, so that older versions stay as they are."""
    map_table(spark, version, slot_map).write.mode("errorifexists").parquet(f"{path}/v{version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]] | None:
    """A stored version of a map, by default the last one; None if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(int(f.getPath().getName()[1:]) for f in fs.listStatus(place)) if fs.exists(place) else []
    if version is None and not found:
        return None
    version = found[-1] if version is None else version
    rows = spark.read.schema(MAP).parquet(f"{path}/v{version}").collect()  # one row a slot
    return version, [r.shard for r in sorted(rows, key=lambda r: r.virtual_slot)]


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; `slots` numbers of each come to the driver."""
    n_bytes, n_rows = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect():
        n_bytes[r[0]], n_rows[r[0]] = r[1], r[2]
    return n_bytes, n_rows


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, version, shard and the row's place in its shard, gapless from 0. The map
    starts from the last version in map_path, whose new version is stored there; without one, from slots dealt by number."""
    spark = df.sparkSession
    rows = written(records(df, id_col, text_col, slots).withColumn("rid", F.monotonically_increasing_id()), "shard-records")
    rows = spread(rows, slots)
    n_bytes, n_rows = slot_totals(rows, slots)
    stored = load_map(spark, map_path) if map_path else None
    version, before = stored or (1, first_map(shards, slots))
    if map_path and not stored:
        save_map(spark, map_path, version, before)
    current = rebalance(before, n_bytes, shards)
    if current != before:
        version += 1
        if map_path:
            save_map(spark, map_path, version, current)
    starts, used = [], [0] * shards
    for slot, at in enumerate(current):
        starts.append((slot, used[at]))
        used[at] += n_rows[slot]
    placed = map_table(spark, version, current).join(spark.createDataFrame(starts, "virtual_slot int, start long"), "virtual_slot")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("place", place).join(F.broadcast(placed), "virtual_slot").select("doc_id", "size", "text_crc32", "virtual_slot", "version", "shard", (F.col("start") + F.col("place")).alias("place"))
