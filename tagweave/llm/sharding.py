"""Sharding over fixed virtual slots.

Every record falls into one of `SLOTS` virtual slots by a hash of its key; a
versioned table maps slots to shards. `slot_sizes` aggregates rows and bytes
per slot. `grow` edits the map for one more shard: whole slots move, and only
into the new shard. `rebalance` edits it by the aggregated bytes. The map and
the sizes have `SLOTS` rows at most, whatever the data, so they may be broadcast
and edited on the driver.

Law: ``key``. The map for n shards is built by growing from one shard, so the
key and the number of shards alone decide a record's shard.

Defined cases: a null text has no bytes (size 16, crc32 of nothing: 0); a null
key is hashed as the empty string; rows with equal keys share a shard; equal
rows are numbered in any order, which cannot be told apart; an empty table
gives an empty result; input columns named like an added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored, table, without

SLOTS = 4096
SHARDS = 40
OVERHEAD = 16


def slot_of(key: Column) -> Column:
    """Virtual slot of a key: the first 32 bits of the md5 of its text, modulo SLOTS."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % SLOTS).cast("int")


def initial_map(shards: int) -> list[int]:
    """Shard of each slot for so many shards."""
    owner = [0] * SLOTS
    for n in range(2, shards + 1):
        owner = grow(owner, n)
    return owner


def grow(owner: list[int], shards: int) -> list[int]:
    """The map with one more shard (the last of `shards`): the fullest shards give their highest slots to it."""
    new, held = shards - 1, {s: [] for s in range(shards)}
    for slot, s in enumerate(owner):
        held[s].append(slot)
    owner = list(owner)
    for _ in range(len(owner) // shards):
        fullest = max(range(new), key=lambda s: (len(held[s]), -s))
        owner[held[fullest].pop()] = new
    return owner


def rebalance(owner: list[int], sizes: dict[int, int], tolerance: float = 0.02) -> list[int]:
    """Move slots from the heaviest to the lightest shard while that brings them closer.

    Stops when the two differ by at most `tolerance` of the mean, or no slot helps.
    """
    owner = list(owner)
    shards = max(owner) + 1
    load, held = [0] * shards, [[] for _ in range(shards)]
    for slot, s in enumerate(owner):
        load[s] += sizes.get(slot, 0)
        held[s].append(slot)
    mean = sum(load) / shards
    while True:
        top, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[top] - load[low]
        fit = [x for x in held[top] if 0 < sizes.get(x, 0) < gap]
        if gap <= tolerance * mean or not fit:
            return owner
        slot = min(fit, key=lambda x: (abs(sizes[x] - gap / 2), x))
        held[top].remove(slot)
        held[low].append(slot)
        owner[slot] = low
        load[top] -= sizes[slot]
        load[low] += sizes[slot]


def map_table(spark: SparkSession, versions: dict[int, list[int]]) -> DataFrame:
    """(version, vslot, shard) rows of the given map versions."""
    return spark.createDataFrame([(v, slot, shard) for v, owner in versions.items() for slot, shard in enumerate(owner)], "version int, vslot int, shard int")


def store_map(maps: DataFrame, path: str) -> None:
    """Append map versions to the table of maps; older versions stay."""
    maps.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("version") == version).select("vslot", "shard")


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` with size, text_crc32 and vslot."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    cols = without(df.select(*[f"`{c}`" for c in (df.columns if keep is None else keep)]), ["size", "text_crc32", "vslot"]).columns
    return df.select(*[F.col(f"`{c}`") for c in cols], (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), slot_of(F.col(f"`{key}`")).alias("vslot"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """(vslot, rows, bytes), aggregated before the shuffle; SLOTS rows at most."""
    return rows.groupBy("vslot").agg(F.count("*").alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def place(rows: DataFrame, maps: DataFrame, version: int, order: list[str]) -> DataFrame:
    """Add shard, slot (number of the row in its shard, from 0, without gaps) and slot_bytes to sized rows.

    Rows are numbered within a virtual slot, and the slots of a shard one after
    another, so the numbering has SLOTS parallel groups and not one per shard.
    """
    owner = maps.filter(F.col("version") == version).select("vslot", "shard")
    ahead = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    first = slot_sizes(rows).join(F.broadcast(owner), "vslot").withColumn("first", F.coalesce(F.sum("slot_rows").over(ahead), F.lit(0)))
    number = F.row_number().over(W.partitionBy("vslot").orderBy(*order))
    return rows.withColumn("__n", number).join(F.broadcast(first), "vslot").withColumn("slot", F.col("first") + F.col("__n") - 1).drop("__n", "first", "slot_rows")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = initial_map(SHARDS)
    maps = stored(map_table(spark, {1: now, 2: grow(now, SHARDS + 1)}))
    rows = stored(sized(table(sf_dir, "documents", spark), keep=["doc_id"]))
    grown = maps.filter("version = 2").select("vslot", F.col("shard").alias("grown_shard"))
    placed = place(rows, maps, 1, ["doc_id", "text_crc32", "size"]).join(F.broadcast(grown), "vslot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", F.col("vslot").alias("virtual_slot"), "slot_bytes", F.lit(1).alias("map_version"))


QUERIES = {"op7_sharding": op7_sharding}
SQL: dict[str, str] = {}
