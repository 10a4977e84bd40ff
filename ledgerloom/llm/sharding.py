"""Sharding by a permutation-filled lookup table (operator 4).

Every shard has its own order of preference over the slots of a table of prime size: a start and a stride from two hashes of its name. Shards
take turns and each claims the first free slot of its order, until the table is full. All shards get the same number of slots to
within one, and when a shard leaves or joins, few slots of others change hands. A row goes to the shard that holds the slot
of its key's hash: one lookup in a broadcast table whose size is the parameter `slots`, whatever the number of rows.

Keys are hashed one by one, so a source with a third of all rows spreads over all shards. A NULL key is replaced by the hash of the text.
Repeated rows go to the same shard.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import columns

SLOTS = 65537              # prime, and many times the number of shards


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "little")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's number for each slot. `slots` must be prime: then every stride reaches every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need names, each its own")
    if len(shards) > slots or slots < 2 or any(slots % k == 0 for k in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be a prime number not below that of the shards")
    at = [_hash(s, "start") % slots for s in shards]
    stride = [_hash(s, "stride") % (slots - 1) + 1 for s in shards]
    table, free, turn = [-1] * slots, slots, 0
    while free:
        k = turn % len(shards)
        while table[at[k]] >= 0:
            at[k] = (at[k] + stride[k]) % slots
        table[at[k]] = k
        free -= 1
        turn += 1
    return table


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    return spark.createDataFrame([(i, shards[k]) for i, k in enumerate(lookup_table(shards, slots))], "slot int, shard string")


def assign(df: DataFrame, shards: list[str], key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """All columns of `df`, slot and shard. Columns that have these names already give way."""
    k, instead = F.col(f"`{key}`"), F.col(f"`{text}`") if text in df.columns else F.lit(None).cast("string")
    own = F.when(k.isNotNull(), F.xxhash64(k)).otherwise(F.xxhash64(F.lit("text"), instead))
    rest = df.drop("slot", "shard")
    placed = rest.withColumn("slot", F.pmod(own, F.lit(slots)).cast("int"))
    return placed.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot").select(*[F.col(f"`{c}`") for c in rest.columns], "slot", "shard")


def shard_names(count: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(count)]


def placement(docs: DataFrame, count: int = 64, slots: int = SLOTS) -> DataFrame:
    """doc_id, slot, shard of every row."""
    return assign(columns(docs, "doc_id", "text"), shard_names(count), slots=slots).select("doc_id", "slot", "shard")


def write_shards(df: DataFrame, path: str, shards: list[str], files: int = 4, **options) -> None:
    """Write one folder per shard, each in `files` files dealt by hash, so that no task writes a whole shard."""
    placed = assign(df, shards, **options)
    (placed.withColumn("_file", F.pmod(F.xxhash64("slot"), F.lit(files))).repartition(len(shards) * files, "shard", "_file").drop("_file", "slot")
     .write.partitionBy("shard").parquet(path))
