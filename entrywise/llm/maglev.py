"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table, given
by an offset and a step from hashes of its name. The shards take turns; each
claims the first free slot of its order, until the table is full. A row's key
is hashed to a slot, and the table, whose size is a fixed parameter, is
broadcast. Shards get nearly equal numbers of slots, and adding or removing one
moves few of the others' slots.

Defined results: a null key is placed like an empty one; equal keys share a
shard; extra columns are kept; columns called slot or shard are replaced; an
empty table stays empty, and is written as an empty folder.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

TABLE_SIZE = 65_537
#: A table above this size is refused, as it is broadcast.
LARGEST_TABLE = 4_000_037


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard number of each slot."""
    if not is_prime(size) or size > LARGEST_TABLE:
        raise ValueError(f"the table size must be a prime of at most {LARGEST_TABLE}: {size}")
    if not shards or len(shards) > size or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one and at most as many as slots")
    digest = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    offset = [int(d[:15], 16) % size for d in digest]
    step = [int(d[15:30], 16) % (size - 1) + 1 for d in digest]
    table, turn, left = [-1] * size, [0] * len(shards), size
    while True:
        for s in range(len(shards)):
            while True:
                slot = (offset[s] + turn[s] * step[s]) % size
                turn[s] += 1
                if table[slot] < 0:
                    break
            table[slot] = s
            left -= 1
            if left == 0:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of its MD5 modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(size)


def assign_shards(df: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """Append slot (int) and shard (name)."""
    table = lookup_table(shards, size)
    at, name = unused(df, "_slot"), unused(df, "_shard")
    small = df.sparkSession.createDataFrame(pd.DataFrame({at: range(size), name: [shards[s] for s in table]}), f"{at} int, {name} string")
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(f"`{key}`"), size).cast("int"))
    return rows.join(F.broadcast(small), F.col("slot") == F.col(at), "left").withColumn("shard", F.col(name)).drop(at, name)


def deal_shards(df: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """Whole rows with slot and shard, moved to partitions by shard.

    A rebalanced exchange splits large shards and joins small ones, so partitions
    are of one size whatever the size of the table, and no task holds a whole shard.
    """
    placed = assign_shards(df, shards, key, size)
    return placed.hint("rebalance", F.col("shard"))


def write_shards(df: DataFrame, path: str, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> None:
    """Write Parquet folders shard=<name>."""
    deal_shards(df, shards, key, size).drop("slot").write.partitionBy("shard").mode("overwrite").parquet(path)
