"""Consistent placement of rows on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without_columns

#: Slots of the table; a prime, and its size bound.
SLOTS = 65_537
MOST_SLOTS = 1_000_003


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """The shard number in each slot.

    Each shard's order of preference is the walk offset, offset + skip, ...
    modulo the prime number of slots, with offset and skip from SHA-256 of its
    name. Shards take turns in the order given (a shard of weight w takes w
    slots a turn), each claiming the first slot of its order that is free.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _prime(slots) or slots > MOST_SLOTS or slots < len(shards):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    turns = [(weights or {}).get(s, 1) for s in shards]
    if min(turns) < 1:
        raise ValueError("weights must be 1 or more")
    walk = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        walk.append((int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1))
    at, table, free = [offset for offset, _ in walk], [-1] * slots, slots
    while True:
        for k, turn in enumerate(turns):
            for _ in range(turn):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + walk[k][1]) % slots
                table[at[k]] = k
                free -= 1
                if not free:
                    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def sharded(df: DataFrame, key_col: str, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """df with columns slot (int) and shard (string); columns of these names, in capitals or not, are replaced.

    A row's slot is a 64-bit hash of its key modulo ``slots``. The table, at
    most MOST_SLOTS rows however large df is, is broadcast and probed by slot,
    so a row is placed in constant time and without a shuffle. Null keys hash
    like a value of their own; repeated keys share a shard; an empty df stays
    empty.
    """
    owner = lookup_table(shards, slots, weights)
    table = df.sparkSession.createDataFrame(pd.DataFrame({"slot": range(slots), "shard": [shards[k] for k in owner]}), "slot int, shard string")
    own = without_columns(df, ["slot", "shard"]).columns
    rows = df.select(*(F.col(f"`{c}`") for c in own), slot_of(F.col(key_col), slots).alias("slot"))
    return rows.join(F.broadcast(table), "slot").select(*(F.col(f"`{c}`") for c in own), "slot", "shard")


def write_shards(df: DataFrame, path: str, key_col: str, shards: list[str], rows_per_file: int = 1_000_000, **options) -> None:
    """Parquet folders shard=<name>, in files of about rows_per_file rows; a shard of many rows, or a key of many, is written by many tasks.

    Rows of a shard are dealt to its files by their number, so repeated keys and
    rows share a shard but not a task. Placement, null keys and clashing columns
    are as in ``sharded``; of an empty df nothing but the folder is written.
    """
    placed = sharded(df, key_col, shards, **options)
    # At most a row per shard.
    files = placed.groupBy("shard").agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("files"))
    total = files.agg(F.sum("files")).first()[0] or 1
    salt = next(n for n in map("_file{}".format, range(len(df.columns) + 1)) if n.lower() not in {c.lower() for c in placed.columns})
    dealt = placed.join(F.broadcast(files.withColumnRenamed("files", salt)), "shard").withColumn(salt, F.pmod(F.monotonically_increasing_id(), salt))
    dealt.repartition(int(total), F.col("shard"), F.col(salt)).drop(salt).write.partitionBy("shard").parquet(path)
