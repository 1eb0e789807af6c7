"""Placement of keys on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barvault.llm.support import free_name

SHARDS = 64
TABLE_SIZE = 65_537  # prime, about a thousand slots a shard: shares differ by under one percent


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's walk over all slots; a step below a prime size visits every slot once."""
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1


def fill(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard number of every slot: shards take turns, each claiming the next free slot of its own walk.

    The table has ``size`` entries whatever the data are, so it is a bounded parameter, not data. Removing a shard
    frees its slots and moves few others.
    """
    if not _is_prime(size):
        raise ValueError("the table size must be prime")
    if not 0 < len(shards) <= size:
        raise ValueError("at least one shard and no more shards than slots")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names must differ")
    walks = [preference(name, size) for name in shards]
    at = [offset for offset, _ in walks]
    owner, left = [-1] * size, size
    while left:
        for shard, (_, step) in enumerate(walks):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + step) % size
            owner[slot], at[shard] = shard, (slot + step) % size
            left -= 1
            if not left:
                break
    return owner


def shard_names(count: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(count)]


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard) rows of the filled table."""
    listed = F.split(F.lit(",".join(map(str, fill(shards, size)))), ",")
    return spark.range(1, numPartitions=1).select(F.posexplode(listed).alias("slot", "owner")).select(
        "slot", F.col("owner").cast("int").alias("shard")
    )


def slot_of(key: str, fallback: str | None, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of its MD5 modulo the size. A null key takes the fallback column's, or an empty key's."""
    text = F.col(key).cast("string")
    if fallback:
        text = F.coalesce(text, F.concat(F.lit("?"), F.col(fallback).cast("string")))
    return (F.conv(F.substring(F.md5(F.coalesce(text, F.lit("?"))), 1, 15), 16, 10).cast("bigint") % size).cast("int")


def assign_shards(
    df: DataFrame, key: str, fallback: str | None = None, shards: int = SHARDS, size: int = TABLE_SIZE, out: str = "shard"
) -> DataFrame:
    """Add the shard of each row.

    One hash and one lookup a row: the table is broadcast (``size`` rows of two integers, a fixed bound) and nothing is
    shuffled, so a hot source or a hot key costs no more than others. Rows with equal keys share a shard; rows with a
    null key are spread by ``fallback``; an empty table gives an empty one. A column named ``out`` is replaced.
    """
    rest = [c for c in df.columns if c != out]
    slot, owner = free_name(df, "slot"), free_name(df, "owner")
    slots = lookup_table(df.sparkSession, shard_names(shards), size).toDF(slot, owner)
    return (
        df.withColumn(slot, slot_of(key, fallback, size))
        .join(F.broadcast(slots), slot, "left")
        .select(*[F.col(f"`{c}`") for c in rest], F.col(owner).alias(out))
    )
