"""Shard placement by a permutation-filled lookup table (the table of Maglev hashing).

Each shard has its own preference order over the slots of a table of prime size: an offset and a step derived from a
hash of its name. Shards take turns, each claiming its next free slot, until the table is full. A key goes to the
shard that holds slot hash(key) mod size. Shards get almost equal numbers of slots, and adding or removing a shard
moves few keys besides those it gains or loses.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portable_hash

#: Slots per shard at least; the more, the more even.
SLOTS_PER_SHARD = 100


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def table_size(shards: int, per_shard: int = SLOTS_PER_SHARD) -> int:
    """The smallest prime with per_shard slots for each shard."""
    n = max(2, shards * per_shard)
    while not is_prime(n):
        n += 1
    return n


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's order over the slots; the size is prime, so every step visits all slots."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:8], 16) % size, int(digest[8:16], 16) % (size - 1) + 1


def fill_table(names: list[str], size: int | None = None) -> list[int]:
    """For each slot the index of its shard."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need distinct names, one at least")
    size = size or table_size(len(names))
    if not is_prime(size) or size < len(names):
        raise ValueError("the size must be a prime, no less than the number of shards")
    orders = [preference(n, size) for n in names]
    turn, owner, left = [0] * len(names), [-1] * size, size
    while left:
        for i, (offset, step) in enumerate(orders):
            slot = (offset + turn[i] * step) % size
            while owner[slot] >= 0:
                turn[i] += 1
                slot = (offset + turn[i] * step) % size
            owner[slot] = i
            turn[i] += 1
            left -= 1
            if not left:
                break
    return owner


def place(df: DataFrame, key: str, names: list[str], size: int | None = None) -> DataFrame:
    """df with slot (long) and shard (int).

    The table has one row per slot (size rows of two numbers, whatever df holds) and is broadcast. A null key is
    placed as the empty string; equal keys go to one shard, so repeated rows stay together; an empty df gives an
    empty result. Columns of df named slot or shard are replaced, the key's own too; all others are kept. No rows are
    shuffled.
    """
    owner = fill_table(names, size)
    lookup = df.sparkSession.createDataFrame(list(enumerate(owner)), "slot long, shard int")
    slot = portable_hash(F.coalesce(F.col(key).cast("string"), F.lit(""))) % len(owner)
    kept = [F.col(c) for c in df.columns if c not in ("slot", "shard")]
    return df.select(*kept, slot.alias("slot")).join(F.broadcast(lookup), "slot", "left")


def write_shards(df: DataFrame, path: str, key: str, names: list[str], files_per_shard: int = 8) -> None:
    """One folder per shard. Rows are dealt by shard and a salt, so a large shard is written by several tasks."""
    out = place(df, key, names).drop("slot")
    salt = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(files_per_shard))
    out.repartition(len(names) * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)
