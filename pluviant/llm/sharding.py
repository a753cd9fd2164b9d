"""Placement of rows on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int) -> list[int]:
    """The shard index of each slot of a table of prime `size`.

    Each shard prefers slots offset, offset+skip, offset+2*skip, ... modulo the size, which is a permutation of all
    slots as the size is prime. Shards take turns; each claims the first slot it prefers that is still free.
    """
    if not is_prime(size) or len(shards) > size or not shards:
        raise ValueError("the table's size must be a prime, and there must be 1 to size shards")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names must differ")
    at, step = [], []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(d[:8], "big") % size)
        step.append(int.from_bytes(d[8:16], "big") % max(1, size - 1) + 1)
    table, left = [-1] * size, size
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """slot, shard: `size` rows, known before any data is read."""
    csv = ",".join(map(str, lookup_table(shards, size)))
    return spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(csv), ",")).alias("slot", "s")).select("slot", F.col("s").cast("int").alias("shard"))


def place(docs: DataFrame, key: str | Column = "doc_id", n_shards: int = 128, table_size: int = 16381, names: list[str] | None = None) -> DataFrame:
    """`docs` with two more columns, slot and shard; columns of those names are replaced.

    The key's hash picks a slot, and a broadcast join of exactly `table_size` rows gives its shard, so placement takes
    constant time, moves no row, and does not depend on how many rows share a source. When a shard leaves or joins,
    few keys of the other shards move. Null keys hash like any value and share a slot; rows that repeat a key go to the
    same shard; an empty table stays empty. The table is a literal of the plan: lost executors rebuild it.
    """
    names = names or [f"shard-{k:05d}" for k in range(n_shards)]
    key = F.col(key) if isinstance(key, str) else key
    lookup = F.broadcast(table_frame(docs.sparkSession, names, table_size))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("slot", "shard")]
    slotted = docs.select(*kept, F.pmod(F.xxhash64(key), F.lit(table_size)).cast("int").alias("slot"))
    return slotted.join(lookup, "slot").select(*kept, "slot", "shard")
