"""Sharding by a permutation-filled lookup table.

The shards take turns; at its turn a shard claims the next free slot of its own
permutation of a prime-sized table. A shard of weight w has w turns a round. The table is
a literal of bounded size (`SLOTS` numbers), sent with the plan, so that placing a key is one hash
and one array access, without a join. When a shard leaves, few keys of the others move.

A null key is a key like any other. Repeated keys go to one shard, repeated rows stay
repeated. Extra columns are kept only where asked. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS, SHARDS = 65_537, 64


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:7], "big")


def lookup(shards: dict[str, int], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard; `shards` maps names to weights of 1 or more."""
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} slots: the number must be prime")
    if not shards or min(shards.values()) < 1:
        raise ValueError("at least one shard, of weight 1 or more")
    place = [_number("offset:" + s) % slots for s in shards]
    step = [_number("skip:" + s) % (slots - 1) + 1 for s in shards]
    turns = [i for i, w in enumerate(shards.values()) for _ in range(w)]
    table, free = [-1] * slots, slots
    while True:
        for i in turns:
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            table[place[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: 60 bits of its MD5 modulo the table's size; a null key hashes as the empty string."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots).cast("int")


def placed(df: DataFrame, key: Column, table: list[int], names: list[str], keep: list[str]) -> DataFrame:
    """The kept columns with slot and shard of the key."""
    held = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    labels = F.split(F.lit("\n".join(names)), "\n")
    return df.select(*[F.col(c) for c in keep], slot_of(key, len(table)).alias("slot")).select(
        *keep, F.col("slot").cast("long").alias("slot"), F.get(labels, F.get(held, F.col("slot"))).alias("shard"))


def write_shards(df: DataFrame, key: Column, table: list[int], names: list[str], path: str, files: int = 8) -> None:
    """The rows as Parquet under shard=…; a hot shard is spread over `files` writers by a hash of the row.

    All columns are written; a column named shard is refused. An empty table writes an empty folder.
    """
    if any(c.lower() == "shard" for c in df.columns):
        raise ValueError("the table has a column named shard, which the folders are named by: rename it first")
    rows = placed(df.select(F.struct("*").alias("row"), key.alias("key")), F.col("key"), table, names, ["row"])
    rows.repartition(len(names) * files, "shard", F.pmod(F.xxhash64("row"), F.lit(files))).select("row.*", "shard").write.partitionBy("shard").mode("overwrite").parquet(path)
