"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a table of prime size: it starts at an
offset and steps by a skip, both hashed from its name, so that the order visits every slot once.
The shards take turns; at its turn a shard claims its most preferred free slot, until all slots are
taken. A row's key is hashed to a slot, and the slot names the shard: one lookup in a table whose
size is a parameter, hence a broadcast of bounded size, whatever the number of rows. When a shard
is added or removed, few slots change hands besides those of that shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

#: Slots; a prime well over 100 times the shards keeps their shares within a percent of each other.
TABLE_SIZE = 65537
#: The table is broadcast, so its size has this bound.
LARGEST_TABLE = 4_000_037
SHARDS = tuple(f"shard-{i:04d}" for i in range(256))


def is_prime(n: int) -> bool:
    """Whether n is a prime, by trial division (n is at most some millions)."""
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset (0..size-1) and skip (1..size-1) of a shard's order over the slots."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:15], 16) % size, int(digest[15:30], 16) % (size - 1) + 1


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> list[int]:
    """The slot table: for each slot, the index of the shard that owns it.

    weights: turns in each round, 1 each by default. Names must be distinct, since equal names have
    equal orders; at least one weight must be positive.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and there must be one at least")
    if not is_prime(size) or not len(shards) <= size <= LARGEST_TABLE:
        raise ValueError(f"the table's size must be a prime from the number of shards to {LARGEST_TABLE}")
    turns = [i for i, n in enumerate(weights or [1] * len(shards)) for _ in range(n)]
    if not turns:
        raise ValueError("no shard has a turn")
    orders = [preference(s, size) for s in shards]
    owner = [-1] * size
    at = [offset for offset, _ in orders]
    left = size
    while True:
        for shard in turns:
            slot, skip = at[shard], orders[shard][1]
            while owner[slot] >= 0:
                slot = (slot + skip) % size
            owner[slot] = shard
            at[shard] = (slot + skip) % size
            left -= 1
            if not left:
                return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of its MD5 modulo the size. A null key counts as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(size)


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> DataFrame:
    """The lookup table as rows (slot, shard, shard_name)."""
    owner = fill_table(shards, size, weights)
    return spark.createDataFrame([(i, o, shards[o]) for i, o in enumerate(owner)], "slot long, shard int, shard_name string")


def place(
    df: DataFrame, key: str | Column, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, weights: Sequence[int] | None = None, *, slot_col: str = "slot", shard_col: str = "shard", name_col: str = "shard_name"
) -> DataFrame:
    """Add each row's slot, shard index and shard name; columns of these names are replaced.

    Rows are kept one to one and in place: nothing is shuffled. Equal keys, null ones included, get the same
    shard; an empty table stays empty; other columns pass through untouched.
    """
    key = F.col(key) if isinstance(key, str) else key
    table = table_frame(df.sparkSession, shards, size, weights).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"), F.col("shard_name").alias("__name"))
    found = df.withColumn("__key_slot", slot_of(key, size)).join(F.broadcast(table), F.col("__key_slot") == F.col("__slot"), "left")
    taken = {slot_col, shard_col, name_col}
    return found.select(*(F.col(f"`{c}`") for c in df.columns if c not in taken), F.col("__key_slot").alias(slot_col), F.col("__shard").alias(shard_col), F.col("__name").alias(name_col))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every row of ``documents``: doc_id, slot, shard, shard_name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id")
