"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table. In turns,
each claims the first slot of its order that is still free, until the table is full. A row's
key is hashed to a slot, and the slot's owner is its shard. Adding or removing one shard
changes the owner of few slots besides those that must change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime far above the number of shards, so that shares differ by little.
TABLE_SIZE = 65_537
#: Most slots a table may have: what is broadcast stays below 16 MB.
LARGEST_TABLE = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Where a shard's order of preference starts, and its step."""
    code = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(code[:8], "big") % size, int.from_bytes(code[8:16], "big") % (size - 1) + 1


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot, the index of the shard that owns it.

    Shards claim in the order of their names, so the table depends on the set of names alone;
    the indices are positions in ``shards``.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, and at least one")
    if not is_prime(size) or not len(shards) < size <= LARGEST_TABLE:
        raise ValueError(f"the table's size must be a prime above the number of shards, at most {LARGEST_TABLE}")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    at = [preference(shards[i], size) for i in turns]
    slot, step = [a for a, _ in at], [b for _, b in at]
    owner, left = [-1] * size, size
    while True:
        for turn, shard in enumerate(turns):
            k, d = slot[turn], step[turn]
            while owner[k] >= 0:
                k = (k + d) % size
            owner[k], slot[turn] = shard, (k + d) % size
            left -= 1
            if not left:
                return np.array(owner, dtype=np.int32)


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The filled table as (slot, shard, shard_name), one row a slot."""
    owner = fill_table(shards, size)
    names = pa.array(list(shards)).take(pa.array(owner))
    table = pa.table({"slot": pa.array(np.arange(size), pa.int32()), "shard": pa.array(owner), "shard_name": names})
    return spark.createDataFrame(table)


def place(docs: DataFrame, shards: Sequence[str], size: int = TABLE_SIZE, key: str = "doc_id", spread: str = "text") -> DataFrame:
    """``docs`` with slot, shard (an index into ``shards``) and shard_name.

    Rows go by the hash of ``key``, so a row keeps its place whatever else is in the table. A
    null key, which may be that of many rows, is replaced by the ``spread`` column; if both are
    null the row has a fixed slot. Rows with equal keys share a shard. Columns of these names
    already in ``docs`` are replaced. An empty table gives an empty result.

    Only the lookup table is broadcast; it has ``size`` rows however many rows ``docs`` has.
    """
    by_key = F.xxhash64(F.col(key).cast("string"))
    by_rest = F.xxhash64(F.lit("null"), F.col(spread).cast("string"))
    slot = F.pmod(F.when(F.col(key).isNotNull(), by_key).otherwise(by_rest), F.lit(size)).cast("int")
    rest = docs.drop("slot", "shard", "shard_name").withColumn("slot", slot)
    return rest.join(F.broadcast(lookup_table(docs.sparkSession, shards, size)), "slot")
