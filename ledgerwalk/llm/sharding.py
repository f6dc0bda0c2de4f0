"""Shard placement by a permutation-filled look-up table.  [native]

Every shard orders the slots of a prime-sized table by its own permutation
(``offset + j * skip mod size``); the shards take turns, each claiming its
first free slot, until the table is full.  Slot counts then differ by at most
one, and when a shard joins or leaves, few slots change hands.  The table has
``size`` entries whatever the data (a parameter, checked against
``MAX_TABLE``), so it is filled once where the plan is built and broadcast;
placing a row is one hash and one look-up.

A null key is hashed as the empty string; repeated keys go to one shard; an
empty table places nothing.  Extra columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried

TABLE_SIZE = 4099
MAX_TABLE = 1_000_003
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """(offset, skip) of a shard's permutation of the slots."""
    d = hashlib.md5(shard.encode()).hexdigest()
    return int(d[:16], 16) % size, int(d[16:], 16) % (size - 1) + 1


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and not empty")
    if not _is_prime(size) or not len(shards) <= size <= MAX_TABLE:
        raise ValueError("the table size must be a prime between the number of shards and MAX_TABLE")
    prefs = [preference(s, size) for s in shards]
    table, step, left = [-1] * size, [0] * len(shards), size
    while True:
        for i, (offset, skip) in enumerate(prefs):
            while table[slot := (offset + step[i] * skip) % size] >= 0:
                step[i] += 1
            table[slot] = i
            left -= 1
            if not left:
                return table


def table_frame(spark: SparkSession, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """The filled table as rows (slot, shard)."""
    owners = F.split(F.lit(",".join(str(i) for i in fill_table(shards, size))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(1).select(F.posexplode(owners).alias("slot", "_owner")).select(
        "slot", F.element_at(names, F.col("_owner").cast("int") + 1).alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8)
    return (F.conv(head, 16, 10).cast("bigint") % size).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE,
          slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with its ``slot`` and ``shard`` (columns of those names are replaced)."""
    table = table_frame(df.sparkSession, shards, size).select(F.col("slot").alias("_slot"), F.col("shard").alias("_shard"))
    own = [c for c in df.columns if c.lower() not in (slot.lower(), shard.lower())]
    rows = carried(df).withColumn("_slot", slot_of(F.col("_row")[key], size)).join(F.broadcast(table), "_slot")
    return rows.select(*[F.col("_row")[c].alias(c) for c in own], F.col("_slot").alias(slot), F.col("_shard").alias(shard))
