"""Placement by a permutation-filled lookup table.

Every shard has its own preference order of the slots of a table of prime size
(an offset and a step from hashes of its name).  The shards take turns; each claims the
first slot of its order that is still free, until the table is full.  A row's slot
is its key's hash modulo the size, so placement is one look into a table whose size does
not depend on the data; it is broadcast.  Shards hold nearly equal numbers of slots, and when
one leaves, few other rows move.

Rows with a null key are placed by their text, so they do not meet in one slot.  Repeated
rows share a shard.  Empty table: no rows.  Extra columns pass through unless their names
clash with ``slot`` and ``shard``.
"""

from __future__ import annotations

from collections.abc import Sequence

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime well over a hundred times the usual number of shards.
SLOTS = 65_537


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Number of the shard that holds each slot."""
    if not _prime(slots):
        raise ValueError(f"{slots} is not prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards need different names and a slot each")
    at = [xxhash.xxh64_intdigest(s.encode(), 1) % slots for s in shards]
    step = [xxhash.xxh64_intdigest(s.encode(), 2) % (slots - 1) + 1 for s in shards]
    table = [-1] * slots
    free = slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def lookup(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) as a table, made of two constant arrays: the names, and the name's number by slot."""
    numbers = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    slot = F.col("id").cast("int")
    return spark.range(slots).select(slot.alias("slot"), F.get(names, F.get(numbers, slot).cast("int")).alias("shard"))


def slot_of(key: Column, otherwise: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(otherwise)), F.lit(slots)).cast("int")


def place(rows: DataFrame, shards: Sequence[str], key: str = "doc_id", otherwise: str = "text", slots: int = SLOTS) -> DataFrame:
    """``rows`` with slot and shard."""
    names = [c for c in rows.columns if c.lower() not in ("slot", "shard")]
    placed = rows.select(*names, slot_of(F.col(key), F.col(otherwise), slots).alias("slot"))
    # The table has ``slots`` rows whatever the input.
    return placed.join(F.broadcast(lookup(rows.sparkSession, shards, slots)), "slot").select(*names, "slot", "shard")
