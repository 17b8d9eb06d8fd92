"""Shard placement by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime
size: ``offset + turn * skip``. The shards take turns, each claiming its next
free slot, so slots are even to within one and few keys move when the set of
shards changes. The table's size is fixed by a parameter, so it is broadcast;
a key's slot is its hash modulo the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import unused

#: A prime, far above 100 slots for each of ``SHARDS``.
SLOTS = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(256))


def preference(name: str, slots: int) -> tuple[int, int]:
    """First slot of a shard's permutation and its step."""
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> np.ndarray:
    """Index of the shard that owns each slot. ``slots`` has to be prime."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)) or slots < 2:
        raise ValueError("slots must be a prime that is not below the number of shards")
    table = np.full(slots, -1, np.int32)
    wanted, steps = map(list, zip(*(preference(s, slots) for s in shards)))
    left = slots
    while left:
        for k in range(len(shards)):
            slot = wanted[k]
            while table[slot] >= 0:
                slot = (slot + steps[k]) % slots
            table[slot] = k
            wanted[k] = (slot + steps[k]) % slots
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 48 bits of the MD5 of its text; a null key is empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % slots).cast("long")


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and shard of each row.

    Every row is kept; equal keys share a shard and a null key has one too.
    Columns of ``df`` with the names of the new ones are replaced.
    """
    table = lookup_table(shards, slots)
    names = np.array(list(shards))[table]
    slot, shard = unused("slot", df.columns), unused("shard", df.columns)
    lookup = df.sparkSession.createDataFrame(pa.table({slot: np.arange(slots), shard: pa.array(names.tolist())}))
    kept = [c for c in df.columns if c not in (slot_col, shard_col)]
    rows = df.select(slot_of(F.col(f"`{key}`"), slots).alias(slot), *[F.col(f"`{c}`") for c in kept])
    return rows.join(F.broadcast(lookup), slot).select(F.col(slot).alias(slot_col), *[F.col(f"`{c}`") for c in kept], F.col(shard).alias(shard_col))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, parts: int = 4) -> None:
    """Parquet folders by shard. A shard's rows go to ``parts`` tasks, so a
    shard with many rows isn't one task's."""
    rows = place(df, key, shards, slots)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(parts))
    rows.repartition("shard", salt).write.partitionBy("shard").parquet(path)
