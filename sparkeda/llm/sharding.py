"""Operator 2: sharding by a permutation-filled lookup table (DataFrame operations only)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.llm.shared import numbered, place_of


def next_prime(n: int) -> int:
    """The smallest prime that is n or more."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """The shard of each slot. Every shard prefers the slots in an order of its own (offset and
    skip from a hash of its name; a prime number of slots makes that a permutation) and the shards
    take turns claiming their next free one, so shares differ by one slot at most and a shard that
    comes or goes moves few others. Cost is that of the parameters, not of the data."""
    if not shards or slots < len(shards) or slots != next_prime(slots):
        raise ValueError("slots must be a prime number, and not below the number of shards")
    orders = []
    for name in shards:
        h = hashlib.md5(name.encode()).digest()
        orders.append([int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:], "big") % (slots - 1) + 1])
    table, free = [-1] * slots, slots
    while free:
        for k, order in enumerate(orders):
            if not free:
                break
            while table[order[0]] >= 0:
                order[0] = (order[0] + order[1]) % slots
            table[order[0]] = k
            free -= 1
    return table


def slot_of(key: Column, slots: int) -> Column:
    """60 bits of the md5 of a key's text (null: of no text), modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))


def shard(docs: DataFrame, n_shards: int = 64, slots: int | None = None, key: str = "doc_id") -> DataFrame:
    """All rows and columns of docs, and slot long and shard int (columns of these names, in any case, are replaced).

    Each row looks its slot up in a broadcast table of fixed size (slots rows), so placement
    costs no shuffle and a hot key or a group of copies adds no pairs. A null key has a slot
    like any other; equal keys share a shard; keys may be of any type (their text counts). An empty
    table gives an empty one.
    """
    slots = slots or next_prime(100 * n_shards)
    table = lookup_table([f"shard-{k}" for k in range(n_shards)], slots)
    filled = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    lookup = docs.sparkSession.range(1).select(F.posexplode(filled).alias("slot", "shard")).select(F.col("slot").cast("long").alias("slot"), "shard")
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in ("slot", "shard")]
    placed = numbered(docs).select(*[f"_{i}" for i in kept], slot_of(F.col(f"_{place_of(docs, key)}"), slots).alias("slot"))
    placed = placed.join(F.broadcast(lookup), "slot").select(*[f"_{i}" for i in kept], "slot", "shard")
    return placed.toDF(*[docs.columns[i] for i in kept], "slot", "shard")


def oracle(n_shards: int = 64, slots: int | None = None) -> str:
    slots = slots or next_prime(100 * n_shards)
    table = lookup_table([f"shard-{k}" for k in range(n_shards)], slots)
    return f"""
WITH t AS (SELECT {table} AS shards), d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {slots} AS slot FROM documents)
SELECT doc_id, slot, shards[slot + 1]::INTEGER AS shard FROM d, t"""
