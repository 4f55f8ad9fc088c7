"""Broadcasts of a measured size. All other joins are left to adaptive execution, which
splits the side that a hot key makes large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What one narrow table may have to go to every executor.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 4 << 20
#: Bits of a map of keys, 16 MB.
MAP_BITS = 27


def broadcast_if(df: DataFrame, row_bound: int | None) -> DataFrame:
    """Hint a broadcast of rows of fixed width if their bound is small."""
    if row_bound is not None and row_bound <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def is_small(df: DataFrame, column: str) -> bool:
    """Whether a table's texts in one column are few and short; reads that column once."""
    n, size = df.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))
    ).first()
    return few(n, size)


def few(n: int, size: int) -> bool:
    """Whether so many rows and bytes may go to every executor."""
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def matching(history: DataFrame, incoming: DataFrame, key: str, small: bool = False) -> DataFrame:
    """Rows of a table of any size whose key may be among the incoming ones.

    The table itself is not shuffled. Few incoming keys (``small``, see :func:`is_small`)
    are broadcast. Of more, a bitmap of the keys' hashes is, whose size is fixed; rows with
    a foreign key of the same hash are let through too, so what follows compares the keys.
    """
    keys = incoming.select(key)
    if small:
        return history.join(F.broadcast(keys), key, "left_semi")
    slot = F.pmod(F.xxhash64(key), F.lit(1 << MAP_BITS)) + 1
    bits = (
        keys.select(slot.alias("_slot"))
        .groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    )
    placed = history.withColumns(
        {"_bucket": F.bitmap_bucket_number(slot), "_bit": F.bitmap_bit_position(slot)}
    )
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    hit = F.getbit(byte.cast("bigint"), (F.col("_bit") % 8).cast("int")) == 1
    found = placed.join(F.broadcast(bits), "_bucket").filter(hit)
    return found.select(*history.columns)


def without_known(incoming: DataFrame, known: DataFrame, key: str, small: bool = False) -> DataFrame:
    """Incoming rows whose key is not in a table of any size, see :func:`matching`."""
    keys = matching(known.select(key), incoming, key, small).distinct()
    return incoming.join(F.broadcast(keys) if small else keys, key, "left_anti")
