"""Joins of a large table with one row for each of a few keys, such as publishers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachspark.sources.scratch import kept

#: Rows of the small side up to which it is broadcast; beyond that each of its rows is copied for every part of its key's rows.
BROADCAST_ROWS, PARTS = 100_000, 16


def beside(large: DataFrame, small: DataFrame, keys: list[str], spread: Column | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """large joined with small on keys, without a shuffle of large while small has few rows.

    small is written and counted. With too many rows for a broadcast, the rows of a key are dealt into PARTS by `spread`, a hash of
    all columns unless given, so that a key with a third of all rows isn't one task's work."""
    small = kept(small, "beside")
    if small.count() <= most:
        return large.join(F.broadcast(small), keys)
    part = F.pmod(spread if spread is not None else F.xxhash64(*large.columns), F.lit(PARTS)).cast("int")
    copies = small.withColumn("j_part", F.explode(F.array(*map(F.lit, range(PARTS)))))
    return large.withColumn("j_part", part).join(copies.hint("merge"), [*keys, "j_part"]).drop("j_part")
