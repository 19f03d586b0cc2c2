"""Binary searches inside column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_at_most(values: Column, x: Column) -> Column:
    """How many of an array's values, which are in order, are at most x: a binary search, so a long array costs little."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        here = (s["low"] < s["high"]) & (F.get(values, middle) <= x)
        return F.struct(F.when(here, middle + 1).otherwise(s["low"]).alias("low"), F.when((s["low"] < s["high"]) & ~here, middle).otherwise(s["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve)["low"]


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often `then` uses it."""
    return F.transform(F.array(value), then)[0]


def greatest_input(target: Column, rising: Callable[[Column], Column], doublings: int = 60) -> Column:
    """The greatest whole number x (from 0 on) with rising(x) <= target, for a function that doesn't fall.

    The upper end doubles until it is over the target and the range is halved then. A target that is not exceeded after that many
    doublings is an error."""

    def double(s: Column, _: Column) -> Column:
        new = once(rising(s["high"].cast("double")) <= target, lambda below: F.struct(F.when(below, s["high"]).otherwise(s["low"]).alias("low"), F.when(below, s["high"] * 2).otherwise(s["high"]).alias("high"), (~below).alias("done")))
        return F.when(s["done"], s).otherwise(new)

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        new = once(rising(middle.cast("double")) <= target, lambda below: F.struct(F.when(below, middle).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle).alias("high"), s["done"].alias("done")))
        return F.when(s["high"] - s["low"] <= 1, s).otherwise(new)

    start = F.struct(F.lit(0).cast("long").alias("low"), F.lit(1).cast("long").alias("high"), F.lit(False).alias("done"))
    up = F.aggregate(F.sequence(F.lit(1), F.lit(doublings + 1)), start, double)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(doublings)), up, halve)
    return once(found, lambda s: F.when(~s["done"], F.raise_error(F.lit("the greatest reach is never reached"))).otherwise(s["low"]).cast("long"))
