"""Differential privacy: noise, the ledger of what was spent, and how a budget is split.

A ledger has the columns epsilon, delta, mechanism, params (map) and bucket (struct of start and rate: a stretch of the unit
circle of users, which may pass 1 and go on from 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "epsilon DOUBLE, delta DOUBLE, mechanism STRING, params MAP<STRING, DOUBLE>, bucket STRUCT<start: DOUBLE, rate: DOUBLE>"


def uniform(*key: Column | str, seed: str) -> Column:
    """A number between 0 and 1, both excluded, that depends on the key and the seed alone: 52 bits of an MD5, which any engine has."""
    h = F.conv(F.substring(digest(*key, seed=seed), 1, 13), 16, 10).cast("long")
    return (h.cast("double") + 0.5) / F.lit(float(1 << 52))


def digest(*key: Column | str, seed: str) -> Column:
    """The MD5 of key and seed as hexadecimal digits: what random orders go by."""
    return F.md5(F.concat_ws("/", *(k if isinstance(k, Column) else F.col(k) for k in key), F.lit(seed)))


def normal(*key: Column | str, seed: str) -> Column:
    return F.sqrt(-2 * F.log(uniform(*key, seed=f"{seed}-r"))) * F.cos(2 * F.pi() * uniform(*key, seed=f"{seed}-a"))


def geometric_noise(*key: Column | str, epsilon: float, seed: str) -> Column:
    """Two-sided geometric noise: P(x) in proportion to exp(-epsilon |x|)."""
    one = lambda s: F.floor(F.log(uniform(*key, seed=f"{seed}-{s}")) / F.lit(-float(epsilon)))
    return one("up") - one("down")


def mechanism_noise(name: str, *key: Column | str, scale: float, seed: str) -> Column:
    """Noise of a mechanism. scale is Laplace's b, or the Gaussian's deviation; the discrete Gaussian is a rounded one."""
    u = uniform(*key, seed=seed) - 0.5
    makers = {
        "Laplace": lambda: -scale * F.signum(u) * F.log(1 - 2 * F.abs(u)),
        "Discrete Laplace": lambda: geometric_noise(*key, epsilon=1 / scale, seed=seed).cast("double"),
        "Gaussian": lambda: scale * normal(*key, seed=seed),
        "Discrete Gaussian": lambda: F.round(scale * normal(*key, seed=seed)),
    }
    if name not in makers:
        raise ValueError(f"no mechanism {name}")
    return makers[name]()


def event(spark: SparkSession, epsilon: float, delta: float, mechanism: str, params: dict[str, float], start: float = 0.0, rate: float = 1.0) -> DataFrame:
    return spark.createDataFrame([(epsilon, delta, mechanism, params, (start, rate))], LEDGER)


def append(ledger: DataFrame, events: DataFrame) -> DataFrame:
    return ledger.unionByName(events.select(*ledger.columns))


def holds(point: Column) -> Column:
    """Whether an event's stretch holds a point of the circle."""
    start, stop = F.col("bucket.start"), F.col("bucket.start") + F.col("bucket.rate")
    return ((point >= start) & (point <= stop)) | (point <= stop - 1)


def at_bucket(ledger: DataFrame, point: float) -> DataFrame:
    return ledger.filter(holds(F.lit(float(point)))).agg(F.coalesce(F.sum("epsilon"), F.lit(0.0)).alias("epsilon"), F.coalesce(F.sum("delta"), F.lit(0.0)).alias("delta"))


def total(ledger: DataFrame) -> DataFrame:
    """The most that any user has spent. Sums change at the starts of stretches only, so those are tried, and 0."""
    starts = ledger.select(F.col("bucket.start").alias("point")).union(ledger.sparkSession.range(1).select(F.lit(0.0))).distinct()
    sums = starts.join(ledger, holds(F.col("point")), "left").groupBy("point").agg(F.coalesce(F.sum("epsilon"), F.lit(0.0)).alias("e"), F.coalesce(F.sum("delta"), F.lit(0.0)).alias("d"))
    return sums.agg(F.coalesce(F.max("e"), F.lit(0.0)).alias("epsilon"), F.coalesce(F.max("d"), F.lit(0.0)).alias("delta"))


def mechanisms(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.array_join(F.sort_array(F.collect_set("mechanism")), "/").alias("mechanisms"))


def split_budget(publishers: DataFrame, epsilon: float, delta: float, reach_share: float = 0.5) -> DataFrame:
    """dataset, epsilon, delta of each of 2p+1 requests, and what of it reach and frequency get."""
    n = 2 * F.count("*") + 1
    e = publishers.groupBy("dataset").agg((F.lit(float(epsilon)) / n).alias("epsilon"), (F.lit(float(delta)) / n).alias("delta"))
    return e.select("dataset", "epsilon", "delta", (F.col("epsilon") * reach_share).alias("reach_epsilon"), (F.col("epsilon") * (1 - reach_share)).alias("frequency_epsilon"))
