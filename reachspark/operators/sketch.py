"""Mergeable sketches of audiences, and reach from them.

A sketch is a row for each register in use: register, low and high (least and greatest person there), freq (impressions).
Registers are drawn from a truncated exponential law, so small audiences fill few and large ones don't saturate. Size and decay of
the law are numbers, or columns where sketches of several laws are in one table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachspark.functions.search import once
from reachspark.operators import privacy

SIZE, DECAY = 100_000, 12.0


def exp(x: float | Column) -> float | Column:
    return F.exp(x) if isinstance(x, Column) else math.exp(x)


def register(seed: str, size: int | Column = SIZE, decay: float | Column = DECAY, own: tuple[str, ...] = ()) -> Column:
    """A person's register; columns in `own` draw it anew."""
    u = privacy.uniform("vid", *own, seed=seed)
    return F.least(F.floor(-F.log(1 - u * F.lit(1 - exp(-decay))) * F.lit(size / decay)), F.lit(size - 1)).cast("long")


def build(prefix: DataFrame, seed: str, keys: tuple[str, ...] = (), size: int | Column = SIZE, decay: float | Column = DECAY, own: tuple[str, ...] = ()) -> DataFrame:
    """The sketch of a prefix's impressions, or of its people where a row stands for f impressions of one."""
    freq = F.sum("f") if "f" in prefix.columns else F.count("*")
    return prefix.groupBy(*keys, register(seed, size, decay, own).alias("register")).agg(F.min("vid").alias("low"), F.max("vid").alias("high"), freq.alias("freq"))


def merge(sketches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One sketch for each of keys; merging sketches of parts gives the sketch of the whole."""
    return sketches.groupBy(*keys, "register").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("freq").alias("freq"))


def occupied(n: Column, size: int | Column, decay: float | Column) -> Column:
    """Registers that n people are expected to occupy: a sum over 2000 slices of the law (far below the sketch's own error)."""
    cells = 2000
    rate = decay / (size * (1 - exp(-decay)))
    p = lambda i: F.lit(rate) * F.exp(-F.lit(decay) * (i + 0.5) / cells)
    return F.aggregate(F.sequence(F.lit(0), F.lit(cells - 1)), F.lit(0.0), lambda a, i: a + (1 - F.exp(n * F.log1p(-p(i))))) * F.lit(size / cells)


def cardinality(found: Column, size: int | Column = SIZE, decay: float | Column = DECAY) -> Column:
    """The number of people at which so many registers are expected to be in use, by halving 40 times between 0 and 2^36."""
    half = lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), ((s["lo"] + s["hi"]) / 2).alias("mid"))
    low = lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), s["mid"].alias("mid"), (occupied(s["mid"], size, decay) < found).alias("low"))
    kept = lambda s: F.struct(F.when(s["low"], s["mid"]).otherwise(s["lo"]).alias("lo"), F.when(s["low"], s["hi"]).otherwise(s["mid"]).alias("hi"))
    step = lambda s, i: once(once(half(s), low), kept)  # noqa: E731 - the sum over slices is worked out once a step
    end = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(0.0).alias("lo"), F.lit(float(1 << 36)).alias("hi")), step)
    return F.when(found <= 0, 0.0).otherwise(once(end, lambda s: (s["lo"] + s["hi"]) / 2))


def estimate(sketch: DataFrame, most: int, keys: tuple[str, ...] = ("dataset",), size: int | Column = SIZE, decay: float | Column = DECAY) -> DataFrame:
    """keys, k, reach: cardinality from registers in use, frequencies from registers that hold one person. Columns of the law are keys."""
    alone = F.col("low") == F.col("high")
    wide = sketch.groupBy(*keys).agg(F.count("*").cast("double").alias("used"), F.count_if(alone).alias("alone"), *(F.count_if(alone & (F.col("freq") >= k)).alias(f"k{k}") for k in range(1, most + 1)))
    wide = wide.withColumn("reach", cardinality(F.col("used"), size, decay))
    values = F.array(*(F.when(F.col("alone") > 0, F.col("reach") * F.col(f"k{k}") / F.col("alone")).otherwise(F.lit(0.0)) for k in range(1, most + 1)))
    return wide.select(*keys, F.posexplode(values).alias("p", "reach")).select(*keys, (F.col("p") + 1).cast("long").alias("k"), "reach")


def active_registers(sketch: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Registers that hold one person; none is an error."""
    n = sketch.groupBy(*keys).agg(F.count_if(F.col("low") == F.col("high")).alias("n"))
    return n.select(*keys, F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no register holds one person"))).alias("active"))


def variance(n: Column, size: int = SIZE, decay: float = DECAY, cells: int = 4000) -> Column:
    """Variance of the estimate at cardinality n."""
    a, m = decay, float(size)
    c = n * F.lit(a / (m * (1 - math.exp(-a))))
    integral = lambda z: F.aggregate(F.sequence(F.lit(0), F.lit(cells - 1)), F.lit(0.0), lambda s, i: s + F.exp(-z * F.exp(-F.lit(a) * (i + 0.5) / cells))) * F.lit(a / cells)
    filled = F.exp(-c * math.exp(-a)) - F.exp(-c)
    return (integral(c) - integral(2 * c)) * F.lit(a / m) * F.pow(n / filled, F.lit(2)) - n


def monotone(kplus: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """k+ values at least 0 and never rising with k."""
    along = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return kplus.withColumn("reach", F.min(F.greatest(F.col("reach"), F.lit(0))).over(along))


def sane(kplus: DataFrame, impressions: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Where 1+ reach is not below impressions, 1+ becomes impressions - 1 (at least 1) and the rest 0."""
    first = kplus.filter("k = 1").select(*keys, F.col("reach").alias("r1")).join(impressions.select(*keys, "impressions"), list(keys))
    fixed = F.when(F.col("k") == 1, F.greatest(F.col("impressions") - 1, F.lit(1))).otherwise(0).cast("double")
    return kplus.join(first, list(keys)).select(*keys, "k", F.when(F.col("r1") >= F.col("impressions"), fixed).otherwise(F.col("reach").cast("double")).alias("reach"))


def reach_with_noise(prefix: DataFrame, most: int, epsilon: float, seed: str, noise: bool = True, size: int = SIZE, decay: float = DECAY) -> tuple[DataFrame, DataFrame]:
    """(dataset, k, reach) measured through sketches with geometric noise, and the ledger of it."""
    merged = merge(build(prefix, seed, ("dataset", "publisher"), size, decay), ("dataset",))
    r = estimate(merged, most, size=size, decay=decay)
    if noise:
        r = r.withColumn("reach", F.col("reach") + privacy.geometric_noise("dataset", "k", epsilon=epsilon, seed=seed))
    shown = prefix.groupBy("dataset").agg(F.count("*").alias("impressions"))
    return sane(monotone(r), shown), privacy.event(prefix.sparkSession, epsilon, 0.0, "Discrete Laplace", {"epsilon": epsilon})


def approximate_reach(prefix: DataFrame) -> DataFrame:
    """dataset, reach by the built-in distinct-count sketch."""
    return prefix.groupBy("dataset").agg(F.approx_count_distinct("vid", 0.01).alias("reach"))


#: log2 of a stored sketch's registers; its standard error is 1.04 / 2^(STORED / 2).
STORED = 14


def stored_sketches(prefix: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Writes a mergeable sketch of a few kilobytes for each data set and publisher (dataset, publisher, pub_idx, audience) under path, and reads
    what is there: logs of other days or campaigns can be added without the people of the first."""
    found = prefix.groupBy("dataset", "publisher", "pub_idx").agg(F.hll_sketch_agg("vid", F.lit(STORED)).alias("audience"))
    found.write.mode(mode).partitionBy("dataset").parquet(path)
    return prefix.sparkSession.read.parquet(path)


def approximate_unions(sketches: DataFrame, subsets: DataFrame) -> DataFrame:
    """dataset, mask, reach of any sets of publishers (dataset, mask, pub_idx), from stored sketches alone: people aren't looked at again."""
    both = subsets.join(sketches.select("dataset", "pub_idx", "audience"), ["dataset", "pub_idx"])
    return both.groupBy("dataset", "mask").agg(F.hll_sketch_estimate(F.hll_union_agg("audience")).alias("reach"))


def stored_error() -> float:
    """A stored sketch's standard error, as a share of the reach."""
    return 1.04 / 2 ** (STORED / 2)
