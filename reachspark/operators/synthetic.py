"""Synthetic logs made by Spark: frequencies, prices, and how audiences overlap. A seed gives the same rows on any cluster."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachspark.functions.ranking import ranked
from reachspark.functions.search import once
from reachspark.operators.privacy import digest, normal, uniform
from reachspark.sources.scratch import kept

#: The greatest frequency that a heavy-tailed person gets.
MOST = 10_000


#: The greatest mean of a Poisson number that is drawn at once; larger ones are sums of such numbers.
MOST_MEAN = 100


#: Values that an inversion tries at first; only numbers beyond them go on to the last one.
FIRST = 8


def poisson(mean: Column, *key: Column | str, seed: str, most: int = 200) -> Column:
    """A Poisson number by inversion: the first k whose cumulative probability passes a uniform number. A mean over MOST_MEAN is an error.

    Mean and uniform number are worked out once, and a number that is found takes no further steps."""
    mean = F.when(mean > MOST_MEAN, F.raise_error(F.lit("this mean needs a sum of several numbers")).cast("double")).otherwise(mean)

    def inverted(x: Column) -> Column:
        mean, u, zero = x["mean"], x["u"], F.exp(-x["mean"])
        start = F.struct(zero.alias("p"), zero.alias("c"), F.when(u <= zero, 0).alias("k"))
        more = lambda s, j: F.struct((s["p"] * mean / j).alias("p"), (s["c"] + s["p"] * mean / j).alias("c"), F.when(u <= s["c"] + s["p"] * mean / j, j).alias("k"))
        walk = lambda s, low, high: F.aggregate(F.sequence(F.lit(low), F.lit(high)), s, lambda s, j: F.when(s["k"].isNotNull(), s).otherwise(more(s, j)))
        if most <= FIRST:
            return F.coalesce(walk(start, 1, most)["k"], F.lit(most))
        return once(walk(start, 1, FIRST), lambda s: F.when(s["k"].isNotNull(), s["k"]).otherwise(F.coalesce(walk(s, FIRST + 1, most)["k"], F.lit(most))))

    return once(F.struct(mean.alias("mean"), uniform(*key, seed=seed).alias("u")), inverted)


def poisson_sum(mean: Column, *key: Column | str, seed: str) -> Column:
    """A Poisson number of any mean: a sum of as many as it takes, each numbered in its key."""
    many = F.struct(mean.alias("mean"), F.floor(mean / MOST_MEAN).cast("int").alias("parts"))
    return once(many, lambda m: F.aggregate(F.sequence(F.lit(0), m["parts"]), F.lit(0), lambda a, part: a + poisson(m["mean"] / (m["parts"] + 1), *key, part, seed=seed)))


def gamma(shape: Column | float, scale: Column | float, *key: Column | str, seed: str) -> Column:
    """A gamma number by the cube of a normal one, the first of eight tries that is accepted (or the mean, one in 10^8)."""
    shape, scale = (x if isinstance(x, Column) else F.lit(float(x)) for x in (shape, scale))
    d = F.when(shape < 1, shape + 1).otherwise(shape) - F.lit(1 / 3)
    c = 1 / F.sqrt(9 * d)
    tries = []
    for i in range(8):
        x = normal(*key, seed=f"{seed}-{i}")
        v = F.pow(1 + c * x, F.lit(3.0))
        tries.append(F.when((v > 0) & (F.log(uniform(*key, seed=f"{seed}-u{i}")) < 0.5 * x * x + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300)))), d * v))
    boost = F.when(shape < 1, F.pow(uniform(*key, seed=f"{seed}-b"), 1 / shape)).otherwise(1.0)
    return F.coalesce(*tries, d) * boost * scale


def repeated(people: DataFrame, frequency: Column) -> DataFrame:
    """people (vid) once for each impression, with i, its number."""
    return people.withColumn("i", F.explode(F.sequence(F.lit(1), frequency.cast("int"))))


def homogeneous(people: DataFrame, rate: float, seed: str) -> DataFrame:
    rate_ = F.lit(float(rate))
    return repeated(people, 1 + (poisson(rate_, "vid", seed=seed) if rate <= MOST_MEAN else poisson_sum(rate_, "vid", seed=seed)))


def heterogeneous(people: DataFrame, shape: float, scale: float, seed: str) -> DataFrame:
    """Frequencies 1 + Poisson with gamma rates. A rate of over 100 is drawn as a sum of that many equal parts below it, so none is cut."""
    rates = people.withColumn("rate", gamma(shape, scale, "vid", seed=seed))
    parts = rates.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor(F.col("rate") / 100).cast("int"))))
    share = F.col("rate") / (F.floor(F.col("rate") / 100) + 1)
    drawn = parts.withColumn("n", poisson(share, "vid", "part", seed=f"{seed}-p")).groupBy("vid").agg(F.sum("n").alias("n"))
    return repeated(drawn, 1 + F.col("n")).drop("n")


def zeta(exponent: Column, *key: Column | str, seed: str, most: int = MOST) -> Column:
    """A number with P(f) in proportion to f^-exponent, by rejection from a Pareto law: the first of 32 tries accepted, else 1."""
    right = F.when(exponent <= 1, F.raise_error(F.lit("the exponent must be over 1")).cast("double")).otherwise(exponent)

    def drawn(exponent: Column) -> Column:
        b = F.pow(F.lit(2.0), exponent - 1)
        tries = []
        for i in range(32):
            x = F.floor(F.pow(uniform(*key, seed=f"{seed}-{i}"), -1 / (exponent - 1)))
            t = F.pow(1 + 1 / x, exponent - 1)
            tries.append(F.when((x <= most) & (uniform(*key, seed=f"{seed}-v{i}") * x * (t - 1) / (b - 1) <= t / b), x))
        return F.coalesce(*tries, F.lit(1))

    return once(right, drawn)


def heavy_tailed(people: DataFrame, exponent: float, seed: str, most: int = MOST) -> DataFrame:
    """Frequencies with P(f) in proportion to f^-exponent."""
    if exponent <= 1:
        raise ValueError("the exponent must be over 1")
    return repeated(people, zeta(F.lit(float(exponent)), "vid", seed=seed, most=most))


def shuffled(impressions: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """A random order of impressions (keys, vid, i): rank from 1 on. Ranges of the hash are counted first, then ranked inside."""
    df = impressions.withColumn("h", digest("vid", "i", seed=seed))
    return ranked(df, keys, F.substring("h", 1, 4), ["h", "vid", "i"], "rank").drop("h")


def price_fixed(ranked_log: DataFrame, cost: float) -> DataFrame:
    return ranked_log.withColumn("spend", F.col("rank") * F.lit(cost))


def publisher_sizes(sets: DataFrame) -> DataFrame:
    """dataset, publisher (1-based), size for rows (dataset, publishers, largest, ratio): each size is the floor of the one
    before times the (publishers - 1)-th root of ratio."""
    rate = F.when(F.col("publishers") > 1, F.pow(F.col("ratio"), 1.0 / (F.col("publishers") - 1))).otherwise(1.0)
    df = sets.withColumn("rate", rate)
    grow = lambda a, _: F.concat(a, F.array(F.floor(F.element_at(a, -1) * F.col("rate"))))
    sizes = F.when(F.col("publishers") > 1, F.aggregate(F.sequence(F.lit(2), F.greatest("publishers", F.lit(2)).cast("int")), F.array(F.col("largest").cast("long")), grow)).otherwise(F.array(F.col("largest").cast("long")))
    return df.select("dataset", F.posexplode(sizes).alias("p", "size")).select("dataset", (F.col("p") + 1).alias("publisher"), "size")


def overlap_full(log: DataFrame) -> DataFrame:
    """Publishers share their people as they are."""
    return log


def overlap_disjoint(log: DataFrame, sizes: DataFrame) -> DataFrame:
    """Moves each publisher's people (vid from 0 on, below size) behind those of the publishers before it."""
    before = Window.partitionBy("dataset").orderBy("publisher").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).select("dataset", "publisher", "offset")
    return log.join(offset, ["dataset", "publisher"]).withColumn("vid", F.col("vid") + F.col("offset")).drop("offset")


def overlap_independent(sizes: DataFrame, universe: DataFrame, seed: str) -> DataFrame:
    """dataset, publisher, vid: each publisher's people are drawn from the universe (vid) at random, those of the least hashes.

    Only people whose hash lies below a publisher's share of the universe, and a margin of six deviations, are ranked; should a
    publisher have too few of them, all are."""
    n = universe.count()
    drawn = sizes.crossJoin(universe.select("vid")).withColumn("h", digest("dataset", "publisher", "vid", seed=seed))
    share = (F.col("size") + 6 * F.sqrt("size") + 20) / F.lit(float(max(n, 1)))
    likely = drawn.filter(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") < share * F.lit(float(1 << 32)))
    short = sizes.join(likely.groupBy("dataset", "publisher").agg(F.count("*").alias("n")), ["dataset", "publisher"], "left").filter(F.coalesce("n", F.lit(0)) < F.least(F.col("size"), F.lit(n)))
    rows = likely if short.isEmpty() else drawn
    return ranked(rows, ["dataset", "publisher"], F.substring("h", 1, 5), ["h", "vid"], "r").filter(F.col("r") <= F.col("size")).select("dataset", "publisher", "vid")


def overlap_sequential(sizes: list[int], people: DataFrame, share: float, seed: str, with_all: bool = False, order: str = "original") -> DataFrame:
    """publisher, vid: each publisher shares `share` of its people with the one before (or with all before), the rest are new.

    people (vid, from 0 on without gaps) are given out in order; publishers are few, and each step adds to the plan only.
    Publishers come in the order of their sizes as given ("original"), the other way round ("reversed") or by hash ("random")."""
    if order not in ("original", "reversed", "random"):
        raise ValueError(f"no order {order}")
    place = list(range(len(sizes)))
    place = place[::-1] if order == "reversed" else sorted(place, key=lambda p: hashlib.md5(f"{p}/{seed}".encode()).hexdigest()) if order == "random" else place
    sizes = [sizes[p] for p in place]
    parts, fresh = [], 0
    for p, size in enumerate(sizes):
        earlier = None if not p else (reduce(DataFrame.union, parts).select("vid").distinct() if with_all else parts[-1].select("vid"))
        common = 0 if earlier is None else int(min(round(share * size), sizes[p - 1] if not with_all else fresh))
        new = people.filter((F.col("vid") >= fresh) & (F.col("vid") < fresh + size - common)).select("vid")
        fresh += size - common
        if common:
            drawn = ranked(earlier.withColumn("h", digest("vid", seed=f"{seed}-{p}")), [], F.substring("h", 1, 4), ["h", "vid"], "r")
            new = new.union(drawn.filter(F.col("r") <= common).select("vid"))
        parts.append(new.select(F.lit(place[p]).alias("publisher"), "vid"))
    return reduce(DataFrame.union, parts)


def relabel(log: DataFrame, labels: DataFrame) -> DataFrame:
    """The i-th smallest vid of each publisher becomes the i-th smallest of its labels; sizes must match."""
    keys = ["dataset", "publisher"]
    olds = ranked(log.select(*keys, "vid").distinct(), keys, F.shiftright("vid", 10), ["vid"], "i")
    news = ranked(labels.select(*keys, F.col("vid").alias("new")).distinct(), keys, F.shiftright("new", 10), ["new"], "i")
    both = olds.join(news, [*keys, "i"], "full").withColumn("new", F.when(F.col("new").isNull() | F.col("vid").isNull(), F.raise_error(F.lit("sizes differ")).cast("long")).otherwise(F.col("new")))
    return log.join(both.select(*keys, "vid", "new"), [*keys, "vid"]).withColumn("vid", F.col("new")).drop("new")


def generate_design(sets: DataFrame, people: DataFrame, rate: float, cost: float, seed: str) -> DataFrame:
    """Logs (dataset, publisher, seq, vid, spend) for all rows (dataset, publishers, largest, ratio) in one job; people (vid)
    must reach the largest size. Every publisher reaches the first of them; vids differ from publisher to publisher."""
    each = publisher_sizes(sets).join(people, F.col("vid") < F.col("size")).select("dataset", "publisher", "vid")
    rows = repeated(each, 1 + poisson(F.lit(float(rate)), "dataset", "publisher", "vid", seed=seed))
    return price_fixed(shuffled(rows, ["dataset", "publisher"], seed), cost).select("dataset", "publisher", F.col("rank").alias("seq"), "vid", "spend")


#: People that one row stands for until they are told apart.
CHUNK = 10_000
LAWS, OVERLAPS, ORDERS = ("homogeneous", "heterogeneous", "heavy_tailed"), ("full", "disjoint", "sequential", "independent"), ("original", "reversed", "random")


def numbered(df: DataFrame, count: Column, name: str) -> DataFrame:
    """df with a row for each number from 0 to count - 1, in chunks that are tasks' work one by one."""
    parts = df.withColumn("x_n", count.cast("long")).filter("x_n > 0").withColumn("x_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("x_n") - 1) / CHUNK))))
    spread = parts.repartition("dataset", "publisher", "x_part")
    return spread.withColumn(name, F.explode(F.sequence(F.col("x_part") * CHUNK, F.least((F.col("x_part") + 1) * CHUNK, F.col("x_n")) - 1))).drop("x_n", "x_part")


def audiences(sets: DataFrame, seed: str) -> DataFrame:
    """sets (a row for each data set) with publisher, place (0, 1, .. for its people) and vid, by each row's own kind of overlap.

    full: place is the person. disjoint: behind the people of the publishers before. sequential: a publisher's first `share` of people are the
    last ones of the publisher before it, as many as that has, in the order original, reversed or random. So these three are an offset
    for each publisher, whatever their number. independent: the people of the least hashes of a universe, drawn for each publisher."""
    sizes = publisher_sizes(sets).join(sets, "dataset")  # a row for each publisher
    sign = F.when(F.col("order") == "reversed", -F.col("publisher")).otherwise(F.col("publisher"))
    along = Window.partitionBy("dataset").orderBy(F.when(F.col("order") == "random", digest("dataset", "publisher", seed=f"{seed}-order")).otherwise(""), sign)
    sizes = sizes.withColumn("x_before", F.coalesce(F.lag("size").over(along), F.lit(0)))
    common = F.least(F.bround(F.col("share") * F.col("size")).cast("long"), F.col("x_before"))
    step = F.when(F.col("overlap") == "full", 0).when(F.col("overlap") == "disjoint", F.col("x_before")).otherwise(F.col("x_before") - F.coalesce(common, F.lit(0)))
    sizes = kept(sizes.withColumn("x_offset", F.sum(step).over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("x_before"), "sizes")
    moved = numbered(sizes.filter("overlap <> 'independent'"), F.col("size"), "place").withColumn("vid", F.col("place") + F.col("x_offset"))
    drawn = numbered(sizes.filter("overlap = 'independent'"), F.col("universe"), "vid").withColumn("x_h", digest("dataset", "publisher", "vid", seed=f"{seed}-draw"))
    drawn = ranked(drawn, ["dataset", "publisher"], F.substring("x_h", 1, 5), ["x_h", "vid"], "x_r").filter(F.col("x_r") <= F.col("size")).withColumn("place", F.col("x_r") - 1)
    return moved.drop("x_offset").unionByName(drawn.drop("x_offset", "x_h", "x_r"))


def generate_designs(sets: DataFrame, seed: str) -> DataFrame:
    """Logs (dataset, publisher, seq, vid, spend) of all data sets in one job. Each row of sets says how its data set is made: dataset, publishers,
    largest, ratio (sizes of publishers), law with a and b (homogeneous: rate; heterogeneous: shape and scale; heavy_tailed: exponent), cost of
    an impression, overlap with share and order (sequential) or universe (independent). Names that don't exist are errors."""
    named = {"law": LAWS, "overlap": OVERLAPS, "order": ORDERS}
    wrong = [F.when(~F.coalesce(F.col(c), F.lit("original" if c == "order" else "")).isin(*known), F.concat(F.lit(f"no {c} "), F.coalesce(F.col(c), F.lit("null")))) for c, known in named.items()]
    if bad := sets.select(F.coalesce(*wrong).alias("bad")).filter("bad is not null").head():
        raise ValueError(bad.bad)
    people = audiences(sets.withColumn("order", F.coalesce("order", F.lit("original"))), seed)
    key = ("dataset", "publisher", "place")
    rates = once(F.struct("a", "b"), lambda p: gamma(p["a"], p["b"], *key, seed=f"{seed}-g"))
    rate = F.when(F.col("law") == "homogeneous", F.col("a")).otherwise(rates)
    frequency = F.when(F.col("law") == "heavy_tailed", zeta(F.col("a"), *key, seed=f"{seed}-z")).otherwise(1 + poisson_sum(rate, *key, seed=f"{seed}-p"))
    shown = repeated(people.select("dataset", "publisher", "place", "vid", "law", "a", "b", "cost"), frequency).drop("law", "a", "b")
    rows = shuffled(shown, ["dataset", "publisher"], f"{seed}-s")
    return rows.select("dataset", "publisher", F.col("rank").alias("seq"), "vid", (F.col("rank") * F.col("cost")).alias("spend"))
