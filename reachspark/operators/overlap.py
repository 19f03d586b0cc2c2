"""Venn regions of publishers' audiences and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachspark.functions.ranking import ranked
from reachspark.operators import privacy, sketch
from reachspark.sources.scratch import kept

#: Publishers with spend above which regions aren't made out.
MOST_PUBLISHERS = 20
#: Masks that are set against all regions one by one; more are answered by sums over subsets.
FEW_MASKS = 64


def bit() -> Column:
    return F.expr("shiftleft(1L, pub_idx)")


def user_region(prefix: DataFrame) -> DataFrame:
    """dataset, vid, region (a bit for each publisher that reaches the person), f (impressions)."""
    return prefix.groupBy("dataset", "vid").agg(F.bit_or(bit()).alias("region"), F.count("*").alias("f"))


def powerset(spark: SparkSession, active: int) -> DataFrame:
    """region: every subset but the empty one of the publishers whose bits are set. There are at most 2^20."""
    if active.bit_count() > MOST_PUBLISHERS:
        raise ValueError(f"{active.bit_count()} publishers with spend, {MOST_PUBLISHERS} at most")
    return spark.range(1, active + 1).select(F.col("id").alias("region")).filter(F.col("region").bitwiseAND(F.lit(~active)) == 0)


def active_publishers(limits: DataFrame) -> int:
    """The bits of the publishers that spend something: one number from a row for each."""
    return limits.filter("spend_limit > 0").agg(F.coalesce(F.bit_or(bit()), F.lit(0)).alias("m")).first().m


def venn_regions(users: DataFrame, regions: DataFrame, most: int) -> DataFrame:
    """region, k, reach for every region of `regions`, zeros included, from user_region rows."""
    wide = users.groupBy("region").agg(*(F.count_if(F.col("f") >= k).alias(f"k{k}") for k in range(1, most + 1)))
    all_ = regions.join(wide, "region", "left")
    return all_.select("region", F.posexplode(F.array(*(F.coalesce(f"k{k}", F.lit(0)) for k in range(1, most + 1)))).alias("p", "reach")).select("region", (F.col("p") + 1).cast("long").alias("k"), "reach")


def subset_union_reach(regions: DataFrame, masks: DataFrame) -> DataFrame:
    """mask, reach: people reached by any publisher of each mask, from (region, reach) rows."""
    few = F.broadcast(masks.select("mask")) if masks.count() <= FEW_MASKS else None
    if few is None:  # union = total less the sum over the subsets of the complement, which one transform gives for all masks
        kind = regions.schema["reach"].dataType
        width = max(2, (regions.agg(F.max("region")).first()[0] or 0).bit_length())
        full = regions.agg(F.sum("reach").cast(kind).alias("total"), F.coalesce(F.bit_or("region"), F.lit(0)).cast("long").alias("active"))
        asked = masks.select("mask").join(F.broadcast(full)).withColumn("rest", F.col("active").bitwiseAND(F.bitwise_not(F.col("mask"))))
        inside = subset_sums(regions, width)
        return asked.join(inside, F.col("rest") == F.col("subset"), "left").select("mask", F.coalesce((F.col("total") - F.coalesce("within", F.lit(0))).cast(kind), F.lit(0).cast(kind)).alias("reach"))
    pairs = few.join(regions.select("region", "reach"), F.col("region").bitwiseAND(F.col("mask")) != 0, "left")
    return pairs.groupBy("mask").agg(F.coalesce(F.sum("reach"), F.lit(0)).alias("reach"))


def subset_sums(regions: DataFrame, bits: int) -> DataFrame:
    """subset, within: for every set of publishers below 2^bits that some region's half bits name, the reach of the regions inside it.

    Sums run along the low half of the bits, in an array for each high half, and then along the high half, in an array for each
    low one: two shuffles of 2^bits numbers at most, whatever the number of pairs."""
    low = bits // 2
    n_low = 1 << low
    split = regions.select(F.shiftright("region", low).cast("int").alias("a"), F.col("region").bitwiseAND(F.lit(n_low - 1)).cast("int").alias("b"), F.col("reach").alias("v"))

    kind = regions.schema["reach"].dataType.simpleString()

    def along(df: DataFrame, key: str, place: str, steps: int) -> DataFrame:
        def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k, x in zip(batch[key], batch["x"], strict=True):
                    sums = np.zeros(1 << steps, dtype=np.float64 if kind == "double" else np.int64)
                    sums[[e[place] for e in x]] = [e["v"] for e in x]
                    for s in range(steps):  # those with bit s take what those without it have
                        half = sums.reshape(-1, 2, 1 << s)
                        half[:, 1] += half[:, 0]
                    yield pd.DataFrame({key: np.int32(k), place: np.arange(1 << steps, dtype=np.int32), "v": sums})

        lists = df.groupBy(key).agg(F.collect_list(F.struct(place, "v")).alias("x"))  # 2^steps at most
        return lists.mapInPandas(add_up, f"{key} int, {place} int, v {kind}")

    sums = along(along(split, "a", "b", low), "b", "a", bits - low)
    return sums.select((F.shiftleft(F.col("a").cast("long"), low) + F.col("b")).alias("subset"), F.col("v").alias("within"))


def all_subset_reach(regions: DataFrame, publishers: DataFrame) -> DataFrame:
    """mask, reach, impressions[], spends[] for every region's mask; publishers outside the mask show and spend nothing."""
    union = subset_union_reach(regions, regions.select(F.col("region").alias("mask")).distinct())
    lists = publishers.agg(F.sort_array(F.collect_list(F.struct("pub_idx", "impressions", "spend"))).alias("p"))  # one row for each publisher

    def inside(name: str) -> Column:
        return F.transform("p", lambda x: F.when(F.expr("shiftright(mask, 0)").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), x["pub_idx"])) != 0, x[name]).otherwise(F.lit(0).cast("double" if name == "spend" else "long")))

    return union.join(F.broadcast(lists)).select("mask", "reach", inside("impressions").alias("impressions"), inside("spend").alias("spends"))


def leave_one_out_reach(prefix: DataFrame) -> DataFrame:
    """dataset, kind (all, single, without), pub_idx (null for all), reach: the points that a surface is trained on, for any number of publishers.

    All publishers but one reach everyone but the people whose only publisher it is. So each person is looked at once, and what is
    summed is a row for each person and publisher that reaches them; no set of publishers is ever made out."""
    people = prefix.groupBy("dataset", "vid").agg(F.collect_set("pub_idx").alias("by"))
    rows = people.select("dataset", (F.size("by") == 1).alias("alone"), F.explode(F.concat(F.array(F.lit(None).cast("int")), F.col("by"))).alias("pub_idx"))
    counts = rows.groupBy("dataset", "pub_idx").agg(F.count("*").alias("reach"), F.count_if("alone").alias("alone"))
    total = F.max(F.when(F.col("pub_idx").isNull(), F.col("reach"))).over(Window.partitionBy("dataset"))  # a row for each publisher and one
    one = lambda kind, reach: F.struct(F.lit(kind).alias("kind"), reach.alias("reach"))
    points = F.when(F.col("pub_idx").isNull(), F.array(one("all", F.col("reach")))).otherwise(F.array(one("single", F.col("reach")), one("without", total - F.col("alone"))))
    return counts.select("dataset", "pub_idx", points.alias("points")).select("dataset", "pub_idx", F.inline("points")).select("dataset", "kind", "pub_idx", "reach")


def sample_users(users: DataFrame, n: int, seed: str) -> DataFrame:
    """n reached people without replacement; an error if there are fewer. People with the least hashes are drawn."""
    have = users.count()
    if n > have:
        raise ValueError(f"{n} people to sample, {have} reached")
    drawn = users.withColumn("s_hash", privacy.digest("vid", seed=seed))
    return ranked(drawn, [], F.substring("s_hash", 1, 4), ["s_hash", "vid"], "s_rank").filter(F.col("s_rank") <= n).drop("s_hash", "s_rank")


def scale_regions(regions: DataFrame, cardinality: float) -> DataFrame:
    """Region counts scaled so that they sum to a cardinality; all 0 if the sample is empty."""
    total = regions.agg(F.sum("reach").alias("total"))
    share = F.when(F.col("total") > 0, F.col("reach") * F.lit(float(cardinality)) / F.col("total")).otherwise(0.0)
    return regions.join(F.broadcast(total)).select("region", share.alias("reach"))


def noise_regions(regions: DataFrame, epsilon: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """Regions with geometric noise on every count, 0 at least, and the ledger of it."""
    noisy = regions.withColumn("reach", F.greatest(F.col("reach") + privacy.geometric_noise("region", epsilon=epsilon, seed=seed), F.lit(0)))
    return noisy.select("region", "reach"), privacy.event(regions.sparkSession, epsilon, 0.0, "Discrete Laplace", {"epsilon": epsilon})


def regions_dp(prefix: DataFrame, limits: DataFrame, epsilon: float, seed: str, noise: bool = True, most: int = 1) -> tuple[DataFrame, DataFrame]:
    """(region, reach) of one data set's campaign as a sketch would show them, nothing if no publisher spends, and the ledger of it.

    As many people are drawn as the campaign's sketch has registers with one person. Every region's count, zeros too, gets noise of
    epsilon, and so does the sketch's cardinality that they are scaled to. Only 1+ reach can be told: another `most` is an error."""
    if most != 1:
        raise ValueError("regions tell 1+ reach only")
    spark, active = prefix.sparkSession, active_publishers(limits)
    regions, ledger = powerset(spark, active), spark.createDataFrame([], privacy.LEDGER)
    if not active:
        return regions.select("region", F.lit(0.0).alias("reach")), ledger
    registers = kept(sketch.build(prefix, seed, ("dataset",)), "registers")
    size = F.col("reach") + (privacy.geometric_noise("dataset", epsilon=epsilon, seed=f"{seed}-size") if noise else F.lit(0))
    seen = sketch.estimate(registers, 1).join(sketch.active_registers(registers), "dataset").select("active", size.alias("size")).first()  # one row for the data set
    if seen is None:
        raise ValueError("no register holds one person")
    drawn = venn_regions(sample_users(user_region(prefix), seen.active, f"{seed}-draw"), regions, 1)
    if noise:
        drawn, ledger = noise_regions(drawn, epsilon, seed)
        ledger = privacy.append(ledger, privacy.event(spark, epsilon, 0.0, "Discrete Laplace", {"epsilon": epsilon}))
    return scale_regions(drawn, seen.size), ledger


def overlap_features(publishers: DataFrame) -> DataFrame:
    """i, j, d for pairs of publishers (dataset, pub_idx, reach, max_reach): d = r_i r_j / (2 max(m_i, m_j))."""
    a = publishers.select("dataset", F.col("pub_idx").alias("i"), F.col("reach").alias("ri"), F.col("max_reach").alias("mi"))
    b = publishers.select("dataset", F.col("pub_idx").alias("j"), F.col("reach").alias("rj"), F.col("max_reach").alias("mj"))
    return a.join(b, "dataset").select("dataset", "i", "j", (F.col("ri") * F.col("rj") / (2 * F.greatest("mi", "mj"))).alias("d"))
