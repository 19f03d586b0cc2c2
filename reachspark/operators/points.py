"""Test points and experimental designs, made by Spark from the sizes of the data."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachspark.operators.privacy import digest, uniform
from reachspark.sources.scratch import kept

MOST_LATIN = 2000
#: Coordinates of all candidates' points up to which they are broadcast (8 bytes each).
BROADCAST_NUMBERS = 4_000_000


def grid_points(limits: DataFrame, g: int) -> DataFrame:
    """dataset, point_id, publisher, pub_idx, spend: g^p vectors, each coordinate one of g inner parts of its limit.

    limits: dataset, publisher, pub_idx, spend_limit. Coordinates are the digits of the point's number in base g."""
    n = limits.groupBy("dataset").agg(F.count("*").alias("p"))
    ids = n.withColumn("point_id", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(float(g)), "p").cast("long") - 1)))
    digit = F.floor(F.col("point_id") / F.pow(F.lit(float(g)), F.col("pub_idx"))) % g
    return ids.join(limits, "dataset").select("dataset", "point_id", "publisher", "pub_idx", (F.col("spend_limit") * (digit + 1) / (g + 1)).alias("spend"))


def uniform_points(limits: DataFrame, n: int, seed: str, per_publisher: int = 0) -> DataFrame:
    """Independent uniform coordinates; at least per_publisher points for each publisher."""
    count = limits.groupBy("dataset").agg(F.greatest(F.lit(n), F.count("*") * per_publisher).alias("n"))
    ids = count.withColumn("point_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)))
    return ids.join(limits, "dataset").select("dataset", "point_id", "publisher", "pub_idx", (F.col("spend_limit") * uniform("point_id", "publisher", seed=seed)).alias("spend"))


def latin_unit(spark: SparkSession, dimensions: DataFrame, n: int, seed: str, tries: int = 4) -> DataFrame:
    """dim, point_id, u: a Latin hypercube on the unit cube. Of several, that with the greatest least distance of two points.

    dimensions has a column dim. More than MOST_LATIN points are not made, with a warning: a candidate's distances are two million rows."""
    if n > MOST_LATIN:
        warnings.warn(f"{MOST_LATIN} points instead of {n}", stacklevel=2)
        n = MOST_LATIN
    cells = dimensions.select("dim").crossJoin(spark.range(tries).select(F.col("id").alias("try"))).crossJoin(spark.range(n).select(F.col("id").alias("point_id")))
    stratum = F.row_number().over(Window.partitionBy("dim", "try").orderBy(digest("dim", "try", "point_id", seed=seed), "point_id")) - 1
    cells = cells.withColumn("u", (stratum + uniform("dim", "try", "point_id", seed=f"{seed}-in")) / n)
    if tries > 1:
        cells = kept(cells, "cells")
        lists = cells.groupBy("try", "point_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "u"))), lambda x: x["u"]).alias("us"))
        other = kept(lists.select("try", F.col("point_id").alias("q"), F.col("us").alias("vs")), "points")
        numbers = tries * n * dimensions.count()
        pairs = lists.repartition("try", "point_id").join(other.hint("broadcast" if numbers <= BROADCAST_NUMBERS else "merge"), "try").filter("point_id < q")
        square = F.aggregate(F.zip_with("us", "vs", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
        apart = pairs.select("try", square.alias("d"))
        best = apart.groupBy("try").agg(F.min("d").alias("d")).agg(F.max_by("try", "d").alias("try"))
        cells = cells.join(F.broadcast(best), "try", "left_semi") if n > 1 else cells.filter("try = 0")
    return cells.select("dim", "point_id", "u")


def latin_points(limits: DataFrame, n: int, seed: str, tries: int = 4) -> DataFrame:
    unit = latin_unit(limits.sparkSession, limits.select(F.concat_ws("/", "dataset", "publisher").alias("dim")), n, seed, tries)
    named = limits.withColumn("dim", F.concat_ws("/", "dataset", "publisher"))
    return named.join(unit, "dim").select("dataset", "point_id", "publisher", "pub_idx", (F.col("spend_limit") * F.col("u")).alias("spend"))


def points_for(strategy: str, limits: DataFrame, **how) -> DataFrame:
    makers = {"grid": grid_points, "uniform": uniform_points, "latin": latin_points}
    if strategy not in makers:
        raise ValueError(f"no test points {strategy}")
    return makers[strategy](limits, **how)


def factorial_design(spark: SparkSession, levels: dict[str, list]) -> DataFrame:
    """Every combination of the levels of each parameter."""
    return reduce(lambda df, x: df.withColumn(x[0], F.explode(F.array(*map(F.lit, x[1])))), levels.items(), spark.range(1)).drop("id")


def latin_design(spark: SparkSession, levels: dict[str, list], n: int, seed: str) -> DataFrame:
    """n combinations of levels, spread over each parameter's levels evenly."""
    dims = spark.createDataFrame([(k,) for k in levels], "dim string")
    unit = latin_unit(spark, dims, n, seed).groupBy("point_id").pivot("dim", list(levels)).agg(F.first("u"))
    chosen = [F.element_at(F.array(*map(F.lit, v)), (F.floor(F.col(k) * len(v)) + 1).cast("int")).alias(k) for k, v in levels.items()]
    return unit.select("point_id", *chosen)


def trial_matrix(datasets: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Every descriptor for every data set; descriptors are few and go to the data sets."""
    return datasets.crossJoin(F.broadcast(descriptors))


def with_trial_name(trials: DataFrame, columns: list[str], name: str = "trial") -> DataFrame:
    """A key of all parameters: name=value, joined by commas."""
    return trials.withColumn(name, F.concat_ws(",", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns)))


def dedupe_trials(trials: DataFrame) -> DataFrame:
    return trials.dropDuplicates(["dataset", "trial"])
