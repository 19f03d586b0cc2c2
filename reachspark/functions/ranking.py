"""Positions and running sums along an order, without one task for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], coarse: Column, order: list, name: str = "rank") -> DataFrame:
    """df with the 1-based position of each row among those of its keys, by (coarse, *order).

    `coarse` must not decrease along the order and have many values. Rows are counted for each of its values first;
    what lies before a value is a sum over counts, and only rows of one value are sorted together."""
    df = df.withColumn("r_coarse", coarse)
    before = Window.partitionBy(*keys).orderBy("r_coarse").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, "r_coarse").agg(F.count("*").alias("r_n"))
    counts = counts.select(*keys, "r_coarse", F.coalesce(F.sum("r_n").over(before), F.lit(0)).alias("r_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "r_coarse").orderBy(*order))
    return df.join(counts, [*keys, "r_coarse"]).withColumn(name, (F.col("r_before") + inside).cast("long")).drop("r_coarse", "r_before")
