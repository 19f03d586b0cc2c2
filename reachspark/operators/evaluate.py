"""Trials: true against predicted reach, one row of metrics for each trial."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachspark.operators import sketch
from reachspark.operators.reach import K

QUANTILES = [k / 10 for k in range(1, 10)]
#: Exact frequencies that the shuffle distance looks at.
BUCKETS = 5
#: Multiples of the campaign's spend at which a curve is scored.
SPEND_FRACTIONS = [k / 10 for k in range(1, 31)]


def joined(truth: DataFrame, model: DataFrame) -> DataFrame:
    """truth and model (trial, point_id, kplus array) side by side."""
    return truth.select("trial", "point_id", F.col("kplus").alias("x")).join(model.select("trial", "point_id", F.col("kplus").alias("y")), ["trial", "point_id"])


def relative(k: int = 1) -> Column:
    """|true - predicted| / true of k+ reach; null where the truth is 0."""
    x, y = F.get("x", F.lit(k - 1)), F.get("y", F.lit(k - 1))
    return F.when(x != 0, F.abs(x - y) / x)


def error_metrics() -> dict[str, Column]:
    x, y = F.get("x", F.lit(0)), F.get("y", F.lit(0))
    share = F.when(x != 0, (x - y) / x)
    return {
        "npoints": F.count("*"), "mean_error": F.avg(x - y), "mean_abs_error": F.avg(F.abs(x - y)), "mean_squared_error": F.avg((x - y) * (x - y)), "mean_abs_relative_error": F.avg(relative()),
        "mean_squared_relative_error": F.avg(share * share), "var_error": F.var_pop(x - y), "var_relative_error": F.var_pop(share),
    }


def mare_by_frequency(most: int = 9) -> dict[str, Column]:
    """Mean relative errors of k+ reach; null if some point has fewer than k values."""
    least = F.least(F.min(F.size("x")), F.min(F.size("y")))
    return {f"mare_freq_at_least_{k}": F.when(least >= k, F.avg(relative(k))) for k in range(2, most + 1)}


def error_quantiles() -> dict[str, Column]:
    return {f"relative_error_q{round(q * 100)}": F.percentile(relative(), q) for q in QUANTILES}


def shuffle_distance(x: Column, y: Column, n: int = BUCKETS) -> Column:
    """Half the absolute difference of the shares of the first n exact frequencies; 1 with too few, 0.5 if a side is empty."""
    exact = lambda a: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(a, i) - F.get(a, i + 1))
    total = lambda a: F.get(a, F.lit(0)) - F.get(a, F.lit(n))
    apart = F.aggregate(F.zip_with(exact(x), exact(y), lambda p, q: F.abs(p / total(x) - q / total(y))), F.lit(0.0), lambda a, v: a + v) / 2
    return F.when((F.size(x) <= n) | (F.size(y) <= n), 1.0).when((total(x) == 0) | (total(y) == 0), 0.5).otherwise(apart)


def shuffle_metrics() -> dict[str, Column]:
    d = shuffle_distance(F.col("x"), F.col("y"))
    return {"mean_shuffle_distance": F.avg(d), "mean_squared_shuffle_distance": F.avg(d * d), "var_shuffle_distance": F.var_pop(d)}


def metrics(both: DataFrame, *groups: dict[str, Column]) -> DataFrame:
    """One row of metrics for each trial, all in one aggregation."""
    every = reduce(lambda a, b: a | b, groups) if groups else error_metrics() | mare_by_frequency() | error_quantiles() | shuffle_metrics()
    return both.groupBy("trial").agg(*(v.alias(k) for k, v in every.items()))


def with_failures(trials: DataFrame, scored: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Every trial: its metrics, or nulls and what went wrong; succeeded is 1 or 0."""
    out = trials.join(scored.withColumn("succeeded", F.lit(1)), "trial", "left")
    out = out.join(errors.select("trial", "error"), "trial", "left") if errors is not None else out.withColumn("error", F.lit(None).cast("string"))
    return out.withColumn("succeeded", F.coalesce("succeeded", F.lit(0)))


def spend_fraction_errors(both: DataFrame, most: int = K) -> DataFrame:
    """trial, and a column for each fraction of spend with the relative error of 1+ reach, then for each k < most those of k+ reach;
    both: trial, fraction (whole percent of the campaign's spend), x, y."""
    names = [round(100 * f) for f in SPEND_FRACTIONS]
    wide = both.groupBy("trial").pivot("fraction", names).agg(*(F.first(relative(k)).alias(f"e{k}") for k in range(1, max(2, most))))
    first = [F.col(f"`{n}_e1`" if most > 2 else f"`{n}`").alias(f"relative_error_at_{n}") for n in names]
    rest = [F.col(f"`{n}_e{k}`" if most > 2 else f"`{n}`").alias(f"freq_{k}_relative_error_at_{n}") for k in range(1, most) for n in names]
    return wide.select("trial", *first, *rest)


def privacy_columns(trials: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Trials (trial, epsilon_budget, delta_budget) with what their events (trial, epsilon, delta, mechanism) spent; events of a
    trial are all over the same people."""
    spent = ledgers.groupBy("trial").agg(F.sum("epsilon").alias("epsilon_used"), F.sum("delta").alias("delta_used"), F.array_join(F.sort_array(F.collect_set("mechanism")), "/").alias("mechanisms"))
    none = {"epsilon_used": 0.0, "delta_used": 0.0, "mechanisms": ""}
    return trials.join(spent, "trial", "left").fillna(none)


def trial_columns(trials: DataFrame, stats: DataFrame) -> DataFrame:
    """The independent variables of each trial: what was chosen for it, and the size of what it was tried on.

    trials: dataset, trial, strategy, curve, surface, fractions (of the publishers' spend), and sketch_size, decay_rate, replica_id and
    max_frequency where they aren't the usual ones; stats: dataset_stats. Names of models become single_pub_model and multi_pub_model. A
    trial of a data set that isn't there has null sizes; no fractions give a null mean. What else trials have stays."""
    usual = {"replica_id": (0, "long"), "sketch_size": (sketch.SIZE, "long"), "decay_rate": (sketch.DECAY, "double"), "max_frequency": (K, "long")}
    chosen = {k: F.coalesce(*([F.col(k).cast(t)] if k in trials.columns else []), F.lit(v).cast(t)) for k, (v, t) in usual.items()}
    average = F.when(F.size("fractions") > 0, F.aggregate("fractions", F.lit(0.0), lambda a, x: a + x) / F.size("fractions"))
    sizes = stats.select("dataset", "reach", "universe", F.col("publishers").alias("campaigns"), F.col("max_publisher_reach").alias("largest_pub_reach"))
    named = trials.withColumnsRenamed({"curve": "single_pub_model", "surface": "multi_pub_model"}).withColumns(chosen | {"average_spend_fraction": average})
    return named.drop("reach", "universe", "campaigns", "largest_pub_reach").join(sizes, "dataset", "left")
