"""Strategies: measure campaigns, fit a curve to each publisher and a surface to all of them, and predict reach by spend.

A campaign is a data set with a spend limit for each publisher; `dataset` names it, so the same log under several limits is several
campaigns. All campaigns are measured, fitted and predicted by the same jobs. Curves and surfaces are chosen by name; rows of one
table can carry different ones."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachspark.functions.joins import beside
from reachspark.functions.search import last_at_most
from reachspark.operators import curves, overlap, privacy, reach, sketch, surfaces
from reachspark.sources.scratch import kept

#: Frequencies that are measured for a single publisher's strategy, and for the publishers of several.
MOST_SINGLE, MOST_EACH = 20, 10

PARAMETERS = {"rho": "double", "alpha": "double", "beta": "double", "n": "double", "prefix": "array<double>", "components": "array<double>", "weights": "array<double>", "shown": "double", "universe": "double", "spends": "array<double>", "steps": "array<array<double>>"}
#: Components of a Poisson mixture.
COMPONENTS = 30


def parameters(fit: DataFrame, **own: Column) -> DataFrame:
    """fit with all of PARAMETERS, null where a model has no such one."""
    return fit.select("key", *(own.get(k, F.lit(None).cast(t)).cast(t).alias(k) for k, t in PARAMETERS.items()))


def goerg(points: DataFrame) -> DataFrame:
    good = points.filter((F.col("impressions") > F.col("reach")) & (F.col("reach") > 0))
    return parameters(curves.goerg_fit(good), rho=F.col("rho"))


def gamma_poisson(points: DataFrame) -> DataFrame:
    good = points.filter((F.col("impressions") > F.col("reach")) & (F.col("reach") > 0))
    return parameters(curves.gamma_poisson_fit(good), alpha=F.col("alpha"), beta=F.col("beta"), n=F.col("n"))


def kinflated(points: DataFrame) -> DataFrame:
    good = points.filter((F.col("impressions") > F.col("reach")) & (F.col("reach") > 0))
    return parameters(curves.kinflated_fit(good), alpha=F.col("alpha"), beta=F.col("beta"), n=F.col("n"), prefix=F.col("prefix"))


def dirac(points: DataFrame) -> DataFrame:
    """A Poisson mixture of everyone's frequencies: those not reached, of the audience's size `people`, come first."""
    good = points.filter((F.col("impressions") > 0) & (F.col("people") > F.col("reach")))
    h = F.concat(F.array(F.col("people") - F.col("reach")), F.transform("histogram", lambda x: F.greatest(x, F.lit(0.0))))
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x)
    rows = good.withColumn("h", h).select("key", "impressions", "people", F.col("h").alias("histogram"), curves.poisson_grid(F.transform("h", lambda x: x / total), COMPONENTS).alias("components"))
    fit = curves.dirac_fit(rows.select("key", "histogram", "components")).filter("error is null").join(rows.select("key", "impressions", "people"), "key")
    return parameters(fit, components=F.col("components"), weights=F.col("weights"), shown=F.col("impressions"), universe=F.col("people"), n=curves.dirac_most(F.col("components"), F.col("weights"), F.col("people")))


def true(points: DataFrame) -> DataFrame:
    """The publisher's true curve at the spends that are asked for, which true_curves() put beside the points."""
    if "true_spends" not in points.columns:
        raise ValueError("true curves need true_curves()")
    return parameters(points.filter("true_spends is not null"), spends=F.col("true_spends"), steps=F.col("true_steps"), n=F.col("true_reach"))


#: Curves by name: what fits points (key, impressions, reach, spend, histogram, people).
CURVES: dict[str, Callable[[DataFrame], DataFrame]] = {"goerg": goerg, "gamma_poisson": gamma_poisson, "kinflated_gamma_poisson": kinflated, "dirac_mixture": dirac, "true": true}


def true_curves(log: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """dataset, publisher, true_spends, true_steps, true_reach: a row for each publisher with its k+ reach at all the spends of `asked`
    (dataset, publisher, spend), in order of spend, and its greatest reach. A spend between two of them has the reach of the smaller one."""
    asked = kept(asked.select("dataset", "publisher", "spend").distinct(), "asked")
    curve = reach.reach_curve(log, asked, most).groupBy("dataset", "publisher", "spend").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "reach"))), lambda x: x["reach"].cast("double")).alias("steps"))
    rows = curve.groupBy("dataset", "publisher").agg(F.sort_array(F.collect_list(F.struct("spend", "steps"))).alias("rows"))  # as many as there are points
    top = reach.publisher_stats(log).select("dataset", "publisher", F.col("reach").cast("double").alias("true_reach"))
    return rows.select("dataset", "publisher", F.col("rows.spend").alias("true_spends"), F.col("rows.steps").alias("true_steps")).join(top, ["dataset", "publisher"])


def true_kplus(spend: Column, most: int) -> Column:
    place = last_at_most(F.col("spends"), spend)
    steps = F.slice(F.get("steps", place - 1), 1, most)
    return F.when(place == 0, F.array_repeat(F.lit(0.0), most)).otherwise(steps)


def curve_kplus(impressions: Column, most: int, spend: Column | None = None) -> Column:
    """k+ reach by the curve that a row (curve and PARAMETERS) carries; nothing is reached without impressions. True curves go by spend."""
    p = {k: F.col(k) for k in PARAMETERS}
    usual = F.when(F.col("curve") == "goerg", curves.goerg_kplus(impressions, p["rho"], most))
    usual = usual.when(F.col("curve") == "gamma_poisson", curves.gamma_poisson_kplus(impressions, p["alpha"], p["beta"], p["n"], most))
    usual = usual.when(F.col("curve") == "kinflated_gamma_poisson", curves.kinflated_kplus(impressions, p["alpha"], p["beta"], p["n"], p["prefix"], most))
    usual = usual.when(F.col("curve") == "dirac_mixture", curves.dirac_kplus(impressions, p["shown"], p["components"], p["weights"], p["universe"], most))
    usual = F.when(impressions <= 0, F.array_repeat(F.lit(0.0), most)).otherwise(usual)
    return usual if spend is None else F.when(F.col("curve") == "true", true_kplus(spend, most)).otherwise(usual)


def most_reach() -> Column:
    """The greatest reach of a row's curve."""
    return F.coalesce("rho", "n")


def impressions_at_quantile(q: Column) -> Column:
    """The greatest whole number of impressions at which a row's curve reaches q of its greatest reach at most."""
    return curves.curve_inverse(q, most_reach(), lambda x: curve_kplus(x, 1)[0])


def spend_at_quantile(q: Column) -> Column:
    """The same by spend, at the row's cost of an impression (cpi)."""
    return curves.curve_inverse(q, most_reach(), lambda x: curve_kplus(curves.impressions_for_spend(x, F.col("cpi")), 1, x)[0])


def fit_curves(points: DataFrame) -> DataFrame:
    """points (key, curve, impressions, reach, spend, histogram) with PARAMETERS and cpi; what can't be fitted has an error.

    Rows go to their curve's fit by name and come together again."""
    points = kept(points, "points")
    names = [r.curve for r in points.select("curve").distinct().collect()]  # names of models
    if unknown := sorted(set(names) - set(CURVES)):
        raise ValueError(f"no curve {unknown[0]}")
    if not names:
        return points.select("*", *(F.lit(None).cast(t).alias(k) for k, t in PARAMETERS.items()), F.lit(None).cast("double").alias("cpi"), F.lit(None).cast("string").alias("error"))
    fits = reduce(DataFrame.unionByName, [CURVES[n](points.filter(F.col("curve") == n)).withColumn("curve", F.lit(n)) for n in sorted(names)])
    out = points.join(fits, ["key", "curve"], "left")
    error = F.when(most_reach().isNull(), F.lit("impressions must be over reach, and reach over 0, for this curve"))
    return out.withColumn("cpi", F.when(F.col("spend") > 0, F.col("spend") / F.col("impressions"))).withColumn("error", error)


def people_of(prefix: DataFrame) -> DataFrame:
    """The people of each publisher of a prefix, once each: f impressions, and the greatest spend of them. A table of people stays as it is."""
    if "f" in prefix.columns:
        return prefix
    return prefix.groupBy("dataset", "publisher", "pub_idx", "vid").agg(F.count("*").alias("f"), F.max("spend").alias("spend"))


def exact(prefix: DataFrame, most: int) -> DataFrame:
    """What each publisher of each campaign shows: dataset, publisher, pub_idx, impressions, spend, reach, histogram."""
    level = F.least(F.col("f"), F.lit(most))
    counts = F.array(*(F.count_if(level == k).cast("double") for k in range(1, most + 1)))
    return people_of(prefix).groupBy("dataset", "publisher", "pub_idx").agg(F.sum("f").alias("impressions"), F.max("spend").alias("spend"), F.count("*").cast("double").alias("reach"), counts.alias("histogram"))


def unions_of(points: DataFrame) -> DataFrame:
    """dataset, without (pub_idx, or -1 for none), reach of all publishers but that one, from leave_one_out_reach's rows."""
    return points.filter("kind <> 'single'").select("dataset", F.coalesce("pub_idx", F.lit(-1)).alias("without"), F.col("reach").cast("double").alias("reach"))


def exact_unions(prefix: DataFrame) -> DataFrame:
    return unions_of(overlap.leave_one_out_reach(prefix))


def settings(rows: DataFrame, epsilon: float | None = None) -> DataFrame:
    """rows with how each is measured: registers of a sketch and their decay, budget, and repetition (replica_id, which draws anew). Columns
    that rows have count, and these defaults where there are none or nulls. A row without any budget is an error."""
    usual = {"sketch_size": (sketch.SIZE, "long"), "decay_rate": (sketch.DECAY, "double"), "epsilon": (epsilon, "double"), "replica_id": (0, "long")}
    chosen = {k: F.coalesce(*([F.col(k).cast(t)] if k in rows.columns else []), F.lit(v).cast(t)) for k, (v, t) in usual.items()}
    chosen["epsilon"] = F.coalesce(chosen["epsilon"], F.raise_error(F.lit("a noisy trial needs an epsilon")).cast("double"))
    return rows.withColumns(chosen)


def has_noise(trials: DataFrame, epsilon: float | None) -> bool:
    return epsilon is not None or "epsilon" in trials.columns


def private(prefix: DataFrame, most: int, epsilon: float | None, seed: str, measure: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """exact() and exact_unions() as sketches with noise show them, and the ledger (dataset, epsilon, delta, mechanism).

    measure: settings() of each campaign (dataset), or else all have this epsilon. With a column `purchase` campaigns that differ in settings
    alone share what they bought: the prefix's data sets are purchases then, counted once for all their campaigns. A campaign's epsilon is parted among 2p + 1 requests. Registers in use without a publisher are those in use less those that only it
    uses, so a union's reach needs no register twice."""
    shown = kept(exact(prefix, most), "shown")
    prefix = people_of(prefix).withColumnRenamed("dataset", "purchase")
    bought = shown.select("dataset", F.col("dataset").alias("purchase")).distinct() if measure is None or "purchase" not in measure.columns else measure.select("dataset", "purchase")
    shown = shown.withColumnRenamed("dataset", "purchase").join(bought, "purchase").drop("purchase")
    sizes = shown.groupBy("dataset").agg(F.count("*").alias("p"))
    sizes = settings(sizes, epsilon) if measure is None else sizes.join(measure.select("dataset", "sketch_size", "decay_rate", "epsilon", "replica_id"), "dataset")
    parts = kept(sizes.withColumn("epsilon", F.col("epsilon") / (2 * F.col("p") + 1)), "parts")
    law, size, decay = ("sketch_size", "decay_rate"), F.col("sketch_size"), F.col("decay_rate")
    laws = parts.select("dataset", *law, "replica_id")
    registers = kept(sketch.build(beside(prefix, laws.join(bought, "dataset"), ["purchase"]), seed, ("dataset", "publisher", "pub_idx", *law), size, decay, ("replica_id",)), "registers")

    def noisy(seen: DataFrame, asked: Column) -> DataFrame:
        up, down = (F.floor(F.log(privacy.uniform("dataset", "asked", "k", seed=f"{seed}-{s}")) / -F.col("epsilon")) for s in ("up", "down"))
        rows = beside(seen.withColumn("asked", asked), parts.select("dataset", "epsilon", "p"), ["dataset"])
        return sketch.monotone(rows.withColumn("reach", F.col("reach") + up - down), ("dataset", "asked"))

    each = noisy(sketch.estimate(registers, most, ("dataset", "pub_idx", *law), size, decay).drop(*law), F.concat(F.lit("single/"), F.col("pub_idx")))
    lists = each.groupBy("dataset", "pub_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "reach"))), lambda x: x["reach"].cast("double")).alias("kplus"))
    single = kept(lists.select("dataset", "pub_idx", F.col("kplus")[0].alias("reach"), F.transform("kplus", lambda x, i: x - F.coalesce(F.get("kplus", i + 1), F.lit(0.0))).alias("histogram")), "single")
    used = beside(unions_of(overlap.leave_one_out_reach(registers.withColumnRenamed("register", "vid"))), laws, ["dataset"]).select("dataset", "without", F.lit(1).cast("long").alias("k"), sketch.cardinality(F.col("reach"), size, decay).alias("reach"))
    unions = noisy(used, F.concat(F.lit("without/"), F.col("without"))).filter("without < 0 or p > 2").select("dataset", "without", "reach")
    ledger = parts.select("dataset", "epsilon", F.lit(0.0).alias("delta"), F.lit("Discrete Laplace").alias("mechanism"), F.explode(F.sequence(F.lit(1), F.when(F.col("p") > 2, 2 * F.col("p") + 1).otherwise(F.col("p") + 1).cast("int"))).alias("request"))
    return shown.drop("reach", "histogram").join(single, ["dataset", "pub_idx"]), kept(unions, "unions"), ledger


#: What fits take beside a trial's names.
POINT = ["key", "trial", "dataset", "publisher", "pub_idx", "curve", "impressions", "reach", "spend", "histogram", "people"]


def of_campaigns(trials: DataFrame, epsilon: float | None) -> DataFrame:
    """settings() of the campaigns of trials; all trials of a campaign have the same."""
    return settings(trials, epsilon).select("dataset", *(c for c in ("purchase",) if c in trials.columns), "sketch_size", "decay_rate", "epsilon", "replica_id").distinct()


def beside_true(points: DataFrame, truth: DataFrame | None) -> DataFrame:
    return points if truth is None else points.join(truth, ["dataset", "publisher"], "left")


def fit_single_publisher(prefix: DataFrame, trials: DataFrame, epsilon: float | None = None, seed: str = "single", truth: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Curves of campaigns of one publisher, by trial (trial, dataset, curve): fit_curves' columns, trial and dataset; and the ledger of them
    (trial, epsilon, delta, mechanism). A campaign with several publishers gives an error."""
    points, ledger = exact(prefix, MOST_SINGLE), None
    if has_noise(trials, epsilon):  # one request has all of it; private() parts it among three
        measure = of_campaigns(trials, epsilon).withColumn("epsilon", 3 * F.col("epsilon"))
        points, _, spent = private(prefix, MOST_SINGLE, None, seed, measure)
        ledger = trials.select("trial", "dataset").join(spent.filter("request = 1"), "dataset").drop("dataset", "request")
    points = kept(points, "single")
    alone = points.groupBy("dataset").agg(F.count("*").alias("p"))
    rows = trials.select("trial", "dataset", "curve").join(alone, "dataset", "left")
    good = rows.filter("p = 1").join(points, "dataset").withColumns({"key": F.col("trial"), "people": 2 * F.col("reach")})
    fits = without_true(fit_curves(beside_true(good.select(*POINT), truth)))
    bad = rows.filter("p is null or p <> 1").select("trial", "dataset", "curve", F.concat(F.lit("one publisher only, not "), F.coalesce("p", F.lit(0))).alias("error"))
    return fits.drop("key").unionByName(bad, allowMissingColumns=True), ledger


def training_points(fits: DataFrame, unions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of a surface, as surfaces' fits take them, from curves of campaigns (trial, dataset, pub_idx, impressions, ..) and their unions:
    all publishers at once, and all but each one where there are more than two."""
    r = fits.withColumn("r", curve_kplus(F.col("impressions").cast("double"), 1, F.col("spend"))[0]).select("trial", "dataset", "pub_idx", "r", most_reach().alias("max_reach"))
    p = fits.groupBy("trial").agg(F.count("*").alias("p"))
    union = fits.select("trial", "dataset").distinct().join(unions, "dataset").join(p, "trial").filter("without < 0 or p > 2").select(F.col("trial").alias("dataset"), F.col("without").alias("point_id"), "reach")
    points = union.select(F.col("dataset").alias("trial"), "point_id").join(r, "trial").select(F.col("trial").alias("dataset"), "point_id", "pub_idx", F.when(F.col("pub_idx") == F.col("point_id"), 0.0).otherwise(F.col("r")).alias("reach"), "max_reach")
    return points, union


def pairwise(points: DataFrame, union: DataFrame) -> Callable[[DataFrame], DataFrame]:
    a = kept(surfaces.pairwise_fit(points, union), "pairwise")
    return lambda at: surfaces.pairwise_predict(at, a)


def restricted(points: DataFrame, union: DataFrame) -> Callable[[DataFrame], DataFrame]:
    a = kept(surfaces.restricted_overlap(surfaces.restricted_fit(points, union)), "restricted")
    return lambda at: surfaces.pairwise_predict(at, a)


def mixture(points: DataFrame, union: DataFrame) -> Callable[[DataFrame], DataFrame]:
    a = kept(surfaces.mixture_fit(points, union), "mixture")
    return lambda at: surfaces.mixture_predict(at, a)


#: Surfaces by name: what fits points and gives a prediction of points (dataset, point_id, pub_idx, reach, max_reach).
SURFACES: dict[str, Callable[[DataFrame, DataFrame], Callable[[DataFrame], DataFrame]] | None] = {"pairwise_union": pairwise, "restricted_pairwise_union": restricted, "generalized_mixture": mixture, "none": None}


def without_true(fits: DataFrame) -> DataFrame:
    return fits.drop("true_spends", "true_steps", "true_reach")


def fit_m3(prefix: DataFrame, trials: DataFrame, epsilon: float | None = None, seed: str = "m3", truth: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Curves of all publishers of campaigns, by trial (trial, dataset, curve, surface): (fits, unions measured, ledger). See predict()."""
    points, unions, ledger = private(prefix, MOST_EACH, None, seed, of_campaigns(trials, epsilon)) if has_noise(trials, epsilon) else (exact(prefix, MOST_EACH), exact_unions(prefix), None)
    if ledger is not None:
        ledger = trials.select("trial", "dataset").join(ledger, "dataset").drop("dataset", "request")
    unions = kept(unions, "unions")
    people = unions.filter("without < 0").select("dataset", (2 * F.col("reach")).alias("people"))  # the audience where none is known: twice those reached
    rows = trials.select("trial", "dataset", "curve", "surface").join(kept(points, "each"), "dataset").join(people, "dataset").withColumn("key", F.concat_ws("/", "trial", "pub_idx"))
    return without_true(fit_curves(beside_true(rows, truth))).drop("key"), unions, ledger


def predict(fits: DataFrame, unions: DataFrame | None, at: DataFrame, most: int = reach.K) -> DataFrame:
    """trial, point_id, y (k+ array) at spend vectors `at` (trial, point_id, pub_idx, spend). Trials of one publisher give k+ reach of the
    curve; others 1+ reach of their surface, fitted here. Trials with an error give nothing."""
    fits = kept(fits, "fits")
    bad = fits.filter("error is not null").select("trial").distinct()
    p = fits.groupBy("trial").agg(F.count("*").alias("p"))
    each = at.join(fits.join(bad, "trial", "left_anti").drop("spend").join(p, "trial"), ["trial", "pub_idx"])
    each = kept(each.withColumn("y", curve_kplus(F.col("spend") / F.col("cpi"), most, F.col("spend"))).withColumn("most", most_reach()), "each-reach")
    out = [each.filter("p = 1").select("trial", "point_id", "y")]
    if unions is not None and "surface" in fits.columns:
        names = [r.surface for r in fits.select("surface").distinct().collect()]  # names of models
        if unknown := sorted(set(names) - set(SURFACES)):
            raise ValueError(f"no surface {unknown[0]}")
        for n in sorted(x for x in names if SURFACES[x]):
            own = F.col("surface") == n
            some = fits.filter(own).join(bad, "trial", "left_anti").join(p.filter("p > 1"), "trial", "left_semi")
            model = SURFACES[n](*map(lambda d: kept(d, "training"), training_points(some, unions)))
            points = each.filter(own & (F.col("p") > 1)).select(F.col("trial").alias("dataset"), "point_id", "pub_idx", F.col("y")[0].alias("reach"), F.col("most").alias("max_reach"))
            out.append(model(points).select(F.col("dataset").alias("trial"), "point_id", F.array("reach").alias("y")))
    return reduce(DataFrame.unionByName, out)


#: Strategies by name: the curves of all trials, and what surfaces are fitted to.
STRATEGIES: dict[str, Callable[..., tuple[DataFrame, DataFrame | None, DataFrame | None]]] = {"single_publisher": lambda *a, **k: (x := fit_single_publisher(*a, **k), (x[0], None, x[1]))[1], "m3": fit_m3}


def evaluated(log: DataFrame, trials: DataFrame, points: DataFrame, done: DataFrame | None = None, epsilon: float | None = None, most: int = reach.K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trial, point_id, x, y) of truth and prediction, (trial, error) of failures, and (trial, epsilon, delta, mechanism) spent, for trials (trial, dataset, strategy, curve, surface,
    share) that have no result in `done` yet. points: dataset, point_id, publisher, pub_idx, spend.

    Trials with an epsilon, the argument or a column, are measured by sketches with noise; columns sketch_size, decay_rate and replica_id, if
    there are any, choose the sketch (see settings), and each combination of them is a campaign of its own; what a data set and a share buy is
    made out once for all of them, as a row for each person."""
    trials = kept(trials if done is None else trials.join(done.select("trial"), "trial", "left_anti"), "trials")
    names = [r.strategy for r in trials.select("strategy").distinct().collect()]  # names of strategies
    if unknown := sorted(set(names) - set(STRATEGIES)):
        raise ValueError(f"no strategy {unknown[0]}")
    own = [c for c in ("sketch_size", "decay_rate", "epsilon", "replica_id") if c in trials.columns] if has_noise(trials, epsilon) else []
    named = kept(settings(trials, epsilon), "settings") if own else trials
    named = named.withColumns({"campaign": F.concat_ws("/", "dataset", "share", *own), "purchase": F.concat_ws("/", "dataset", "share")})
    top = kept(log.groupBy("dataset", "publisher").agg(F.max("spend").alias("top")), "top")
    spent = named.select("dataset", "purchase", "share").distinct().join(top, "dataset").select("dataset", "purchase", "publisher", (F.col("share") * F.col("top")).alias("spend_limit"))
    lists = spent.groupBy("dataset", "publisher").agg(F.collect_list(F.struct("purchase", "spend_limit")).alias("c"))
    bought = F.filter("c", lambda x: F.col("spend") <= x["spend_limit"])
    prefix = reach.beside(log, lists, ["dataset", "publisher"]).withColumn("purchase", F.explode(bought)).select(F.col("purchase.purchase").alias("dataset"), "publisher", "pub_idx", "vid", "spend")
    prefix = kept(people_of(prefix), "campaigns")
    at = named.select("trial", "dataset").join(points, "dataset").select("trial", "point_id", "pub_idx", "spend")
    truth = None
    if named.filter("curve = 'true'").head(1):  # at the points, and at what the campaigns spend
        campaigns = named.select("dataset", "campaign").distinct()
        spends = prefix.groupBy("dataset", "publisher").agg(F.max("spend").alias("spend")).withColumnRenamed("dataset", "purchase").join(named.select("dataset", "purchase").distinct(), "purchase")
        asked = points.select("dataset", "publisher", "spend").unionByName(spends.select("dataset", "publisher", "spend"))
        truth = kept(true_curves(log, asked, max(most, 1)).join(campaigns, "dataset").drop("dataset").withColumnRenamed("campaign", "dataset"), "truth")
    found, wrong, spent_by = [], [], [log.sparkSession.createDataFrame([], "trial string, epsilon double, delta double, mechanism string")]
    for n in sorted(names):
        rows = named.filter(F.col("strategy") == n).withColumn("dataset", F.col("campaign"))
        fits, unions, ledger = STRATEGIES[n](prefix, rows, epsilon=epsilon, truth=truth)
        fits = kept(fits, "fits")
        if ledger is not None:
            spent_by.append(ledger)
        found.append(predict(fits, unions, at, most))
        wrong.append(fits.filter("error is not null").groupBy("trial").agg(F.min("error").alias("error")))
    tried = kept(trials.select("dataset").distinct(), "tried")
    truth = reach.reach_at_points(beside(log, tried, ["dataset"]), points.join(tried, "dataset", "left_semi"), most).groupBy("dataset", "point_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "reach"))), lambda x: x["reach"].cast("double")).alias("x"))
    model = reduce(DataFrame.unionByName, found).join(named.select("trial", "dataset"), "trial")
    return truth.join(model, ["dataset", "point_id"]).select("trial", "point_id", "x", "y"), reduce(DataFrame.unionByName, wrong), reduce(DataFrame.unionByName, spent_by)
