"""Reach curves of one publisher: parameters are rows, predictions are column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachspark.functions.histograms import suffix_sums
from reachspark.functions.search import greatest_input


def goerg_fit(points: DataFrame) -> DataFrame:
    """points (.., impressions, reach, spend) with rho and cpi; impressions must be over reach and over 0."""
    i, r = F.col("impressions").cast("double"), F.col("reach").cast("double")
    bad = F.when(i < 0.1, F.raise_error(F.lit("no impressions"))).when(i <= r, F.raise_error(F.lit("impressions must be over reach")))
    return points.withColumn("rho", bad.otherwise(i * r / (i - r))).withColumn("cpi", F.when(F.col("spend") > 0, F.col("spend") / i))


def goerg_kplus(impressions: Column, rho: Column, most: int) -> Column:
    """k+ reach for k = 1..most: rho (I / (I + rho))^k."""
    return F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: rho * F.pow(impressions / (impressions + rho), k.cast("double")))


def impressions_for_spend(spend: Column, cpi: Column) -> Column:
    return F.when(cpi.isNull(), F.raise_error(F.lit("cost of an impression unknown"))).otherwise(spend / cpi)


def goerg_inverse(q: Column, rho: Column) -> Column:
    """The greatest whole number of impressions whose reach is at most q of the greatest reach, 0 < q < 1."""
    guess = F.floor(q * rho / (1 - q))
    fits = lambda x: rho * (x / (x + rho)) <= q * rho
    near = F.when(fits(guess + 1), guess + 1).when(fits(guess), guess).otherwise(F.greatest(guess - 1, F.lit(0)))
    return F.when((q <= 0) | (q >= 1), F.raise_error(F.lit("q must lie between 0 and 1"))).otherwise(near).cast("long")


def negative_binomial(k: Column, r: Column, p: Column) -> Column:
    """P(k) with r successes of probability p, as a product that grows factor by factor; 0 below 0."""
    start = F.pow(p, r)
    return F.when(k < 0, 0.0).otherwise(F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>")), start, lambda a, j: a * (r + j - 1) / j * (1 - p)))


def gamma_poisson_pmf(n: Column, alpha: Column, beta: Column) -> Column:
    """P(a person has n impressions), n from 1 on: a negative binomial moved up by one."""
    return negative_binomial(n - 1, alpha, 1 / (1 + beta))


def gamma_poisson_kreach(k: Column, share: Column, alpha: Column, beta: Column) -> Column:
    """P(a person sees k impressions) when each is shown with probability share. In closed form: the impressions beyond the
    first, thinned, are negative binomial again, and the first is shown or not."""
    p = 1 / (1 + beta * share)
    return (1 - share) * negative_binomial(k, alpha, p) + share * negative_binomial(k - 1, alpha, p)


def gamma_poisson_histogram(impressions: Column, alpha: Column, beta: Column, n: Column, most: int) -> Column:
    """Expected people with 1..most-1 impressions, then with most or more. Impressions stay below all there are."""
    top = n * (1 + alpha * beta)
    share = F.least(impressions.cast("double"), top - 1) / top
    exact = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: n * gamma_poisson_kreach(k, share, alpha, beta))
    rest = n - F.aggregate(exact, F.lit(0.0), lambda a, x: a + x)
    return F.concat(F.slice(exact, 2, most - 1), F.array(rest))


def gamma_poisson_kplus(impressions: Column, alpha: Column, beta: Column, n: Column, most: int) -> Column:
    return suffix_sums(gamma_poisson_histogram(impressions, alpha, beta, n, most))


def binomial(k: Column, n: Column, share: Column) -> Column:
    """P(k of n impressions are shown), 0 for k > n."""
    ways = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, j: a * (n - k + j) / j)
    return F.when(k > n, 0.0).otherwise(ways * F.pow(share, k.cast("double")) * F.pow(1 - share, (n - k).cast("double")))


def kinflated_kreach(k: Column, share: Column, alpha: Column, beta: Column, prefix: Column) -> Column:
    """P(a person sees k impressions) where the probabilities of having 1, 2, .. impressions are those of `prefix` first and
    then the gamma-Poisson ones, scaled to sum to 1. A prefix that sums to more than 1 is scaled down to 1; the share stays at 1 at most.

    The scaled gamma-Poisson answer holds but for the inventories in the prefix, so those few terms are put right."""
    q = F.least(share, F.lit(1.0))
    size = F.size(prefix)
    total = F.aggregate(prefix, F.lit(0.0), lambda a, x: a + x)
    own = F.transform(prefix, lambda x: x / F.greatest(total, F.lit(1.0)))
    numbers = F.when(size > 0, F.sequence(F.lit(1), F.greatest(size, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    usual = F.transform(numbers, lambda n: gamma_poisson_pmf(n, alpha, beta))
    covered = F.aggregate(usual, F.lit(0.0), lambda a, x: a + x)
    scale = F.when(covered >= 1, 0.0).otherwise((1 - F.least(total, F.lit(1.0))) / (1 - covered))
    right = F.aggregate(F.zip_with(own, numbers, lambda x, n: (x - scale * gamma_poisson_pmf(n, alpha, beta)) * binomial(k, n, q)), F.lit(0.0), lambda a, x: a + x)
    return right + scale * gamma_poisson_kreach(k, q, alpha, beta)


def chi2(actual: Column, expected: Column, top: Column, extrapolation: Column) -> Column:
    """Sum of (expected - actual)^2 / expected, plus the squared error of 1+ reach, plus the square of what `top` lacks."""
    parts = F.zip_with(expected, actual, lambda e, a: (e - a) * (e - a) / (e + F.lit(1e-6)))
    gap = F.aggregate(F.zip_with(expected, actual, lambda e, a: e - a), F.lit(0.0), lambda s, x: s + x)
    lack = F.when(top < extrapolation, (extrapolation - top) * (extrapolation - top)).otherwise(0.0)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) + gap * gap + lack


def exp_poisson_reach(impressions: Column, n: Column, beta: Column) -> Column:
    """1+ reach of the model with alpha = 1 when some of its impressions are shown; of all of them, everyone."""
    return F.when(impressions >= (beta + 1) * n, n).otherwise(n * impressions * (beta + 1) / (n + beta * (n + impressions)))


def exp_poisson_beta(impressions: Column, n: Column, reach: Column) -> Column:
    """The beta at which so many impressions reach so many of n; 1000 if none does."""
    left = impressions * reach - n * (impressions - reach)
    return F.when(left <= 0, F.lit(1e3)).otherwise(n * (impressions - reach) / left)


def exp_poisson_audience(impressions: Column, reach: Column, stretch: float = 1.5) -> Column:
    """The audience from one reach alone, if its mean is `stretch` times what is seen; a hundred times the reach if nobody was seen twice."""
    if stretch < 1:
        raise ValueError("the mean can't be below what is seen")
    return F.when(impressions < reach + 1e-3, 100.0 * reach).otherwise(reach * (stretch * impressions - reach) / (stretch * (impressions - reach)))


def with_exp_poisson_start(points: DataFrame, stretch: float = 1.2, tries: int = 400, least: float | None = None, single: Column | None = None) -> DataFrame:
    """points (.., impressions, reach) with the audience n and beta of the model with alpha = 1 that has this reach.

    The mean is taken to be `stretch` times what is seen beyond one; where `single` holds, only 1+ reach is known and the audience comes
    from it alone. The model has `least` impressions or more, if given. If it had fewer than were shown, n grows by a tenth until it
    doesn't (tries bounds the search: a factor of 10^16)."""
    i, r = F.col("impressions").cast("double"), F.col("reach").cast("double")
    i = i if least is None else F.greatest(i, F.lit(float(least)))
    beta = (i / F.least(r, i - 1) - 1) * stretch
    n = F.when(i < r + 1e-3, 100.0 * r).otherwise(i * beta * r / ((beta + 1) * (i - r)))
    if single is not None:
        alone = exp_poisson_audience(i, r)
        n, beta = F.when(single, alone).otherwise(n), F.when(single, exp_poisson_beta(i, alone, r)).otherwise(beta)
    df = points.withColumns({"n": n, "beta": beta})
    solved = lambda m: exp_poisson_beta(i, m, r)
    grown = lambda j: F.greatest(F.lit(1.0), F.col("n") * F.pow(F.lit(1.1), j))
    first = F.get(F.filter(F.sequence(F.lit(1), F.lit(tries)), lambda j: grown(j) * (solved(grown(j)) + 1) >= i), 0)
    ok = F.col("n") * (F.col("beta") + 1) >= i
    return df.withColumn("j", F.when(~ok, first)).withColumns({"n": F.when(F.col("j").isNull(), F.col("n")).otherwise(grown(F.col("j"))), "beta": F.when(F.col("j").isNull(), F.col("beta")).otherwise(solved(grown(F.col("j"))))}).drop("j")


def truncated_poisson(mean: Column, most: int) -> Column:
    """P(0), .., P(most - 1), P(most or more)."""
    pmf = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.when((mean == 0) & (k == 0), 1.0).when(mean == 0, 0.0).otherwise(F.exp(k * F.log(mean) - mean - F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda a, j: a + F.when(j > 0, F.log(j.cast("double"))).otherwise(0.0)))))
    return F.concat(pmf, F.array(F.greatest(1 - F.aggregate(pmf, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))


def cross_entropy(observed: Column, fitted: Column) -> Column:
    return F.aggregate(F.zip_with(observed, fitted, lambda o, f: F.when(o > 0, -o * F.log(f + F.lit(1e-200))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def relative_entropy(observed: Column, fitted: Column) -> Column:
    return F.aggregate(F.zip_with(observed, fitted, lambda o, f: F.when(o > 0, o * F.log(o / f)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def poisson_grid(pmf: Column, components: int, dilution: float = 0.0) -> Column:
    """Means of Poisson components: as many in [f, f+1) as the pmf at f gives, evenly; what is left over beyond the last."""
    weight = F.transform(pmf, lambda p: p * (1 - dilution) + F.lit(dilution) / F.size(pmf))
    counts = F.transform(weight, lambda w: F.bround(w * components).cast("int"))
    start = lambda i: F.aggregate(F.slice(counts, 1, i), F.lit(0), lambda a, x: a + x)
    steps = lambda f, n: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda j: f + j / n)
    used = F.transform(counts, lambda n, i: F.when(start(i) < components, n).otherwise(0))
    left = F.greatest(F.lit(components) - F.aggregate(used, F.lit(0), lambda a, x: a + x), F.lit(0))
    return F.concat(F.flatten(F.transform(used, lambda n, i: steps(i, n))), steps(F.size(pmf), left))


# Fits: one small problem for each row, many rows at a time


def poisson_table(means: np.ndarray, most: int) -> np.ndarray:
    k = np.arange(most)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, max(most, 2))))])[:most]
    with np.errstate(divide="ignore", invalid="ignore"):
        pmf = np.where(means[:, None] > 0, np.exp(k * np.log(np.maximum(means[:, None], 1e-300)) - means[:, None] - logs), (k == 0).astype(float))
    return np.column_stack([pmf, np.maximum(1 - pmf.sum(axis=1), 0.0)])


def mixture_weights(histogram: np.ndarray, means: np.ndarray, rounds: int = 20000, tolerance: float = 1e-13) -> np.ndarray:
    """Weights of Poisson components with the least cross entropy to a histogram, by multiplicative updates."""
    h = np.asarray(histogram, dtype=float)
    if len(h) < 2 or (h < 0).any() or h.sum() <= 0:
        raise ValueError("a histogram needs two values or more, none negative, not all 0")
    h, table = h / h.sum(), poisson_table(np.asarray(means, dtype=float), len(h) - 1)
    w, last = np.full(len(means), 1 / len(means)), np.inf
    for _ in range(rounds):
        fit = w @ table + 1e-200
        now = -(h * np.log(fit)).sum()
        if last - now < tolerance:
            break
        last, w = now, w * (table @ (h / fit))
    return w / w.sum()


def dirac_fit(histograms: DataFrame) -> DataFrame:
    """key, components and weights of (key, histogram, components). Where no finite weights come out, every second component goes, down to
    one; a row that can't be fitted has an error instead."""

    def fit(batches):
        for b in batches:
            out = []
            for key, h, c in zip(b["key"], b["histogram"], b["components"], strict=True):
                try:
                    c, w = np.asarray(c, dtype=float), mixture_weights(h, c)
                    while not np.isfinite(w).all() and len(c) > 1:
                        c = c[::2]
                        w = mixture_weights(h, c)
                    out.append((key, c.tolist(), w.tolist(), None))
                except ValueError as e:
                    out.append((key, None, None, str(e)))
            yield pd.DataFrame(out, columns=["key", "components", "weights", "error"])

    return histograms.mapInPandas(fit, "key string, components array<double>, weights array<double>, error string")


def dirac_predict(fits: DataFrame, scale: Column, most: int) -> DataFrame:
    """(key, pmf) of (key, components, weights) when impressions are `scale` times those seen."""
    parts = fits.withColumn("scale", scale).select("key", "scale", F.explode(F.arrays_zip("components", "weights")).alias("c"))
    parts = parts.select("key", F.col("c.weights").alias("w"), (F.col("c.components") * F.col("scale")).alias("mean"))
    pmf = parts.withColumn("pmf", truncated_poisson(F.col("mean"), most)).select("key", "w", F.posexplode("pmf").alias("f", "p"))
    sums = pmf.groupBy("key", "f").agg(F.sum(F.col("w") * F.col("p")).alias("p"))
    return sums.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "p"))), lambda x: x["p"]).alias("pmf"))


def dirac_kplus(impressions: Column, at: Column, components: Column, weights: Column, universe: Column, most: int) -> Column:
    """k+ reach of a Poisson mixture fitted where `at` impressions were shown, as whole numbers of people."""
    sums = F.aggregate(F.arrays_zip(components.alias("c"), weights.alias("w")), F.array_repeat(F.lit(0.0), most + 1), lambda a, x: F.zip_with(a, truncated_poisson(x["c"] * impressions / at, most), lambda s, p: s + x["w"] * p))
    return F.transform(F.slice(suffix_sums(sums), 2, most), lambda p: F.bround(universe * p))


def dirac_most(components: Column, weights: Column, universe: Column) -> Column:
    """The people that enough impressions reach: all but those of components at 0."""
    return universe * F.aggregate(F.zip_with(components, weights, lambda c, w: F.when(c > 0, w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def curve_inverse(q: Column, most: Column, rising: Callable[[Column], Column]) -> Column:
    """The greatest whole number of what `rising` takes (impressions, or spend) whose reach is at most q of the greatest, 0 < q < 1."""
    return F.when((q <= 0) | (q >= 1), F.raise_error(F.lit("q must lie between 0 and 1"))).otherwise(greatest_input(q * most, rising))


def expected_histogram(impressions: float, alpha: np.ndarray, beta: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """gamma_poisson_histogram for arrays of parameters: a row of `most` values for each."""
    top = n * (1 + alpha * beta)
    share = np.minimum(impressions, top - 1) / top
    p = 1 / (1 + beta * share)
    nb, out, last = np.power(p, alpha), [], np.zeros_like(p)
    for k in range(most):
        out.append(n * ((1 - share) * nb + share * last))
        last, nb = nb, nb * (alpha + k) / (k + 1) * (1 - p)
    exact = np.stack(out, axis=-1)
    return np.concatenate([exact[..., 1:], (n - exact.sum(axis=-1))[..., None]], axis=-1)


def chi2_of(h: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """chi2 of one histogram and rows of expected ones."""
    gap = (expected - h).sum(axis=-1)
    return ((expected - h) ** 2 / (np.abs(expected) + 1e-6)).sum(axis=-1) + gap * gap


def gamma_poisson_grid(h: np.ndarray, impressions: float, cells: int, rounds: int, most_alpha: float, audience: float | None = None, least: float = 0.0) -> tuple[float, float, float, float]:
    """alpha, beta, n, objective: audience and alpha on a grid that shrinks; in each cell beta meets 1+ reach, found by halving.

    With a given audience only alpha is searched, as finely as the grid has cells. The model has `least` impressions or more."""
    reach = h.sum()
    if audience is not None and not audience > reach:
        return (np.nan, np.nan, float(audience), np.inf)
    a0, a1, n0, n1 = np.log(1e-3), np.log(most_alpha), np.log(reach * 1.0001), np.log(reach * 100)
    best = (np.nan, np.nan, np.nan, np.inf)
    for _ in range(rounds):
        if audience is None:
            alpha, n = (x.ravel() for x in np.meshgrid(np.exp(np.linspace(a0, a1, cells)), np.exp(np.linspace(n0, n1, cells))))
        else:
            alpha, n = np.exp(np.linspace(a0, a1, cells * cells)), np.full(cells * cells, float(audience))
        low = np.log(np.maximum(max(impressions + 1, least) / n - 1, 0.0) / alpha + 1e-9)
        high = np.full_like(low, np.log(1e6))
        for _ in range(40):
            middle = (low + high) / 2
            top = n * (1 + alpha * np.exp(middle))
            unreached = (1 - impressions / top) * np.power(1 + np.exp(middle) * impressions / top, -alpha)
            over = n * (1 - unreached) > reach
            low, high = np.where(over, middle, low), np.where(over, high, middle)
        beta = np.exp(high)
        score = chi2_of(h, expected_histogram(impressions, alpha, beta, n, len(h)))
        i = int(np.nanargmin(score))
        if score[i] <= best[3]:
            best = (float(alpha[i]), float(beta[i]), float(n[i]), float(score[i]))
        wide_a, wide_n = 2 * (a1 - a0) / ((cells if audience is None else cells * cells) - 1), 2 * (n1 - n0) / (cells - 1)
        a0, a1 = np.log(best[0]) - wide_a, np.log(best[0]) + wide_a
        n0, n1 = max(np.log(best[2]) - wide_n, np.log(reach * 1.0001)), np.log(best[2]) + wide_n
    return best


def gamma_poisson_fit(points: DataFrame, cells: int = 16, rounds: int = 4, most_alpha: float = 100.0) -> DataFrame:
    """key, alpha, beta, n, objective for points (key, impressions, histogram): one small grid search for each row.

    Points may have an `audience` (null where it isn't known), which n then is, and `least`, the fewest impressions that the model has.
    An audience that isn't over the reach has no fit: nulls, and an endless objective."""
    given = {"audience": F.col("audience") if "audience" in points.columns else F.lit(None), "least": F.col("least") if "least" in points.columns else F.lit(0.0)}

    def fit(batches):
        for b in batches:
            rows = zip(b["key"], b["impressions"], b["histogram"], b["audience"], b["least"], strict=True)
            out = [(key, *gamma_poisson_grid(np.asarray(h, dtype=float), float(i), cells, rounds, most_alpha, None if pd.isna(n) else float(n), float(least))) for key, i, h, n, least in rows]
            yield pd.DataFrame(out, columns=["key", "alpha", "beta", "n", "objective"])

    return points.select("key", "impressions", "histogram", *(v.cast("double").alias(k) for k, v in given.items())).mapInPandas(fit, "key string, alpha double, beta double, n double, objective double")


def least_point(f, start: np.ndarray, size: float = 0.3, steps: int = 400) -> tuple[np.ndarray, float]:
    """A point where f is least nearby, by a simplex that is reflected, stretched, drawn in and shrunk."""
    points = [np.asarray(start, dtype=float)] + [start + size * e for e in np.eye(len(start))]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= 1e-10 * (1 + abs(values[0])):
            break
        middle = np.mean(points[:-1], axis=0)
        away = middle - points[-1]
        tries = {t: f(middle + t * away) for t in (1.0,)}
        if tries[1.0] < values[0]:
            tries[2.0] = f(middle + 2 * away)
        elif tries[1.0] >= values[-2]:
            tries[0.5 if tries[1.0] < values[-1] else -0.5] = f(middle + (0.5 if tries[1.0] < values[-1] else -0.5) * away)
        t = min(tries, key=tries.get)
        if tries[t] < values[-1] and (t != 1.0 or tries[t] < values[-2] or len(tries) == 1):
            points[-1], values[-1] = middle + t * away, tries[t]
        else:
            points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
            values = [values[0]] + [f(p) for p in points[1:]]
    i = int(np.argmin(values))
    return points[i], float(values[i])


def chi2_share(x: float, freedom: int) -> float:
    """The share of a chi-squared law below x, by the series of the incomplete gamma function."""
    a, y = freedom / 2, x / 2
    if y > a + 400:
        return 1.0
    term = total = 1 / a
    for k in range(1, 2000):
        term *= y / (a + k)
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, total * math.exp(a * math.log(max(y, 1e-300)) - y - math.lgamma(a)))


def inflated_histogram(impressions: float, alpha: float, beta: float, n: float, prefix: np.ndarray, most: int) -> np.ndarray:
    """Expected people by frequency of an inflated model, as kinflated_kreach has them; the last value is for `most` or more."""
    numbers = np.arange(1, len(prefix) + 1)
    usual = np.power(1 / (1 + beta), alpha) * np.concatenate([[1.0], np.cumprod((alpha + numbers[:-1] - 1) / numbers[:-1] * (beta / (1 + beta)))]) if len(prefix) else np.zeros(0)
    scale = (1 - prefix.sum()) / max(1 - usual.sum(), 1e-300)
    mean = (prefix * numbers).sum() + scale * (1 + alpha * beta - (usual * numbers).sum())
    share = min(1.0, impressions / max(n * mean, 1e-300))
    p = 1 / (1 + beta * share)
    nb, last, out = p**alpha, 0.0, []
    for k in range(most):
        ways = np.array([math.comb(int(i), k) * share**k * (1 - share) ** (int(i) - k) if k <= i else 0.0 for i in numbers])
        out.append(n * (((prefix - scale * usual) * ways).sum() + scale * ((1 - share) * nb + share * last)))
        last, nb = nb, nb * (alpha + k) / (k + 1) * (1 - p)
    return np.array([*out[1:], n - sum(out)])


def inflated_parameters(h: np.ndarray, impressions: float, most_inflated: int) -> tuple[float, float, float, list[float], float]:
    """alpha, beta, n, prefix, objective: probabilities of 1, 2, .. impressions are set free one by one until the histogram is likely enough."""
    reach, prefix = h.sum(), np.zeros(0)

    def fitted(start: np.ndarray, free: int) -> tuple[np.ndarray, float]:
        def f(v: np.ndarray) -> float:
            alpha, beta, n = np.exp(v[:3])
            own = v[3:]
            if not (1e-4 <= alpha <= 1000 and 1e-4 <= beta <= 1e4 and reach <= n <= 100 * reach) or (own < 0).any() or own.sum() > 1:
                return float((h * h).sum() + impressions**2)
            lack = max(0.0, impressions - n * (1 + alpha * beta)) if not free else 0.0
            return float(chi2_of(h, inflated_histogram(impressions, alpha, beta, n, own, len(h)))) + lack * lack

        return least_point(f, start, 0.1)

    alpha, beta, n, _ = gamma_poisson_grid(h, impressions, 16, 3, 100.0)
    v, score = fitted(np.log([alpha, beta, n]), 0)
    while len(h) > 1 and chi2_share(score, len(h)) > 0.95 and len(prefix) < most_inflated:
        alpha, beta = np.exp(v[:2])
        k = len(prefix) + 1
        pmf = (1 + beta) ** -alpha * np.prod([(alpha + j - 1) / j * (beta / (1 + beta)) for j in range(1, k)])
        left = max(0.0, 1 - v[3:].sum())
        v, score = fitted(np.concatenate([v, [min(pmf, left)]]), k)
        prefix = v[3:]
    alpha, beta, n = np.exp(v[:3])
    return float(alpha), float(beta), float(n), prefix.tolist(), score


def kinflated_fit(points: DataFrame, most_inflated: int = 4) -> DataFrame:
    """key, alpha, beta, n, prefix, objective for points (key, impressions, histogram): one small search for each row."""

    def fit(batches):
        for b in batches:
            out = [(key, *inflated_parameters(np.asarray(h, dtype=float), float(i), most_inflated)) for key, i, h in zip(b["key"], b["impressions"], b["histogram"], strict=True)]
            yield pd.DataFrame(out, columns=["key", "alpha", "beta", "n", "prefix", "objective"])

    return points.select("key", "impressions", "histogram").mapInPandas(fit, "key string, alpha double, beta double, n double, prefix array<double>, objective double")


def kinflated_kplus(impressions: Column, alpha: Column, beta: Column, n: Column, prefix: Column, most: int) -> Column:
    """k+ reach of an inflated model for k = 1..most."""
    sum_ = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    numbers = F.when(F.size(prefix) > 0, F.sequence(F.lit(1), F.greatest(F.size(prefix), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    usual = F.transform(numbers, lambda i: gamma_poisson_pmf(i, alpha, beta))
    scale = (1 - sum_(prefix)) / F.greatest(1 - sum_(usual), F.lit(1e-300))
    mean = sum_(F.zip_with(prefix, numbers, lambda x, i: x * i)) + scale * (1 + alpha * beta - sum_(F.zip_with(usual, numbers, lambda x, i: x * i)))
    share = F.least(impressions / (n * mean), F.lit(1.0))
    seen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: kinflated_kreach(k, share, alpha, beta, prefix))
    return F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: n * (1 - sum_(F.slice(seen, 1, k))))
