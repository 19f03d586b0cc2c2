"""Reach surfaces: the reach of several publishers together from the reach of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachspark.sources.scratch import kept


def reach_vector(points: DataFrame, curves: DataFrame) -> DataFrame:
    """points (dataset, point_id, publisher, impressions) with the reach that Goerg curves (dataset, publisher, rho) predict."""
    i = F.col("impressions").cast("double")
    return points.join(curves.select("dataset", "publisher", "rho"), ["dataset", "publisher"]).select(*points.columns, (F.col("rho") * (i / (i + F.col("rho")))).alias("reach"))


def pairs(points: DataFrame) -> DataFrame:
    """dataset, point_id, i, j, d for ordered pairs of publishers i <> j of each point (.., pub_idx, reach, max_reach)."""
    a = points.select("dataset", "point_id", F.col("pub_idx").alias("i"), F.col("reach").alias("ri"), F.col("max_reach").alias("mi"))
    b = points.select("dataset", "point_id", F.col("pub_idx").alias("j"), F.col("reach").alias("rj"), F.col("max_reach").alias("mj"))
    return a.join(b, ["dataset", "point_id"]).filter("i <> j").select("dataset", "point_id", "i", "j", (F.col("ri") * F.col("rj") / (2 * F.greatest("mi", "mj"))).alias("d"))


def pairwise_predict(points: DataFrame, overlap: DataFrame) -> DataFrame:
    """dataset, point_id, reach: the sum of reaches less a_ij d_ij over ordered pairs, a in overlap (dataset, i, j, a)."""
    lost = pairs(points).join(overlap, ["dataset", "i", "j"]).groupBy("dataset", "point_id").agg(F.sum(F.col("a") * F.col("d")).alias("lost"))
    all_ = points.groupBy("dataset", "point_id").agg(F.sum("reach").alias("total"))
    return all_.join(lost, ["dataset", "point_id"], "left").select("dataset", "point_id", (F.col("total") - F.coalesce("lost", F.lit(0.0))).alias("reach"))


def restricted_overlap(lambdas: DataFrame) -> DataFrame:
    """a_ij = l_i l_j off the diagonal, from (dataset, pub_idx, l)."""
    a = lambdas.select("dataset", F.col("pub_idx").alias("i"), F.col("l").alias("li"))
    b = lambdas.select("dataset", F.col("pub_idx").alias("j"), F.col("l").alias("lj"))
    return a.join(b, "dataset").filter("i <> j").select("dataset", "i", "j", (F.col("li") * F.col("lj")).alias("a"))


def mixture_predict(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """N sum_j [1 - prod_i (1 - a_ij r_i / N)] with N twice the greatest reach of a publisher; clusters (dataset, j, pub_idx, a)."""
    size = points.groupBy("dataset").agg((2 * F.max("max_reach")).alias("n"))
    each = points.join(size, "dataset").join(clusters, ["dataset", "pub_idx"])
    miss = F.greatest(1 - F.col("a") * F.col("reach") / F.col("n"), F.lit(1e-300))
    by = each.groupBy("dataset", "point_id", "j", "n").agg((1 - F.exp(F.sum(F.log(miss)))).alias("hit"))
    return by.groupBy("dataset", "point_id").agg((F.first("n") * F.sum("hit")).alias("reach"))


def bags(points: DataFrame, union: DataFrame) -> DataFrame:
    """A row for each data set with all its training points: pubs, r (points x publishers, in one list), m (greatest reaches), y (reach lost to overlap).

    A data set has p + 1 points or a few thousand; a publisher that a point doesn't name reaches nobody there."""
    rows = points.join(union.select("dataset", "point_id", F.col("reach").alias("u")), ["dataset", "point_id"]).select("dataset", "point_id", "pub_idx", "reach", "max_reach", "u")

    def pack(s: pd.DataFrame) -> pd.DataFrame:
        r = s.pivot(index="point_id", columns="pub_idx", values="reach").fillna(0.0)
        m = s.groupby("pub_idx")["max_reach"].max().loc[r.columns]
        y = r.sum(axis=1) - s.groupby("point_id")["u"].first().loc[r.index]
        return pd.DataFrame([(s["dataset"].iloc[0], r.columns.tolist(), r.to_numpy(float).ravel().tolist(), m.astype(float).tolist(), y.tolist())], columns=["dataset", "pubs", "r", "m", "y"])

    return rows.groupBy("dataset").applyInPandas(pack, "dataset string, pubs array<int>, r array<double>, m array<double>, y array<double>")


class Bag:
    """The points of a data set: lost reach is to be sum of a_ij d_ij over ordered pairs, d_ij = r_i r_j w_ij."""

    def __init__(self, r: np.ndarray, m: np.ndarray, y: np.ndarray):
        self.r, self.y = np.asarray(r, dtype=float).reshape(len(y), len(m)), np.asarray(y, dtype=float)
        self.w = 1 / (2 * np.maximum(np.maximum.outer(m, m), 1e-300))
        np.fill_diagonal(self.w, 0)

    def lost(self, a: np.ndarray) -> np.ndarray:
        """p^2 work for a point: no pair of pairs is ever made out."""
        return ((self.r @ (a * self.w)) * self.r).sum(axis=1)

    def back(self, e: np.ndarray) -> np.ndarray:
        """Sum of e d over the points."""
        return self.w * (self.r.T @ (e[:, None] * self.r))

    def loss(self, a: np.ndarray) -> float:
        return float(((self.lost(a) - self.y) ** 2).sum())


def within_rows(a: np.ndarray) -> np.ndarray:
    """Rows moved to the nearest points that are not negative and sum to 1 at most."""
    out = np.maximum(a, 0)
    over = out.sum(axis=1) > 1
    if over.any():
        out[over] = onto_simplex(a[over])
    return out


def project(a: np.ndarray, rounds: int = 2000, near: float = 1e-12, taken: np.ndarray | None = None) -> np.ndarray:
    """The nearest matrix that is symmetric, not negative, 0 on the diagonal, and has row sums of 1 at most.

    By turns the nearest symmetric matrix and the nearest rows, each time with what the rows' step took off put back first
    (Dykstra); without that the end would be a point of both sets, but not the nearest. `taken`, what was taken off a matrix near this
    one, is where the turns start and is kept up to date: any start leads to the nearest point, a good one sooner."""

    def even(x: np.ndarray) -> np.ndarray:
        x = (x + x.T) / 2
        np.fill_diagonal(x, 0)
        return x

    a = even(a)
    plain = np.maximum(a, 0)
    if (plain.sum(axis=1) <= 1).all():
        return plain
    taken = np.zeros_like(a) if taken is None else taken
    a = even(a - taken)
    for _ in range(rounds):
        rows = within_rows(a + taken)
        taken += a - rows
        a, last = even(rows), a
        if np.abs(a - last).max() < near and np.abs(a - rows).max() < near:
            break
    return a / max(1.0, a.sum(axis=1).max())  # what is left over 1 is below `near`, about


def pairwise_parameters(bag: Bag, steps: int = 1500, near: float = 1e-9, gain: float = 1e-7) -> np.ndarray:
    """The overlap with the least squared error: projected gradient steps, hurried on while they go down, until nothing moves by `near`
    or a hundred steps take off less than a share `gain` of the error."""
    p = bag.r.shape[1]
    v, top = np.random.default_rng(0).random((p, p)) * (bag.w > 0), 0.0
    for _ in range(60):  # the steepest direction's curvature
        v = v / max(float(np.linalg.norm(v)), 1e-300)
        v = bag.back(bag.lost(v))
        last, top = top, float(np.linalg.norm(v))
        if abs(top - last) <= 1e-3 * top:
            break
    if not top:
        return np.zeros((p, p))
    top *= 1.05
    a = ahead = np.zeros((p, p))
    speed, taken, error = 1.0, np.zeros((p, p)), np.inf
    for step in range(steps):
        if step % 100 == 0:
            last, error = error, bag.loss(a)
            if (step and last - error <= gain * last) or error <= 1e-16 * float(bag.y @ bag.y):
                break
        new = project(ahead - bag.back(bag.lost(ahead) - bag.y) / top, rounds=200, near=1e-11, taken=taken)
        if ((ahead - new) * (new - a)).sum() > 0:
            speed = 1.0
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        ahead = new + (speed - 1) / faster * (new - a)
        moved, a, speed = np.abs(new - a).max(), new, faster
        if moved < near:
            break
    return a


def pairwise_fit(points: DataFrame, union: DataFrame) -> DataFrame:
    """dataset, i, j, a: the constrained least squares fit of lost reach, one small problem for each data set."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, pubs, r, m, y in zip(*(b[c] for c in ("dataset", "pubs", "r", "m", "y")), strict=True):
                a = pairwise_parameters(Bag(r, np.asarray(m), np.asarray(y)))
                i, j = np.nonzero(~np.eye(len(pubs), dtype=bool))
                yield pd.DataFrame({"dataset": name, "i": np.asarray(pubs)[i], "j": np.asarray(pubs)[j], "a": a[i, j]})

    return bags(points, union).mapInPandas(solve, "dataset string, i int, j int, a double")


def feasible(l: np.ndarray) -> bool:  # noqa: E741
    return bool((l >= 0).all() and (l * (l.sum() - l)).max() <= 1 + 1e-12)


def greatest(l: np.ndarray, i: int) -> float:  # noqa: E741
    """How large l_i may be: its own row and those of the others sum to 1 at most."""
    others = l.sum() - l[i]
    own = 1 / others if others > 0 else 1.0
    rest = np.delete(l, i)
    rest = rest[rest > 0]
    return max(0.0, min(own, float((1 / rest - (others - rest)).min()) if len(rest) else own))


#: Losses that differ by less than this share of the squares of what is lost are alike.
ALIKE = 3e-4


def restricted_start(p: int, seed: int) -> np.ndarray:
    """A feasible point: a direction drawn evenly from the simplex, at a part of the length that is feasible."""
    rng = np.random.default_rng(seed)
    way = rng.dirichlet(np.ones(p))
    return way * rng.random() / max(float((way * (1 - way)).max()) ** 0.5, 1e-9)


def restricted_parameters(bag: Bag, start: np.ndarray, rounds: int = 1000, least_gain: float = 1e-3) -> tuple[np.ndarray, float]:
    """l with a_ij = l_i l_j from one start, and its loss: in each round l's length is set to the best, which frees what bounds hold
    fast, and then one coordinate after another goes to where a parabola is least, within its bounds. Errors are kept up to date, so a coordinate costs its column of pairs only."""
    l, r, w = start.copy(), bag.r, bag.w  # noqa: E741
    e = bag.lost(np.outer(l, l)) - bag.y
    now, exact = float(e @ e), 1e-9 * float(bag.y @ bag.y)
    for _ in range(rounds):
        whole = e + bag.y  # first all of l at once: how long it is best
        if (size := float(whole @ whole)) > 0:
            t = min(max(float(whole @ bag.y) / size, 0.0), 1 / max(float((l * (l.sum() - l)).max()), 1e-300))
            l, e = l * t**0.5, t * whole - bag.y  # noqa: E741
        for i in range(len(l)):
            slope = 2 * r[:, i] * (r @ (w[i] * l))
            steep = float(slope @ slope)
            if steep <= 0:
                continue
            new = min(max(l[i] - float(e @ slope) / steep, 0.0), greatest(l, i))
            e += (new - l[i]) * slope
            l[i] = new
        last, now = now, float(e @ e)
        if last - now <= least_gain * last or now <= exact:
            break
    return l, bag.loss(np.outer(l, l))


def restricted_fit(points: DataFrame, union: DataFrame, starts: int = 30, most_starts: int = 1000, agree: int = 10, apart: float = 0.01, seed: int = 1) -> DataFrame:
    """dataset, pub_idx, l: a_ij = l_i l_j with row sums of 1 at most, the best of many starts, each a row that any task may take.

    Starts are drawn in waves until a data set's `agree` smallest losses lie within a share `apart` of the smallest, or there were
    most_starts; only those losses are kept. A data set that agrees draws no more."""
    spark = points.sparkSession
    left, best, drawn, wave = kept(bags(points, union), "bags"), None, 0, starts

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, attempt, pubs, r, m, y in zip(*(b[c] for c in ("dataset", "try", "pubs", "r", "m", "y")), strict=True):
                l, loss = restricted_parameters(Bag(r, np.asarray(m), np.asarray(y)), restricted_start(len(pubs), seed + int(attempt)))  # noqa: E741
                out.append((name, attempt, list(pubs), l.tolist(), loss, float(np.square(y).sum())))
            yield pd.DataFrame(out, columns=["dataset", "try", "pubs", "l", "loss", "scale"])

    while True:
        tries = F.broadcast(spark.range(drawn, drawn + wave).select(F.col("id").alias("try")))
        found = left.crossJoin(tries).repartition("dataset", "try").mapInPandas(solve, "dataset string, try long, pubs array<int>, l array<double>, loss double, scale double")
        place = F.row_number().over(Window.partitionBy("dataset").orderBy("loss", "try"))  # `agree` rows and a wave
        both = found if best is None else best.unionByName(found)
        best = kept(both.withColumn("place", place).filter(F.col("place") <= agree).drop("place"), "starts")
        drawn += wave
        spread = best.groupBy("dataset").agg(F.count("*").alias("n"), F.min("loss").alias("low"), F.max("loss").alias("high"), F.max("scale").alias("scale"))
        apart_still = spread.filter((F.col("n") < agree) | (F.col("high") > (1 + apart) * F.col("low") + ALIKE * F.col("scale")))
        if drawn >= most_starts or not apart_still.head(1):
            break
        left = kept(left.join(apart_still.select("dataset"), "dataset", "left_semi"), "bags")
        wave = min(drawn, most_starts - drawn)
    top = best.groupBy("dataset").agg(F.min_by(F.arrays_zip(F.col("pubs").alias("pub_idx"), F.col("l").alias("l")), F.struct("loss", "try")).alias("x"))
    return top.select("dataset", F.inline("x"))


def onto_simplex(a: np.ndarray) -> np.ndarray:
    """Rows moved to the nearest points that are not negative and sum to 1."""
    down = -np.sort(-a, axis=1)
    over = np.cumsum(down, axis=1) - 1
    many = np.arange(1, a.shape[1] + 1)
    last = (down - over / many > 0).sum(axis=1)
    return np.maximum(a - (over[np.arange(len(a)), last - 1] / last)[:, None], 0)


def mixture_start(r: np.ndarray, y: np.ndarray, size: float, clusters: int, seed: int, rounds: int, steps: int = 300) -> tuple[np.ndarray, float]:
    """a (publishers x clusters) and its loss, from one random start: shares of clusters that a sum covers, and least squares, by turns."""
    rng, x = np.random.default_rng(seed), r / size
    a = rng.dirichlet(np.ones(clusters) / 5 + 1e-3, size=x.shape[1])

    def loss(a: np.ndarray) -> float:
        hit = 1 - np.prod(1 - x[:, :, None] * a[None], axis=1)
        return float(((hit.sum(axis=1) - y / size) ** 2).sum())

    best = (a, loss(a))
    for _ in range(rounds):
        part = x[:, :, None] * a[None]
        total = part.sum(axis=1)
        theta = np.where(total > 0, (1 - np.prod(1 - part, axis=1)) / np.maximum(total, 1e-300), 1.0)
        z = (x[:, :, None] * theta[:, None, :]).reshape(len(x), -1)
        g, b = z.T @ z, z.T @ (y / size)
        top = np.linalg.eigvalsh(g)[-1] or 1.0
        for _ in range(steps):
            a = onto_simplex(a - ((g @ a.ravel() - b) / top).reshape(a.shape))
        now = loss(a)
        if now < best[1] - 1e-15:
            best = (a, now)
        else:
            break
    return best


def mixture_fit(points: DataFrame, union: DataFrame, clusters: int = 2, starts: int = 10, rounds: int = 100) -> DataFrame:
    """dataset, pub_idx, j, a for mixture_predict: the best of several starts, each a task of its own. A data set's points are
    p + 1 or a few hundred rows."""
    size = points.groupBy("dataset").agg((2 * F.max("max_reach")).alias("n"))
    rows = points.join(union.select("dataset", "point_id", F.col("reach").alias("y")), ["dataset", "point_id"]).join(size, "dataset").select("dataset", "point_id", "pub_idx", "reach", "y", "n")
    tries = points.sparkSession.range(starts).select(F.col("id").alias("try"))

    def solve(s: pd.DataFrame) -> pd.DataFrame:
        r = s.pivot(index="point_id", columns="pub_idx", values="reach").fillna(0.0)
        y = s.groupby("point_id")["y"].first().loc[r.index].to_numpy()
        a, loss = mixture_start(r.to_numpy(), y, float(s["n"].iloc[0]), clusters, int(s["try"].iloc[0]), rounds)
        return pd.DataFrame({"dataset": s["dataset"].iloc[0], "try": s["try"].iloc[0], "pub_idx": np.repeat(r.columns.to_numpy(), clusters), "j": np.tile(np.arange(clusters), a.shape[0]), "a": a.ravel(), "loss": loss})

    every = rows.crossJoin(F.broadcast(tries)).groupBy("dataset", "try").applyInPandas(solve, "dataset string, try long, pub_idx int, j long, a double, loss double")
    best = every.groupBy("dataset").agg(F.min_by("try", F.struct("loss", "try")).alias("try"))
    return every.join(best, ["dataset", "try"]).select("dataset", "pub_idx", "j", "a")
