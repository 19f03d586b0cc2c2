"""Whitening of embeddings by an exact characteristic polynomial.

Entries c become whole numbers z = floor(64 c); whatever is added to all of them changes no covariance. Over the distinct vectors (n of them)
the scatter matrix M = n sum(z z') - s s' (s the sum of the z) holds whole numbers, and n^2 V = M for the covariance V. Its characteristic
polynomial is found exactly: tasks bring M to Hessenberg form modulo one prime each and read the polynomial off, with the greatest common
divisors that tell repeated roots; the Chinese remainder theorem puts the coefficients together. All its roots are real and none is
negative, so the changes of sign of a shifted polynomial count the roots beyond a point without error. For each component a task halves
intervals until they hold one root, halves on to far beyond double precision, and gets its unit vectors from the null space of M less that
root by inverse iteration in whole-number arithmetic.

Only the sums (d^2 numbers for d dimensions), polynomials and vectors of components reach the driver: what grows with the rows stays in tasks.

Defined cases: rows whose vector is null or holds null or non-finite entries go. Shorter vectors count as filled up with zeros. A covariance of
rank r has r components at most: none where all vectors are equal, and then there are no rows. Repeated rows count once in the fit and
are all returned; a repeated root's vectors are some orthonormal basis. Sums must fit 38 digits, otherwise Spark raises an error. Columns of
the input stay, those named as results give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspark.llm.common import put, read, stored

SCALE = 64
MOST = 16
#: Whole numbers below this are exact as doubles.
EXACT = 1 << 53


class Component(NamedTuple):
    value: float  # of the covariance
    explained: float
    vector: list[float]


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    components: list[Component]
    error: float


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def whole(vector: str) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))


def matrix(rows, d: int) -> np.ndarray:
    """Lists of numbers as a matrix of d columns; missing ones are 0."""
    rows = list(rows)
    sizes = np.array([len(r) for r in rows])
    if (sizes == d).all():
        return np.concatenate(rows).reshape(-1, d).astype(np.int64) if len(rows) and d else np.zeros((len(rows), d), np.int64)
    out = np.zeros((len(rows), d), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(z: np.ndarray) -> np.ndarray:
    """z' z without rounding, as Python's whole numbers."""
    top = int(np.abs(z.astype(object)).max()) if z.size else 0
    rows = EXACT // max(top * top, 1)
    if rows < 64:
        return z.astype(object).T @ z.astype(object)
    out = np.zeros((z.shape[1], z.shape[1]), dtype=object)
    for i in range(0, len(z), min(rows, 1 << 20)):
        part = z[i : i + min(rows, 1 << 20)].astype(float)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def scatter(fit: DataFrame, n: int, d: int) -> tuple[list[list[int]], list[int]]:
    """n sum(z z') - s s' and s over a table of vectors z."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums = np.zeros((d, d), dtype=object), np.zeros(d, dtype=object)
        for b in batches:
            z = matrix(b["z"], d)
            total, sums = total + products(z), sums + z.astype(object).sum(axis=0)
        rows = [(i, j, Decimal(int(total[i, j]))) for i in range(d) for j in range(i, d)] + [(i, -1, Decimal(int(sums[i]))) for i in range(d)]
        yield pd.DataFrame(rows, columns=["i", "j", "v"])

    found = fit.mapInPandas(add_up, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # d (d + 3) / 2 numbers
    s, m = [0] * d, [[0] * d for _ in range(d)]
    for r in found:
        if r.j < 0:
            s[r.i] = int(r.v)
        else:
            m[r.i][r.j] = m[r.j][r.i] = int(r.v)
    return [[n * m[i][j] - s[i] * s[j] for j in range(d)] for i in range(d)], s


# The polynomial, modulo primes and whole. Coefficients stand from the highest power down; all are monic.


def is_prime(x: int) -> bool:
    """Without error below 3.2 * 10^9, by strong tests to the bases 2, 3, 5 and 7."""
    if x % 2 == 0:
        return x == 2
    odd, twos = x - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        y = pow(base, odd, x)
        if base % x and y not in (1, x - 1) and all((y := y * y % x) != x - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_over(bound: int) -> list[int]:
    """Primes below 2^31, from the top, whose product is over a bound, and one more."""
    out, product, x = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(x):
            out.append(x)
            product *= x
        x -= 2
    while not is_prime(x):
        x -= 2
    return [*out, x]


def hessenberg(m: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to m modulo p with zeros below its first subdiagonal."""
    h = m.copy()
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        h[[k + 1, i]] = h[[i, k + 1]]
        h[:, [k + 1, i]] = h[:, [i, k + 1]]
        times = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - times[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * times % p).sum(axis=1)) % p
    return h


def polynomial(m: np.ndarray, p: int) -> np.ndarray:
    """The characteristic polynomial of m modulo p, from its Hessenberg form's leading blocks."""
    h = hessenberg(m, p)
    d = len(h)
    blocks = np.zeros((d + 1, d + 1), np.int64)  # of each leading block, from the lowest power up
    blocks[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = blocks[k - 1, :-1]
        new = (new - int(h[k - 1, k - 1]) * blocks[k - 1] % p) % p
        chain = 1
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            if not chain:
                break
            new = (new - int(h[k - i - 1, k - 1]) * chain % p * blocks[k - i - 1] % p) % p
        blocks[k] = new
    return blocks[d][::-1].copy()


def common_divisor(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    while len(b):
        b = b * pow(int(b[0]), -1, p) % p
        a = a.copy()
        while len(a) >= len(b):
            a[: len(b)] = (a[: len(b)] - int(a[0]) * b % p) % p
            a = a[1:]
        a = a[np.flatnonzero(a)[0] :] if a.any() else a[:0]
        a, b = b, a
    return a


def derivative(a: np.ndarray, p: int) -> np.ndarray:
    out = a[:-1] * np.arange(len(a) - 1, 0, -1) % p
    return out[np.flatnonzero(out)[0] :] if out.any() else out[:0]


def with_divisors(m: list[list[int]], p: int) -> list[list[int]]:
    """The polynomial modulo p, its greatest common divisor with its derivative, that one's own, and so on while they aren't 1."""
    out = [polynomial(np.array([[x % p for x in row] for row in m], dtype=np.int64).reshape(len(m), len(m)), p)]
    while len(g := common_divisor(out[-1], derivative(out[-1], p), p)) > 1:
        out.append(g)
    return [x.tolist() for x in out]


def combined(parts: dict[int, list[int]]) -> list[int]:
    """Coefficients, of either sign, from their remainders by prime."""
    values, product = [0] * len(next(iter(parts.values()))), 1
    for p, rest in parts.items():
        back = pow(product, -1, p)
        values = [v + product * ((r - v) * back % p) for v, r in zip(values, rest, strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


def polynomials(spark: SparkSession, m: list[list[int]]) -> list[list[int]]:
    """The characteristic polynomial of m, whose roots aren't negative, and the divisors that repeated roots leave."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    top, choose = 1, 1
    for k in range(1, d + 1):  # products of k roots are (trace / d)^k at most on average, and there are d over k of them
        choose = choose * (d - k + 1) // k
        top = max(top, choose * -(-trace // d) ** k)
    primes = primes_over(2 * top)

    def reduce_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, with_divisors(m, p)) for p in b["p"].tolist()], columns=["p", "found"])

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), max(spark.sparkContext.defaultParallelism, 1)))
    found = {r.p: r.found for r in rows.mapInPandas(reduce_, "p long, found array<array<long>>").collect()}
    shape = min((tuple(map(len, x)) for x in found.values()), key=lambda s: (sum(s), s))  # a prime can only make divisors longer
    out = []
    for i in range(len(shape)):
        good = {p: x[i] for p, x in found.items() if tuple(map(len, x)) == shape or i == 0}
        out.append(combined(good))
    return out


# Roots and vectors


def shifted_signs(c: list[int], a: int, k: int) -> int:
    """How many roots, all of them real, are over a / 2^k: the changes of sign among the coefficients about that point."""
    d = len(c) - 1
    t = [x << (k * i) for i, x in enumerate(c)]  # of the polynomial in 2^k x
    for i in range(d):
        for j in range(1, d + 1 - i):
            t[j] += a * t[j - 1]
    signs = [x > 0 for x in t if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def value_sign(c: list[int], a: int, k: int) -> int:
    out = 0
    for i, x in enumerate(c):
        out = out * a + (x << (k * i))
    return (out > 0) - (out < 0)


def divided(a: list[int], b: list[int]) -> list[int]:
    a, out = list(a), []
    for i in range(len(a) - len(b) + 1):
        out.append(a[i])
        for j, x in enumerate(b):
            a[i + j] -= out[-1] * x
    return out


def root(found: list[list[int]], rank: int) -> tuple[int, int, int]:
    """a, k, place: the rank-th greatest root lies in (a / 2^k, (a + 1) / 2^k] with no other within 2^120 times that, and place is its place (from 0) among equals."""
    every = found[0]
    once = divided(every, found[1]) if len(found) > 1 else every
    low, high, k = -1, 1, 0
    while shifted_signs(every, high, 0) >= rank:
        low, high = high, 2 * high
    while True:
        beyond = shifted_signs(every, high, k)
        if shifted_signs(once, low, k) - shifted_signs(once, high, k) == 1:
            break
        if high - low == 1:
            low, high, k = 2 * low, 2 * high, k + 1
        middle = (low + high) // 2
        low, high = (middle, high) if shifted_signs(every, middle, k) >= rank else (low, middle)
    place, more = rank - 1 - beyond, 120 + 2 * len(every).bit_length()
    low, high, k = low << more, high << more, k + more
    if value_sign(once, high, k) == 0:
        return high - 1, k, place
    right = value_sign(once, high, k)
    while high - low > 1:
        middle = (low + high) // 2
        sign = value_sign(once, middle, k)
        low, high = (low, middle) if sign in (0, right) else (middle, high)
        if sign == 0:
            return middle - 1, k, place
    return low, k, place


def null_vectors(m: list[list[int]], a: int, k: int, many: int) -> np.ndarray:
    """Unit vectors, one below the other, that m less a root near a / 2^k maps to almost nothing: inverse iteration in numbers of fixed point."""
    d = len(m)
    more = k + 2 * max(max(map(abs, row)) for row in m).bit_length() + 64
    one = 1 << more
    t = np.array([[(x << more) - ((a << (more - k)) if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(m)], dtype=object)
    order, times = [], []
    for i in range(d):
        at = i + int(np.argmax(np.abs(t[i:, i])))
        t[[i, at]] = t[[at, i]]
        order.append(at)
        if t[i, i] == 0:
            t[i, i] = 1
        by = t[i + 1 :, i] * one // t[i, i]
        times.append(by)
        if len(by):
            t[i + 1 :, i:] = t[i + 1 :, i:] - (by[:, None] * t[i, i:]) // one
    rng, out = np.random.default_rng(d), []

    def solved(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for i in range(d):
            b[[i, order[i]]] = b[[order[i], i]]
            if i + 1 < d:
                b[i + 1 :] = b[i + 1 :] - (times[i] * b[i]) // one
        x = np.zeros(d, dtype=object)
        for i in reversed(range(d)):
            x[i] = (b[i] - ((t[i, i + 1 :] * x[i + 1 :]).sum() // one if i + 1 < d else 0)) * one // t[i, i]
        return x

    for _ in range(many):
        x = np.array([int(v) << more for v in rng.integers(-(1 << 30), 1 << 30, d)], dtype=object)
        for _ in range(3):
            x = solved(x)
            top = int(np.abs(x).max())
            x = x * one // top
            v = np.array([float(Fraction(int(e), one)) for e in x])
            for u in out + out:  # those of the same root that are there already
                v = v - (u @ v) * u
            v /= np.linalg.norm(v)
            x = np.array([int(e * (1 << 60)) << (more - 60) for e in v], dtype=object) if out else x
        out.append(v)
    return np.array(out)


def components(spark: SparkSession, m: list[list[int]], n: int, most: int = MOST) -> list[Component]:
    """The first components of the covariance m / n^2, each found by a task of its own; at most its rank."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    if not trace:
        return []
    found = polynomials(spark, m)
    rank = max(i for i, x in enumerate(found[0]) if x)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b["r"].tolist():
                a, k, place = root(found, r)
                near = Fraction(2 * a + 1, 1 << (k + 1))
                out.append((r, float(near / n**2), float(near / trace), null_vectors(m, a, k, place + 1)[place].tolist()))
            yield pd.DataFrame(out, columns=["r", "value", "explained", "vector"])

    many = min(most, rank, d)
    rows = spark.createDataFrame([(r,) for r in range(1, many + 1)], "r int").repartition(many, "r")
    got = rows.mapInPandas(solve, "r int, value double, explained double, vector array<double>").orderBy("r").collect()
    return [Component(r.value, r.explained, list(r.vector)) for r in got]


def centred(z: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n z - s, whole numbers: of 64 bits where they fit, otherwise Python's."""
    top = int(np.abs(z.astype(object)).max()) * n + max(map(abs, sums)) if z.size else 0
    return z * n - np.array(sums, dtype=np.int64) if top < 1 << 62 else z.astype(object) * n - np.array(sums, dtype=object)


def projected(z: np.ndarray, n: int, sums: list[int], onto: np.ndarray) -> np.ndarray:
    return (centred(z, n, sums) / n).astype(float) @ onto


def directions(parts: list[Component], d: int) -> np.ndarray:
    return np.array([np.array(c.vector) / np.sqrt(c.value) for c in parts]).reshape(len(parts), d).T


def fitted(df: DataFrame, vector: str = "embedding", most: int = MOST) -> Whitening:
    """What whitens the distinct usable vectors of df."""
    spark = df.sparkSession
    fit = stored(df.filter(usable(vector)).select(whole(vector).alias("z")).distinct(), "whitening-fit")
    # shorter vectors are as if filled up: equal ones then count once
    d = fit.agg(F.max(F.size("z"))).first()[0] or 0
    if fit.filter(F.size("z") < d).head():
        fit = stored(fit.select(F.concat("z", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("z"))).alias("z")).distinct(), "whitening-fit")
    n = fit.count()
    if not n or not d:
        return Whitening(n, [0] * d, [], 0.0)
    m, sums = scatter(fit, n, d)
    parts = components(spark, m, n, most)
    if not parts:
        return Whitening(n, sums, [], 0.0)
    onto, c = directions(parts, d), len(parts)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = np.zeros((c, c + 1))
        for b in batches:
            y = projected(matrix(b["z"], d), n, sums, onto)
            w += y.T @ np.column_stack([y, np.ones(len(y))])
        yield pd.DataFrame([(i, j, float(w[i, j])) for i in range(c) for j in range(c + 1)], columns=["i", "j", "v"])

    w = np.zeros((c, c + 1))
    for r in fit.mapInPandas(add_up, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # 16 * 17 numbers
        w[r.i, r.j] = r.v / n
    return Whitening(n, sums, parts, float(np.abs(w[:, :c] - np.outer(w[:, c], w[:, c]) - np.eye(c)).max()))


def whitened(df: DataFrame, fit: Whitening, vector: str = "embedding") -> DataFrame:
    """A row for each usable row of df and component: component, n, deviation (decimal(38,0), exact), whitened, explained, identity_error."""
    d = len(fit.sums)
    onto = directions(fit.components, d)

    @F.pandas_udf("deviation decimal(38,0), w array<double>")
    def look(rows: pd.Series) -> pd.DataFrame:
        z = matrix(rows, d)
        y = centred(z, fit.n, fit.sums)
        fits = y.dtype != object and y.size and int(np.abs(y).max()) ** 2 * d < 1 << 62
        far = (y * y).sum(axis=1) if fits else (y.astype(object) ** 2).sum(axis=1)
        return pd.DataFrame({"deviation": [Decimal(int(x)) for x in far], "w": list((y / fit.n).astype(float) @ onto)})

    good = df.filter(usable(vector))
    if not fit.components:
        good = good.limit(0)
    both = put(good, x_found=look(whole(vector)))
    wide = both.select(*(F.col(f"`{c}`") for c in both.columns if c != "x_found"), F.col("x_found.deviation").alias("x_deviation"), F.posexplode("x_found.w").alias("x_place", "x_whitened"))
    explained = F.element_at(F.array(*(F.lit(c.explained) for c in fit.components)).cast("array<double>"), F.col("x_place") + 1) if fit.components else F.lit(None).cast("double")
    out = put(wide, component=F.col("x_place") + 1, n=F.lit(fit.n).cast("long"), deviation=F.col("x_deviation"), whitened=F.col("x_whitened"), explained=explained, identity_error=F.lit(fit.error))
    return out.drop("x_deviation", "x_place", "x_whitened")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = whitened(rows, fitted(rows)).drop("embedding")
    return out.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")
