import numpy as np
import pytest

from reachspark.llm import whitening as W


def brute_polynomial(m):
    """Coefficients by traces of powers (Newton's identities), in whole numbers."""
    a, p, c = np.array(m, dtype=object), np.array(m, dtype=object), [1]
    traces = []
    for k in range(1, len(m) + 1):
        traces.append(int(np.trace(p)))
        c.append(-sum(c[k - i] * traces[i - 1] for i in range(1, k + 1)) // k)
        p = p @ a
    return c


def gram(rng, d, r, top=50):
    x = rng.integers(-top, top, (d, r)).astype(object)
    return (x @ x.T).tolist()


def test_polynomials_match_newtons_identities(spark):
    rng = np.random.default_rng(2)
    for d, r in ((1, 1), (2, 2), (5, 5), (9, 4), (12, 12)):
        m = gram(rng, d, r)
        assert W.polynomials(spark, m)[0] == brute_polynomial(m)
    # a subdiagonal that vanishes, and roots that repeat: 2, 2, 2, 5, 5, 7
    assert W.polynomials(spark, np.diag([2, 5, 2, 7, 5, 2]).tolist()) == [brute_polynomial(np.diag([2, 5, 2, 7, 5, 2]).tolist()), [1, -9, 24, -20], [1, -2]]
    assert W.is_prime((1 << 31) - 1) and [x for x in range(2, 60) if W.is_prime(x)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert not W.is_prime(25326001) and len(W.primes_over(1 << 100)) == 5


def test_roots_are_counted_and_found():
    c = brute_polynomial(np.diag([2, 5, 2, 7, 5, 2]).tolist())
    assert [W.shifted_signs(c, a, 1) for a in (0, 3, 4, 5, 9, 10, 13, 14)] == [6, 6, 3, 3, 3, 1, 1, 0]
    found = [c, [1, -9, 24, -20], [1, -2]]
    got = [W.root(found, r) for r in range(1, 7)]
    assert [round((a + 1) / 2**k) for a, k, _ in got] == [7, 5, 5, 2, 2, 2] and [p for *_, p in got] == [0, 0, 1, 0, 1, 2]
    # x^2 - 2 x + 1/2 has roots 1 +- sqrt(1/2); with whole numbers: (2x)^2 - 4 (2x) + 2
    a, k, _ = W.root([[1, -4, 2]], 1)
    assert (a / 2**k, k >= 100) == (pytest.approx(2 + 2**0.5, abs=1e-15), True)


def test_vectors_are_those_of_a_library(spark):
    rng = np.random.default_rng(5)
    m = gram(rng, 10, 10)
    values, vectors = np.linalg.eigh(np.array(m, dtype=float))
    for i, c in enumerate(W.components(spark, m, 1, 10)):
        assert c.value == pytest.approx(values[-1 - i], rel=1e-9) and c.explained == pytest.approx(values[-1 - i] / values.sum(), rel=1e-9)
        assert abs(np.dot(c.vector, vectors[:, -1 - i])) == pytest.approx(1, abs=1e-10)
    # two roots nearly alike, and equal ones
    close = [[10**12, 1, 0], [1, 10**12, 0], [0, 0, 5]]
    a, b, c = W.components(spark, close, 1, 3)
    assert np.abs(np.abs(a.vector[:2]) - 0.5**0.5).max() < 1e-15 and a.vector[0] * a.vector[1] > 0 > b.vector[0] * b.vector[1] and c.value == 5
    same = W.components(spark, np.diag([4, 9, 4, 9]).tolist(), 1, 4)
    v = np.array([x.vector for x in same])
    assert [x.value for x in same] == pytest.approx([9, 9, 4, 4], rel=1e-14) and np.abs(v @ v.T - np.eye(4)).max() < 1e-14


def test_query_matches_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([np.floor(64 * np.array(r.embedding, dtype=float)).astype(np.int64) + 1_000_000 for r in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    got = W.query(spark, sf).collect()
    assert len(got) == 16 * len(rows) and {r.component for r in got} == set(range(1, 17)) and {r.n for r in got} == {n}
    assert [r.name for r in W.query(spark, sf).schema] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert max(r.identity_error for r in got) < 1e-9
    place = {r.vec_id: i for i, r in enumerate(rows)}
    want = (x - s / n) @ (vectors[:, ::-1][:, :16] / np.sqrt(values[::-1][:16]))
    have = np.zeros_like(want)
    for r in got:
        have[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == int(((n * x[place[r.vec_id]] - s) ** 2).sum()) and r.explained == pytest.approx(values[-r.component] / values.sum(), rel=1e-9)
    sign = np.sign((have * want).sum(axis=0))
    assert np.abs(have * sign - want).max() < 1e-7


def test_edge_cases(spark):
    rows = [(1, [1.0, 2.0, 0.5], 7), (1, [1.0, 2.0, 0.5], 7), (2, [0.0, 2.0, 0.25], 7), (3, None, 7), (4, [1.0, None, 2.0], 7), (5, [float("nan"), 1.0, 1.0], 7), (6, [float("-inf"), 1.0, 1.0], 7), (None, [0.5, 2.0], 7), (7, [], 7)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, Component int")
    fit = W.fitted(df, "v")
    assert fit.n == 4 and fit.sums == [96, 384, 48] and len(fit.components) == 3 and fit.error < 1e-9
    got = W.whitened(df, fit, "v")
    assert got.columns == ["vec_id", "v", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted((str(r.vec_id), r.component) for r in got.collect()) == sorted((i, c) for i in ("1", "1", "2", "None", "7") for c in (1, 2, 3))
    x = np.array([[64, 128, 32], [0, 128, 16], [32, 128, 0], [0, 0, 0]])
    assert {(r.vec_id, int(r.deviation)) for r in got.filter("vec_id is not null").collect()} == {(i, int(((4 * x[k] - x.sum(axis=0)) ** 2).sum())) for i, k in ((1, 0), (2, 1), (7, 3))}
    for none in (df.limit(0), df.filter("vec_id = 1"), df.filter("vec_id = 7")):
        flat = W.fitted(none, "v")
        assert flat.components == [] and W.whitened(none, flat, "v").count() == 0
    # numbers beyond doubles' whole ones stay exact, and rank below the dimension leaves components out
    big = spark.createDataFrame([(i, [float(i * 2**40), float(-i * 2**40), 3.0]) for i in range(5)], "vec_id long, v array<double>")
    fit = W.fitted(big, "v")
    assert len(fit.components) == 1 and fit.error < 1e-9 and np.abs(np.abs(fit.components[0].vector) - [0.5**0.5, 0.5**0.5, 0]).max() < 1e-15
    assert {int(r.deviation) for r in W.whitened(big, fit, "v").collect()} == {2 * ((5 * i - 10) * 2**46) ** 2 for i in range(5)}
