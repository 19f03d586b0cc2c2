import time

import numpy as np
import pytest

from reachspark.operators import surfaces


def training(rng, p, points, a=None, noise=0.0):
    m = 1000.0 * 0.8 ** np.arange(p)
    r = m * rng.uniform(0.1, 1, (points, p))
    bag = surfaces.Bag(r, m, np.zeros(points))
    bag.y = bag.lost(a) + noise * rng.normal(size=points)
    return bag, r, m


def overlap_of(rng, p):
    a = rng.uniform(0, 2 / p, (p, p))
    return surfaces.project(a)


def table(spark, r, m, y, name="d"):
    p = spark.createDataFrame([(name, t, i, float(r[t, i]), float(m[i])) for t in range(r.shape[0]) for i in range(r.shape[1])], "dataset string, point_id int, pub_idx int, reach double, max_reach double")
    u = spark.createDataFrame([(name, t, float(r[t].sum() - y[t])) for t in range(len(y))], "dataset string, point_id int, reach double")
    return p, u


def test_projection_is_the_nearest_point():
    """No feasible point is on the far side: (x - p) (z - p) <= 0 for all feasible z. Scaling rows down does not give that."""
    rng = np.random.default_rng(0)
    for p in (3, 5, 8):
        x = rng.normal(0.2, 0.6, (p, p))
        near = surfaces.project(x)
        assert np.abs(near - near.T).max() < 1e-11 and (near >= 0).all() and np.diag(near).max() == 0 and near.sum(axis=1).max() <= 1 + 1e-11
        for _ in range(300):
            z = rng.uniform(0, 1, (p, p)) * (rng.random((p, p)) < 0.5)
            z = (z + z.T) / 2
            np.fill_diagonal(z, 0)
            z /= max(1.0, z.sum(axis=1).max())
            assert ((x - near) * (z - near)).sum() <= 1e-8
    assert surfaces.project(np.full((3, 3), 5.0)) == pytest.approx(np.array([[0, 0.5, 0.5], [0.5, 0, 0.5], [0.5, 0.5, 0]]))


def test_pairwise_recovers_overlap(spark):
    """Three publishers and fifty points, sizes that fall by 0.8."""
    rng = np.random.default_rng(1)
    a = overlap_of(rng, 3)
    bag, r, m = training(rng, 3, 50, a)
    got = {(x.i, x.j): x.a for x in surfaces.pairwise_fit(*table(spark, r, m, bag.y)).collect()}
    assert len(got) == 6 and all(got[i, j] == pytest.approx(a[i, j], abs=0.01) for i, j in got)


def test_pairwise_with_a_hundred_publishers(spark):
    """Conditions of an optimum: a step against the gradient leads back to the same point; and all of it takes seconds."""
    rng = np.random.default_rng(2)
    p = 100
    m = rng.uniform(200, 1000, p)
    r = np.vstack([m * 0.6] + [np.where(np.arange(p) == i, 0, m * 0.6) for i in range(p)])  # all, and all but each
    bag = surfaces.Bag(r, m, np.zeros(p + 1))
    bag.y = bag.lost(overlap_of(rng, p)) * rng.uniform(0.9, 1.1, p + 1)
    began = time.time()
    a = surfaces.pairwise_parameters(bag)
    assert time.time() - began < 30
    assert a.sum(axis=1).max() <= 1 + 1e-9 and (a >= 0).all()
    slope = bag.back(bag.lost(a) - bag.y)
    scale = 1 / np.abs(bag.back(bag.y)).max()
    assert np.abs(surfaces.project(a - scale * slope) - a).max() < 1e-4
    assert bag.loss(a) < 0.02 * bag.loss(np.zeros((p, p)))
    got = surfaces.pairwise_fit(*table(spark, r, m, bag.y)).count()
    assert got == p * (p - 1)


def test_restricted_fixture_and_bounds():
    assert surfaces.feasible(np.full(3, 0.5)) and not surfaces.feasible(np.ones(3))
    l = np.array([0.2, 0.5, 0.5])  # noqa: E741
    assert surfaces.greatest(l, 0) == pytest.approx(1)
    assert surfaces.feasible(np.array([1, 0.5, 0.5])) and not surfaces.feasible(np.array([1.1, 0.5, 0.5]))
    d = np.outer([1, 2, 3], [1, 2, 3]) * 2 * (w := surfaces.Bag(np.ones((1, 3)), np.array([3.0, 2, 1]), np.zeros(1)).w)
    assert d[0, 1:] == pytest.approx([1 / 3 * 2 * 0.5 * 2, 1], abs=1e-3) and d[1, 2] == pytest.approx(3) and np.diag(w).max() == 0
    for seed in range(50):
        assert surfaces.feasible(surfaces.restricted_start(7, seed))


def test_restricted_recovers_and_keeps_bounds(spark):
    rng = np.random.default_rng(3)
    l = surfaces.restricted_start(4, 11)  # noqa: E741
    bag, r, m = training(rng, 4, 60, np.outer(l, l))
    got = [x.l for x in surfaces.restricted_fit(*table(spark, r, m, bag.y)).orderBy("pub_idx").collect()]
    assert np.outer(got, got)[~np.eye(4, dtype=bool)] == pytest.approx(np.outer(l, l)[~np.eye(4, dtype=bool)], abs=0.01)
    # where the best would be infeasible the walls hold
    bag.y = bag.y * 50
    for seed in range(5):
        found, loss = surfaces.restricted_parameters(bag, surfaces.restricted_start(4, seed))
        assert surfaces.feasible(found) and loss == pytest.approx(bag.loss(np.outer(found, found)))


def test_restricted_with_a_hundred_publishers(spark):
    rng = np.random.default_rng(4)
    p = 100
    l = surfaces.restricted_start(p, 5)  # noqa: E741
    m = rng.uniform(200, 1000, p)
    r = np.vstack([m * 0.6] + [np.where(np.arange(p) == i, 0, m * 0.6) for i in range(p)])
    y = surfaces.Bag(r, m, np.zeros(p + 1)).lost(np.outer(l, l))
    began = time.time()
    points, union = table(spark, r, m, y)
    got = np.array([x.l for x in surfaces.restricted_fit(points, union).orderBy("pub_idx").collect()])
    assert len(got) == p and surfaces.feasible(got) and time.time() - began < 120
    assert surfaces.Bag(r, m, y).loss(np.outer(got, got)) < 1e-3 * float(y @ y)


def test_starts_go_on_until_they_agree(spark):
    """Losses that never agree use up all starts; other data sets of the same job stop after the first wave."""
    rng = np.random.default_rng(5)
    bag, r, m = training(rng, 3, 20, np.outer([0.3, 0.4, 0.5], [0.3, 0.4, 0.5]))
    p1, u1 = table(spark, r, m, bag.y, "easy")
    p2, u2 = table(spark, r, m, bag.y * rng.uniform(-1, 3, 20), "hard")
    got = surfaces.restricted_fit(p1.union(p2), u1.union(u2), starts=10, most_starts=40, agree=5).collect()
    assert {(x.dataset, x.pub_idx) for x in got} == {(d, i) for d in ("easy", "hard") for i in range(3)}
    one = np.array([x.l for x in sorted(got, key=lambda x: x.pub_idx) if x.dataset == "easy"])
    assert np.outer(one, one)[0, 1:] == pytest.approx([0.12, 0.15], abs=0.01)
