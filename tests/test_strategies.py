import hashlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reachspark.functions import joins, search
from reachspark.operators import curves, evaluate, overlap, points, privacy, reach, sketch, strategies, surfaces, synthetic
from reachspark.plans import queries
from reachspark.sources import logs


def campaign_log(spark, people, publishers=3, dataset="d"):
    """Publisher i reaches people whose number has i among its last digits, so audiences overlap as if at random."""
    rows = spark.range(people * 3).select("id", (F.col("id") % people).alias("vid"), F.explode(F.array(*map(F.lit, range(publishers)))).alias("pub_idx"))
    rows = rows.filter(F.pmod(F.xxhash64("vid", "pub_idx"), F.lit(3)) == 0).withColumn("dataset", F.lit(dataset)).withColumn("publisher", F.concat(F.lit("p"), "pub_idx"))
    along = Window.partitionBy("dataset", "publisher").orderBy(F.xxhash64("id", "pub_idx"), "id")
    return rows.withColumn("seq", F.row_number().over(along)).withColumn("spend", F.col("seq") * 0.1).drop("id")


def trials(spark, *rows):
    return spark.createDataFrame(rows, "trial string, dataset string, strategy string, curve string, surface string, share double")


def spends(spark, log, g=2):
    return points.grid_points(reach.campaign_spend(log, [1.0]), g)


def test_names_are_looked_up(spark):
    log = campaign_log(spark, 60, 1)
    for row, what in ((("t", "d", "none such", "goerg", "none", 0.5), "strategy"), (("t", "d", "m3", "none such", "none", 0.5), "curve")):
        with pytest.raises(ValueError, match=f"no {what}"):
            strategies.evaluated(log, trials(spark, row), spends(spark, log))
    with pytest.raises(ValueError, match="no surface"):
        two = campaign_log(spark, 60, 2)
        strategies.evaluated(two, trials(spark, ("t", "d", "m3", "goerg", "none such", 0.5)), spends(spark, two))


def test_trials(spark):
    """One job for all trials: a single publisher's, several publishers' by each surface, one that fails, one that is done."""
    log = campaign_log(spark, 600).unionByName(campaign_log(spark, 300, 1, "e"))
    rows = [("a", "e", "single_publisher", "goerg", "none", 0.5), ("b", "d", "single_publisher", "goerg", "none", 0.5), ("f", "e", "single_publisher", "goerg", "none", 0.5)]
    rows += [(f"m-{s}", "d", "m3", "goerg", s, 0.5) for s in strategies.SURFACES if s != "none"] + [("one", "e", "m3", "gamma_poisson", "none", 0.5)]
    both, errors, spent = strategies.evaluated(log, trials(spark, *rows), spends(spark, log), trials(spark, rows[2]))
    found = {}
    for r in both.collect():
        found.setdefault(r.trial, []).append((r.x, r.y))
    assert {r.trial: r.error for r in errors.collect()} == {"b": "one publisher only, not 3"} and spent.count() == 0
    assert sorted(found) == sorted(["a", "one", *(t for t, *_ in rows if t.startswith("m-"))])
    assert {t: len(v) for t, v in found.items()} == {t: 2 if t in ("a", "one") else 8 for t in found}
    for t, v in found.items():
        assert all(len(y) == (10 if t in ("a", "one") else 1) for _, y in v)
        assert np.mean([abs(x[0] - y[0]) / x[0] for x, y in v]) < 0.25, t


def test_every_curve_by_name(spark):
    """All curves in one table of trials, alone and under a surface; true curves give the truth of each publisher."""
    log = campaign_log(spark, 600).unionByName(campaign_log(spark, 500, 1, "e"))
    rows = [(f"e-{c}", "e", s, c, "none", 0.5) for c, s in zip(strategies.CURVES, ["single_publisher", "m3"] * 3)]
    rows += [(f"d-{c}", "d", "m3", c, "restricted_pairwise_union", 0.5) for c in strategies.CURVES]
    both, errors, _ = strategies.evaluated(log, trials(spark, *rows), spends(spark, log))
    assert errors.count() == 0
    found = {}
    for r in both.collect():
        found.setdefault(r.trial, []).append((r.x, r.y))
    assert {t: len(v) for t, v in found.items()} == {t: 2 if t[0] == "e" else 8 for t, *_ in rows}
    assert all(x == y for x, y in found["e-true"])
    assert all(np.mean([abs(x[0] - y[0]) / x[0] for x, y in v]) < 0.25 for v in found.values())
    assert all(y == [round(v) for v in y] and sorted(y, reverse=True) == y for _, y in found["e-dirac_mixture"])


def test_tables_are_searched(spark):
    at = [0.5, 1.0, 1.0, 4.0]
    got = spark.createDataFrame([(at, x) for x in (0.0, 0.5, 0.9, 1.0, 3.9, 4.0, 9.0)] + [([], 1.0)], "v array<double>, x double").select(search.last_at_most(F.col("v"), F.col("x")).alias("n")).collect()
    assert [r.n for r in got] == [0, 1, 1, 3, 3, 4, 4, 0]
    one = lambda target, f: spark.range(1).select(search.greatest_input(F.lit(float(target)), f).alias("x")).first().x
    assert [one(t, lambda x: x * x) for t in (0, 1, 2, 99, 100, 1e12)] == [0, 1, 1, 9, 10, 10**6]
    with pytest.raises(Exception, match="never reached"):
        one(5, lambda x: F.least(x, F.lit(4.0)))


def test_inverse_of_every_curve(spark, sf):
    got = queries.inverse_reach_of_curves(spark, sf).collect()
    assert len(got) == 20
    for r in got:
        assert r.reach_0 <= r.greatest / 2 < r.reach_1 and r.spend_at == pytest.approx(r.impressions_at * 0.1, abs=1.1), r


def test_noisy_measurements_spend_the_budget(spark):
    log = campaign_log(spark, 900)
    every = trials(spark, ("m", "d", "m3", "goerg", "restricted_pairwise_union", 1.0))
    both, errors, spent = strategies.evaluated(log, every, spends(spark, log), epsilon=7.0)
    assert errors.count() == 0 and both.count() == 8
    assert spent.count() == 7 and spent.agg(F.sum("epsilon")).first()[0] == pytest.approx(7.0)
    exact, unions = strategies.exact(log, 10), {r.without: r.reach for r in strategies.exact_unions(log).collect()}
    shown, noisy, _ = strategies.private(log, 10, 700.0, "s")
    real = {r.publisher: r.reach for r in exact.collect()}
    assert all(abs(r.reach - real[r.publisher]) < 0.1 * real[r.publisher] for r in shown.collect())
    assert sorted(unions) == [-1, 0, 1, 2] and all(abs(r.reach - unions[r.without]) < 0.1 * unions[r.without] for r in noisy.collect())
    people = {p: {r.vid for r in log.filter(F.col("pub_idx") == p).select("vid").distinct().collect()} for p in range(3)}
    assert unions == {-1: len(set.union(*people.values())), **{i: len(set.union(*(people[j] for j in range(3) if j != i))) for i in range(3)}}


def test_settings_of_trials(spark):
    """Sketch size, budget and repetition are chosen by row: repetitions draw anew, and those of small sketches differ more."""
    log = campaign_log(spark, 900, 1)
    rows = [(f"{size}-{epsilon}-{k}", size, epsilon, k) for size in (60, None) for epsilon in (2.0, 1e5) for k in range(4)] + [("again", None, 1e5, 0)]
    every = trials(spark, *((t, "d", "m3" if t == "again" else "single_publisher", "goerg", "none", 1.0) for t, *_ in rows))
    every = every.join(spark.createDataFrame(rows, "trial string, sketch_size long, epsilon double, replica_id int"), "trial")
    both, errors, spent = strategies.evaluated(log, every, spends(spark, log))
    apart = {r.trial: r.e for r in both.groupBy("trial").agg(F.avg(F.col("x")[0] - F.col("y")[0]).alias("e")).collect()}
    assert errors.count() == 0 and sorted(apart) == sorted(t for t, *_ in rows)
    spread = lambda size, epsilon: np.std([apart[f"{size}-{epsilon}-{k}"] for k in range(4)])
    assert spread(60, 1e5) > 5 * spread(None, 1e5) > 0
    used = {r.trial: r.e for r in spent.groupBy("trial").agg(F.sum("epsilon").alias("e")).collect()}
    assert all(used[t] == pytest.approx(e if t != "again" else e * 2 / 3) for t, _, e, _ in rows)
    with pytest.raises(Exception, match="needs an epsilon"):
        strategies.evaluated(log, every.withColumn("epsilon", F.lit(None).cast("double")), spends(spark, log))[0].count()


def test_settings_share_what_they_buy(spark, monkeypatch):
    """What a share buys is written as a row for each person, however many settings measure it; a sum over slices is worked out once a step."""
    log, sizes = campaign_log(spark, 300, 1), {}
    keep = strategies.kept
    monkeypatch.setattr(strategies, "kept", lambda df, name: (sizes.update({name: x.count()}) if (x := keep(df, name)) and name == "campaigns" else None, x)[1])
    rows = [(f"{epsilon}-{k}", epsilon, k) for epsilon in (2.0, 1e5) for k in range(3)]
    every = trials(spark, *((t, "d", "single_publisher", "goerg", "none", 1.0) for t, *_ in rows)).join(spark.createDataFrame(rows, "trial string, epsilon double, replica_id int"), "trial")
    assert strategies.evaluated(log, every, spends(spark, log))[0].select("trial").distinct().count() == 6
    assert sizes["campaigns"] == log.select("vid").distinct().count()
    assert str(sketch.cardinality(F.col("n"))).lower().count("log1p") == 1


def test_independent_variables(spark):
    rows = [("d", "t", "m3", "goerg", "none", [0.2, 0.4], 7, None), ("gone", "u", "m3", "true", "none", [], None, 3)]
    t = spark.createDataFrame(rows, "dataset string, trial string, strategy string, curve string, surface string, fractions array<double>, sketch_size int, replica_id int")
    log = campaign_log(spark, 90, 2)
    got = {r.trial: r.asDict() for r in evaluate.trial_columns(t, reach.dataset_stats(log)).collect()}
    alone = [log.filter(F.col("pub_idx") == i).select("vid").distinct().count() for i in (0, 1)]
    shared = {"strategy": "m3", "multi_pub_model": "none", "max_frequency": 10, "decay_rate": 12.0}
    assert got["t"].items() >= (shared | {"dataset": "d", "single_pub_model": "goerg", "sketch_size": 7, "replica_id": 0, "campaigns": 2, "largest_pub_reach": max(alone), "reach": log.select("vid").distinct().count(), "average_spend_fraction": pytest.approx(0.3)}).items()
    assert got["u"].items() >= (shared | {"single_pub_model": "true", "sketch_size": 100_000, "replica_id": 3, "campaigns": None, "reach": None, "average_spend_fraction": None}).items()


def test_leave_one_out_of_many_publishers(spark):
    """From 64 publishers on a mask of 64 bits would fail; each publisher i has person i of its own, all share two people and some a few."""
    p = 130
    rows = [("d", f"p{i}", i, v) for i in range(p) for v in (i, 1000, 1001, 2000 + i // 2)] + [("e", "q", 0, 1), ("e", "q", 0, 2)]
    prefix = spark.createDataFrame(rows, "dataset string, publisher string, pub_idx int, vid long")
    people = {i: {v for d, _, j, v in rows if d == "d" and j == i} for i in range(p)}
    got = {(r.dataset, r.kind, r.pub_idx): r.reach for r in overlap.leave_one_out_reach(prefix).collect()}
    want = {("d", "all", None): len(set.union(*people.values())), ("e", "all", None): 2, ("e", "single", 0): 2, ("e", "without", 0): 0}
    want |= {("d", "single", i): len(people[i]) for i in range(p)} | {("d", "without", i): len(set.union(*(people[j] for j in range(p) if j != i))) for i in range(p)}
    assert got == want
    unions = {(r.dataset, r.without): r.reach for r in strategies.exact_unions(prefix).collect()}
    assert unions == {(d, -1 if k == "all" else i): v for (d, k, i), v in want.items() if k != "single"}


def test_noisy_unions_of_many_publishers(spark):
    p = 90
    prefix = spark.range(p * 40).select(F.lit("d").alias("dataset"), F.concat(F.lit("p"), F.col("id") % p).alias("publisher"), (F.col("id") % p).cast("int").alias("pub_idx"), F.pmod(F.xxhash64("id"), F.lit(3000)).alias("vid"), F.lit(0.1).alias("spend"))
    exact = {r.without: r.reach for r in strategies.exact_unions(prefix).collect()}
    shown, noisy, ledger = strategies.private(prefix, 3, 1e6, "s")
    got = {r.without: r.reach for r in noisy.collect()}
    assert sorted(got) == sorted(exact) == list(range(-1, p)) and all(abs(got[i] - exact[i]) < 0.05 * exact[i] for i in exact)
    assert shown.count() == p and ledger.count() == 2 * p + 1


def test_inflated_fit_recovers(spark):
    alpha, beta, n, prefix = 1.5, 2.0, 5000.0, np.array([0.5])
    impressions = 4000.0
    h = curves.inflated_histogram(impressions, alpha, beta, n, prefix, 10)
    p = spark.createDataFrame([("a", impressions, h.tolist())], "key string, impressions double, histogram array<double>")
    fit = curves.kinflated_fit(p)
    back = fit.join(p, "key").select(curves.kinflated_kplus(F.col("impressions"), F.col("alpha"), F.col("beta"), F.col("n"), F.col("prefix"), 10).alias("k"), "prefix").first()
    kplus = np.cumsum(h[::-1])[::-1]
    assert np.abs(np.array(back.k) - kplus).max() < 0.03 * kplus[0]
    plain = curves.expected_histogram(impressions, np.array(alpha), np.array(beta), np.array(n), 10)
    assert curves.inflated_histogram(impressions, alpha, beta, n, np.zeros(0), 10) == pytest.approx(plain)
    assert curves.chi2_share(18.307, 10) == pytest.approx(0.95, abs=1e-4) and curves.chi2_share(3.841, 1) == pytest.approx(0.95, abs=1e-3)


def test_mixture_fit_recovers(spark):
    rng = np.random.default_rng(3)
    a = np.array([[0.9, 0.1], [0.2, 0.8], [0.5, 0.5]])
    p = spark.createDataFrame([("d", i, j, float(r), 900.0) for i in range(40) for j, r in enumerate(rng.uniform(50, 900, 3))], "dataset string, point_id int, pub_idx int, reach double, max_reach double")
    known = spark.createDataFrame([("d", i, j, float(a[i, j])) for i in range(3) for j in range(2)], "dataset string, pub_idx int, j long, a double")
    union = surfaces.mixture_predict(p, known)
    fit = surfaces.mixture_fit(p, union)
    assert {r.pub_idx: round(r.s, 6) for r in fit.groupBy("pub_idx").agg(F.sum("a").alias("s")).collect()} == {0: 1, 1: 1, 2: 1}
    got = surfaces.mixture_predict(p, fit).withColumnRenamed("reach", "y").join(union, "point_id").collect()
    assert np.mean([abs(r.y - r.reach) / r.reach for r in got]) < 0.02
    assert surfaces.onto_simplex(np.array([[2.0, 0.0], [0.4, 0.6], [-1.0, -1.0]])) == pytest.approx(np.array([[1, 0], [0.4, 0.6], [0.5, 0.5]]))


def test_all_subsets_of_twenty_publishers(spark):
    rng = np.random.default_rng(4)
    regions = np.unique(rng.integers(1, 1 << 20, 3000))
    reach_ = rng.integers(1, 50, len(regions))
    df = spark.createDataFrame([(int(r), int(v)) for r, v in zip(regions, reach_, strict=True)], "region long, reach long")
    asked = [int(m) for m in rng.integers(1, 1 << 20, 200)]
    masks = spark.range(1, 1 << 20).select(F.col("id").alias("mask"))
    got = {r.mask: r.reach for r in overlap.subset_union_reach(df, masks).filter(F.col("mask").isin(asked)).collect()}
    assert got == {m: int(reach_[(regions & m) != 0].sum()) for m in asked}
    few = spark.createDataFrame([(m,) for m in asked[:5]], "mask long")
    assert {r.mask: r.reach for r in overlap.subset_union_reach(df, few).collect()} == {m: got[m] for m in asked[:5]}


def test_joins_beyond_a_broadcast(spark):
    large = spark.range(1000).select((F.col("id") % 3).alias("k"), F.lit(1).alias("h"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    got = [sorted(map(tuple, joins.beside(large, small, ["k"], most=m).select("k", "id", "v").collect())) for m in (-1, 10)]
    assert got[0] == got[1] and len(got[0]) == 667


def test_bad_rows_have_line_numbers(spark, tmp_path):
    bad = {2, 5, 900, 1999}
    (tmp_path / "log.csv").write_text("".join("x,y\n" if i in bad else f"{i},0.5\n" for i in range(1, 2001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert {r.line for r in logs.read_bad_rows(spark, str(tmp_path)).collect()} == bad
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_orders_of_sequential_overlap(spark):
    people = spark.range(1000).select(F.col("id").alias("vid"))
    for order in ("original", "reversed", "random"):
        got = synthetic.overlap_sequential([100, 60, 30], people, 0.5, "s", order=order).groupBy("publisher").agg(F.count("*").alias("n")).collect()
        assert {r.publisher: r.n for r in got} == {0: 100, 1: 60, 2: 30}
    with pytest.raises(ValueError):
        synthetic.overlap_sequential([1], people, 0.5, "s", order="none such")


def test_rates_are_not_cut(spark):
    people = spark.range(400).select(F.col("id").alias("vid"))
    mean = synthetic.heterogeneous(people, 2.0, 150.0, "x").count() / 400
    assert mean == pytest.approx(301, rel=0.1)
    f = synthetic.homogeneous(people, 300.0, "x").groupBy("vid").count().agg(F.avg("count"), F.var_pop("count")).first()
    assert f[0] == pytest.approx(301, rel=0.01) and f[1] == pytest.approx(300, rel=0.3)
    with pytest.raises(Exception, match="several numbers"):
        people.select(synthetic.poisson(F.lit(101.0), "vid", seed="x")).collect()


def test_designs_of_mixed_rows(spark):
    """As many data sets as rows, each by its own law, price and overlap."""
    rows = [(f"{law}-{overlap}-{order}", 3, 400, 0.25, law, a, b, cost, overlap, 0.5, order, 1000) for law, a, b, cost in (("homogeneous", 250.0, None, 0.1), ("heterogeneous", 0.5, 2.0, 0.2), ("heavy_tailed", 2.5, None, 0.3)) for overlap, order in (("full", None), ("disjoint", None), ("sequential", "original"), ("sequential", "reversed"), ("sequential", "random"), ("independent", None))]
    schema = "dataset string, publishers int, largest int, ratio double, law string, a double, b double, cost double, overlap string, share double, order string, universe int"
    got = {}
    for r in synthetic.generate_designs(spark.createDataFrame(rows, schema), "t").collect():
        got.setdefault(r.dataset, {}).setdefault(r.publisher, []).append((r.seq, r.vid, r.spend))
    assert sorted(got) == sorted(r[0] for r in rows)
    for name, *_, law, _, _, cost, overlap, _, order, _ in rows:
        seen = {p: {v for _, v, _ in x} for p, x in got[name].items()}
        assert {p: len(v) for p, v in seen.items()} == {1: 400, 2: 200, 3: 100}
        for x in got[name].values():
            assert sorted(s for s, *_ in x) == list(range(1, len(x) + 1)) and all(spend == pytest.approx(s * cost) for s, _, spend in x)
        mean = np.mean([len(x) / len(seen[p]) for p, x in got[name].items()])
        assert mean == pytest.approx({"homogeneous": 251, "heterogeneous": 2, "heavy_tailed": 1.95}[law], rel=0.03 if law == "homogeneous" else 0.4)
        both = {(p, q): len(seen[p] & seen[q]) for p, q in ((1, 2), (2, 3), (1, 3))}
        if overlap == "full":
            assert both == {(1, 2): 200, (2, 3): 100, (1, 3): 100}
        elif overlap == "disjoint":
            assert set(both.values()) == {0}
        elif overlap == "independent":
            assert both[1, 2] == pytest.approx(80, abs=25) and both[1, 3] == pytest.approx(40, abs=20) and max(v for x in seen.values() for v in x) < 1000
        elif order == "original":
            assert (both[1, 2], both[2, 3]) == (100, 50)
        elif order == "reversed":
            assert (both[2, 3], both[1, 2]) == (100, 200)
    with pytest.raises(ValueError, match="no overlap none such"):
        synthetic.generate_designs(spark.createDataFrame([("x", 1, 10, 1.0, "homogeneous", 1.0, None, 1.0, "none such", 0.5, None, 10)], schema), "t")


def test_uniform_numbers_are_digests(spark):
    got = spark.range(3).select("id", privacy.uniform("id", seed="s").alias("u")).collect()
    assert [r.u for r in got] == [(int(hashlib.md5(f"{r.id}/s".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for r in got]


def test_regions_tell_first_reach_only(spark):
    log = campaign_log(spark, 60)
    spent = reach.campaign_spend(log, [1.0])
    with pytest.raises(ValueError, match="1. reach"):
        overlap.regions_dp(log, spent, 1.0, "s", most=2)
    found, ledger = overlap.regions_dp(log, spent, 1.0, "s")
    assert found.count() == 7 and ledger.count() == 2 and overlap.regions_dp(log, spent.withColumn("spend_limit", F.lit(0.0)), 1.0, "s")[1].count() == 0
