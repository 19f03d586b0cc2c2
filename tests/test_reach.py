import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reachspark.operators import overlap, points, reach, sketch
from reachspark.plans import queries
from reachspark.sources import logs
from reachspark.sources.scratch import job, kept

PDF = [("pdf1", 0, [(1, 0.01), (2, 0.02), (1, 0.04), (3, 0.05)]), ("pdf2", 1, [(2, 0.03), (4, 0.06)])]
THIRD = [("pdf3", 2, [(2, 0.01), (3, 0.03), (4, 0.05)])]


def log_of(spark, publishers):
    rows = [("d", p, i, n + 1, v, s) for p, i, x in publishers for n, (v, s) in enumerate(x)]
    return spark.createDataFrame(rows, "dataset string, publisher string, pub_idx int, seq long, vid long, spend double")


def limits_of(spark, values, name="spend_limit"):
    return spark.createDataFrame([("d", f"pdf{i + 1}", i, float(v)) for i, v in enumerate(values)], f"dataset string, publisher string, pub_idx int, {name} double")


def kplus(spark, log, values, most, by="spend_limit"):
    cut = (reach.within if by == "spend_limit" else reach.within_impressions)(log, limits_of(spark, values, by))
    return [r.reach for r in reach.kplus(reach.user_counts(cut), most=most).orderBy("k").collect()]


def test_two_publishers(spark):
    log = log_of(spark, PDF)
    s = reach.dataset_stats(log).first()
    assert (s.publishers, s.reach, s.universe, s.max_publisher_reach) == (2, 4, 8, 3)
    assert kplus(spark, log, (4, 0), 2, "impression_limit") == [3, 1]
    assert kplus(spark, log, (4, 2), 1, "impression_limit") == [4]
    assert kplus(spark, log, (3, 1), 1, "impression_limit") == [2]
    assert kplus(spark, log, (0.05, 0.06), 1) == [4]
    assert kplus(spark, log, (0.04, 0.04), 3) == [2, 2, 0]
    spends = {r.publisher: r.spend_limit for r in reach.campaign_spend(log, [0.4, 0.5]).collect()}
    assert spends == pytest.approx({"pdf1": 0.02, "pdf2": 0.03})


def test_spends_and_impressions(spark):
    log = log_of(spark, PDF)
    at = spark.createDataFrame([("d", "pdf1", n) for n in (0, 2, 99)], "dataset string, publisher string, impressions long")
    assert [r.spend for r in reach.spend_by_impressions(log, at).orderBy("impressions").collect()] == [0.0, 0.02, 0.05]
    ties = log_of(spark, [("p", 0, [(1, 0.01), (2, 0.02), (3, 0.02), (1, 0.04)])])
    pts = spark.createDataFrame([("d", "p", s) for s in (0.005, 0.015, 0.02, 0.05)], "dataset string, publisher string, spend double")
    assert [r.impressions for r in reach.impressions_by_spend(ties, pts).orderBy("spend").collect()] == [0, 1, 3, 4]


def test_curve_and_points_match_a_recount(spark):
    log = log_of(spark, PDF + THIRD)
    pts = spark.createDataFrame([("d", p, s) for p in ("pdf1", "pdf2", "pdf3") for s in (0.0, 0.01, 0.035, 0.05, 1.0)], "dataset string, publisher string, spend double")
    for r in reach.reach_curve(log, pts, 3).collect():
        f = log.filter((F.col("publisher") == r.publisher) & (F.col("spend") <= r.spend)).groupBy("vid").count().filter(F.col("count") >= r.k).count() if r.k == 1 and r.spend in (0.0, 0.05) else None
        assert f is None or f == r.reach
    vectors = [(0.05, 0.08, 0.03), (0.0, 0.0, 0.0), (0.02, 0.03, 0.01)]
    p = spark.createDataFrame([("d", i, f"pdf{j + 1}", s) for i, v in enumerate(vectors) for j, s in enumerate(v)], "dataset string, point_id int, publisher string, spend double")
    got = {}
    for r in reach.reach_at_points(log, p, 3).collect():
        got.setdefault(r.point_id, {})[r.k] = r.reach
    for i, v in enumerate(vectors):
        assert [got[i][k] for k in (1, 2, 3)] == (kplus(spark, log, v, 3) or [0, 0, 0])


def test_histograms(spark):
    counts = spark.createDataFrame([("d", v, f) for v, f in {3: 1, 2: 1, 1: 2, 4: 3, 5: 4}.items()], "dataset string, vid long, f long")
    h = reach.histogram(counts, most=3)
    assert [r.users for r in h.orderBy("f").collect()] == [2, 1, 2]
    k = reach.kplus_from_histogram(h)
    assert [r.reach for r in k.orderBy("k").collect()] == [5, 3, 2]
    assert [r.users for r in reach.histogram_from_kplus(k).orderBy("f").collect()] == [2, 1, 2]
    known = spark.createDataFrame([("d", 10)], "dataset string, universe long")
    assert [r.users for r in reach.with_unreached(h, known).orderBy("f").collect()] == [5, 2, 1, 2]
    assert reach.max_nonzero_frequency(k).first().max_frequency == 3
    with pytest.raises(Exception, match="universe"):
        reach.with_unreached(h, known.filter("universe is null")).collect()
    with pytest.raises(Exception, match="no reach at frequency"):
        spark.range(1).select(reach.reach_at(F.array(F.lit(1.0)), 2)).collect()
    with pytest.raises(ValueError):
        reach.check_vector(known, [1.0, 2.0])


def test_regions(spark):
    log, spent = log_of(spark, PDF + THIRD), limits_of(spark, (0.05, 0.08, 0.03))
    active = overlap.active_publishers(spent)
    regions = overlap.venn_regions(overlap.user_region(reach.within(log, spent)), overlap.powerset(spark, active), 2)
    got = {(r.region, r.k): r.reach for r in regions.collect()}
    assert [got[i, 1] for i in range(1, 8)] == [1, 1, 0, 0, 1, 0, 1] and [got[i, 2] for i in range(1, 8)] == [1, 0, 0, 0, 1, 0, 1]
    one = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "region long, reach long")
    masks = spark.createDataFrame([(1,), (3,)], "mask long")
    assert {r.mask: r.reach for r in overlap.subset_union_reach(one, masks).collect()} == {1: 3, 3: 4}
    three = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "region long, reach long")
    assert {r.region: r.reach for r in overlap.scale_regions(three, 20).collect()} == {1: 8, 2: 8, 3: 4}
    with pytest.raises(ValueError):
        overlap.powerset(spark, (1 << 21) - 1)


def test_private_regions_draw_as_many_as_the_sketch_shows(spark, sf):
    def campaign(people):
        row = [F.lit("d").alias("dataset"), F.concat(F.lit("pdf"), F.col("i") + 1).alias("publisher"), F.col("i").cast("int").alias("pub_idx"), "vid"]
        return spark.range(people).select(F.col("id").alias("vid"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).filter("i = 0 or vid % 10 = 0").select(*row)

    spent = limits_of(spark, (1, 1))
    for people in (50, 20000):
        active = sketch.active_registers(sketch.build(campaign(people), "dp", ("dataset",))).first().active
        assert overlap.sample_users(overlap.user_region(campaign(people)), active, "dp").count() == active
        got = {r.region: r.reach for r in overlap.regions_dp(campaign(people), spent, 1.0, "dp", noise=False)[0].collect()}
        # noise off, counts of the sample are what scaling left in proportion: whole numbers that sum to the registers in use by one
        parts = [r * active / sum(got.values()) for r in got.values()]
        assert sorted(got) == [1, 2, 3] and got[2] == 0 and all(abs(x - round(x)) < 1e-6 for x in parts)
        assert sum(got.values()) == pytest.approx(people, rel=0.03) and (people < 100 or got[3] == pytest.approx(people / 10, rel=0.1))
    assert overlap.regions_dp(campaign(50), limits_of(spark, (0, 0)), 1.0, "dp")[0].count() == 0
    assert queries.venn_reach_dp(spark, sf).count() == 31  # fewer than 200 people are reached there


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("2,0.02\n1,0.01\n")
    (tmp_path / "b.csv").write_text("5,0.5\n")
    got = logs.read_dataset(spark, str(tmp_path), "d").orderBy("publisher", "seq").collect()
    assert [(r.publisher, r.pub_idx, r.seq, r.vid) for r in got] == [("a", 0, 1, 1), ("a", 0, 2, 2), ("b", 1, 1, 5)]
    (tmp_path / "c.csv").write_text("1,0.1\nx,y\n")
    assert [r.bad for r in logs.read_bad_rows(spark, str(tmp_path / "c.csv")).collect()] == ["x,y"]
    with pytest.raises(Exception):
        logs.read_log(spark, str(tmp_path / "c.csv")).collect()
    design = str(tmp_path / "design")
    log = log_of(spark, PDF)
    logs.write_dataset(log, design)
    assert [r.dataset for r in logs.dataset_names(logs.read_design(spark, design)).collect()] == ["d"]
    with pytest.raises(ValueError):
        logs.add_dataset(spark, log, design)
    logs.add_dataset(spark, log.withColumn("dataset", F.lit("e")), design)
    assert logs.read_design(spark, design, ["e"]).count() == 6


def test_reach_at_points_matches_a_recount(spark):
    """Two data sets, one of them of one publisher; points that leave a publisher out, share spends, or buy nothing."""
    rows = [("d", f"p{p}", p, n, (n * (3 + p) + p) % 17, round(0.1 * n, 6)) for p in range(3) for n in range(1, 60)]
    rows += [("e", "q", 0, n, n % 5, round(0.1 * n, 6)) for n in range(1, 30)]
    log = spark.createDataFrame(rows, "dataset string, publisher string, pub_idx int, seq long, vid long, spend double")
    spends = {("d", 0): (1.0, 2.0, 0.0), ("d", 1): (1.0, 5.9, 3.3), ("d", 2): (None, 1.05, 100.0), ("d", 3): (0.0, 0.0, 0.0), ("e", 0): (0.7,), ("e", 1): (2.9,), ("e", 2): (0.0,)}
    asked = [(d, i, f"p{p}" if d == "d" else "q", s) for (d, i), v in spends.items() for p, s in enumerate(v) if s is not None]
    at = spark.createDataFrame(asked, "dataset string, point_id int, publisher string, spend double")
    for most in (1, 4):
        want = {}
        for (d, i) in spends:
            seen = Counter(v for x, pub, _, _, v, s in rows for y, j, q, t in asked if (x, pub) == (y, q) and (y, j) == (d, i) and s <= t)
            want |= {(d, i, k): sum(n >= k for n in seen.values()) for k in range(1, most + 1)}
        assert {(r.dataset, r.point_id, r.k): r.reach for r in reach.reach_at_points(log, at, most).collect()} == want
    assert reach.reach_at_points(log, at.limit(0)).count() == 0


def test_saturated_logs_have_few_signatures(spark, sf):
    """What meets the points is bounded by signatures, not by people and publishers."""
    log = logs.log_from_events(spark, sf)
    at = points.grid_points(reach.campaign_spend(log, [1.0]), 2)
    spends = at.groupBy("dataset", "publisher").agg(F.sort_array(F.collect_set("spend")).alias("at")).join(log.select("publisher", (F.col("pub_idx") + 1).alias("no")).distinct(), "publisher")
    found = reach.signatures(log, spends, 1)
    people = log.select("vid").distinct().count()
    assert found.agg(F.sum("people")).first()[0] == people and found.count() <= people / 3
    # nobody's impressions after the first of a publisher, or beyond the last point, tell
    assert found.filter(F.size("signature") > 5).count() == 0


def test_a_query_writes_its_log_once(spark, sf, monkeypatch):
    written = []
    monkeypatch.setattr(queries, "kept", lambda df, name: written.append(name) or kept(df, name))
    for name, most in (("error_metrics", 1), ("pairwise_overlap_features", 1), ("sketch_estimate", 0), ("reach_by_spend", 0), ("goerg_predict", 0), ("frequency_histogram", 0), ("all_subset_reach", 0), ("pairwise_fit", 1)):
        written.clear()
        queries.QUERIES[name](spark, sf)
        assert written.count("log") == most, name


def test_a_prefix_opens_few_files(spark, sf, tmp_path):
    log, design = logs.log_from_orders(spark, sf), str(tmp_path / "design")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        logs.write_dataset(log.repartition(4), design)
        for i in range(3):  # more files for each publisher
            logs.write_dataset(log.withColumns({"dataset": F.lit("orders"), "spend": F.col("spend") + 1000.0 * (i + 1)}), design)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    logs.index_design(spark, design)
    whole = logs.read_design(spark, design)
    spent = reach.campaign_spend(log, [0.1])
    got = logs.read_prefix(spark, design, spent)
    assert got.columns == whole.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, reach.within(whole, spent).select(*got.columns).collect()))
    assert len(got.inputFiles()) <= len(whole.inputFiles()) / 3
    assert "LessThanOrEqual(spend," in got._jdf.queryExecution().executedPlan().toString()
    assert logs.read_prefix(spark, design, spent.withColumn("spend_limit", F.lit(-1.0))).count() == 0
    assert logs.read_design(spark, design).count() == 4 * log.count()  # the index is no data


def test_a_job_deletes_what_it_kept(spark, tmp_path):
    outside = kept(spark.range(3), "outside")
    with job(spark):
        inside = kept(spark.range(5), "inside")
        inside.write.parquet(str(tmp_path / "result"))
        files = inside.inputFiles()
    with pytest.raises(ZeroDivisionError), job(spark):
        failed = kept(spark.range(7), "failed").inputFiles()
        raise ZeroDivisionError
    gone = [p.removeprefix("file://") for p in files + failed]
    assert gone and not any(os.path.exists(p) for p in gone)
    assert outside.count() == 3 and spark.read.parquet(str(tmp_path / "result")).count() == 5
