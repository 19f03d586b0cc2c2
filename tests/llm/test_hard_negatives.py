import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reachspark.llm import hard_negatives as H


def brute(rows):
    """All inner products; each row is itself. rows: (vec_id, label, vector)."""
    rows = [(i, lab, np.floor(256 * np.array(v, dtype=float)).astype(object)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for *_, v in rows), default=0)
    rows = [(i, lab, np.concatenate([v, np.zeros(d - len(v), dtype=object)])) for i, lab, v in rows]
    out = []
    for n, (i, lab, v) in enumerate(rows):
        if i % 100:
            continue
        scores = [(-int(v @ w), j, other == lab) for m, (j, other, w) in enumerate(rows) if m != n]
        for ps, p, _ in sorted(s for s in scores if s[2])[:5]:
            fit = sorted(s for s in scores if not s[2] and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:10]
            out += [(i, p, r + 1, j, -ps, -ns) for r, (ns, j, _) in enumerate(fit)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, v array<double>")


def test_matches_brute_force_on_lengths_of_many_sizes(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        center = np.eye(8)[i % 8] * 3  # a few great coordinates, so that ranges are narrow
        rows.append((i, i % 5, ((center + rng.normal(0, 0.4, 8)) * rng.choice([0.05, 0.3, 1, 4])).tolist()))
    rows += [(i, 1, rows[7][2]) for i in range(900, 960)] + [(300, 0, rows[300][2]), (300, 0, rows[300][2])]  # copies, and a repeated anchor
    want = brute(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        for block in (4, 20_000):
            got = sorted(map(tuple, H.mined(table(spark, rows), "v", F.col("label"), block).collect()))
            assert got == want and len(got) > 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_candidates_lose_nothing_and_leave_much_out():
    rng = np.random.default_rng(1)
    y = np.round((np.eye(10)[rng.integers(0, 10, 2000)] * 3 + rng.normal(0, 0.3, (2000, 10))) * 256).astype(np.int64)
    b = H.Bucket(pd.DataFrame({"row": range(2000), "vec_id": range(2000), "label": 0, "y": list(y)}), 10, True)
    left = []
    for i in range(0, 2000, 40):
        scores = y @ y[i]
        for least in (int(np.sort(scores)[-10]), int(np.sort(scores)[-300]), 1, 0, -1000, int(scores.min())):
            c = b.candidates(y[i].astype(float), float(np.linalg.norm(y[i])), least)
            assert c is None or set(np.flatnonzero(scores >= least)) <= set(c)
        left.append(len(b.candidates(y[i].astype(float), float(np.linalg.norm(y[i])), int(np.sort(scores)[-10]))))
    assert np.mean(left) < 300
    assert len(b.candidates(y[0].astype(float), float(np.linalg.norm(y[0])), 10**9)) == 0  # too short
    assert b.candidates(np.zeros(10), 0.0, 0) is None and len(b.candidates(np.zeros(10), 0.0, 1)) == 0


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql(H.SQL).fetchall())
    got = H.query(spark, sf)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.5, 0.5]), (2, 2, [0.4, 1.0]), (3, 2, [0.4, 1.0]), (2, 2, [0.4, 1.0]), (None, 2, [0.4, 1.0]), (4, None, [0.4, 1.0]), (5, 2, None), (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]), (8, 2, [None, 1.0]), (9, 2, [0.3]), (10, 2, [])]
    rows += [(100, 3, [0.0, 0.0]), (101, 3, [1.0, 1.0]), (200, 4, [-1.0, -1.0]), (201, 4, [1.0, 0.5])]
    df = table(spark, rows).withColumns({"row": F.lit("x"), "Length": F.lit(1), "search": F.lit(2)})
    assert sorted(map(tuple, H.mined(df, "v", F.col("label")).collect())) == brute(rows)
    assert [r for r in brute(rows) if r[0] == 100][0][:2] == (100, 101)  # scores of 0: all other labels' rows of score 0
    for none in (df.limit(0), df.filter("vec_id = 1"), df.filter("vec_id = 0")):
        assert H.mined(none, "v", F.col("label")).count() == 0
    large = [(i, i % 2, [float(i) * 1e4, 3e5]) for i in range(0, 400, 20)]  # beyond doubles' whole numbers
    assert sorted(map(tuple, H.mined(table(spark, large), "v", F.col("label")).collect())) == brute(large)
    with pytest.raises(ValueError, match="64 bits"):
        H.mined(table(spark, [(0, 1, [1e12])]), "v", F.col("label"))
