import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from reachspark.llm import induced_sort as I
from reachspark.llm import substring_dedup as D


def brute(docs, width):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(hash(d[p : p + width]) for _, d in data for p in range(len(d) - width + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 1, dtype=int)
        for p in range(len(d) - width + 1):
            if seen[hash(d[p : p + width])] > 1:
                gone[p] += 1
                gone[min(p + width, len(d))] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) > 0))
        out.append((i, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_order_matches_sorting(tmp_path, monkeypatch):
    monkeypatch.setattr(I, "SHORT", 0)
    rng = random.Random(3)
    for k in range(400):
        t = [rng.randint(1, rng.randint(1, 9)) for _ in range(rng.randint(0, 120))] + [0]
        disk = I.Disk(tmp_path, *rng.choice([(3, 2), (20, 7), (10**6, 1 << 18)]))
        assert I.suffix_order(np.array(t), disk, len(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:]), (k, t)


def test_ranges_that_feed_themselves_are_halved(tmp_path, monkeypatch):
    """Many characters in a range, and texts in which each leads to the next in the same range."""
    monkeypatch.setattr(I, "RANGES", 2)
    monkeypatch.setattr(I, "SHORT", 0)
    rng = random.Random(5)
    for k in range(120):
        up = list(range(1, rng.randint(3, 60)))
        t = rng.choice([up, up[::-1], up + up[::-1], up[::-1] * 2, [rng.randint(1, 30) for _ in range(200)]]) * rng.randint(1, 4) + [0]
        assert I.suffix_order(np.array(t), I.Disk(tmp_path, *rng.choice([(5, 3), (10**6, 100)])), len(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:]), (k, t)


def test_short_strings_are_ranked_in_memory():
    rng = random.Random(13)
    for _ in range(200):
        t, depth = [rng.randint(1, 3) for _ in range(rng.randint(0, 90))] + [0], rng.choice([1, 3, 90])
        heads = [t[i : i + depth] for i in I.ranked(np.array(t), depth).tolist()]
        assert heads == sorted(heads) and len(heads) == len(t)


def test_common_prefixes_are_carried(tmp_path, monkeypatch):
    rng = random.Random(8)
    for k in range(300):
        t = [rng.randint(1, rng.randint(1, 3)) for _ in range(rng.randint(1, 90))] + [0]
        monkeypatch.setattr(I, "SHORT", rng.choice([0, 10**6]))
        cap, found = 200, []
        I.descending(np.array([*t, 0])[:-1], cap, I.Disk(tmp_path, *rng.choice([(4, 3), (10**6, 1000)])), lambda s, c: found.extend(zip(s.tolist(), c.tolist(), strict=True)))  # noqa: B023
        alike = lambda a, b: next((i for i in range(cap) if t[a + i : a + i + 1] != t[b + i : b + i + 1]), cap)  # noqa: B023, E731
        order = [s for s, _ in found]
        assert order == sorted(range(len(t)), key=lambda i: t[i:], reverse=True), (k, t)
        assert [c for _, c in found[1:]] == [alike(a, b) for a, b in zip(order, order[1:], strict=False)], (k, t)


def test_repeated_matches_counting():
    rng = random.Random(4)
    for _ in range(300):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        w = rng.randint(1, 8)
        c = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
        assert [x.tolist() for x in I.repeated(texts, w, *rng.choice([(5, 3), (10**6, 50)]))] == [[c[t[i : i + w]] > 1 for i in range(max(0, len(t) - w + 1))] for t in texts]


def test_a_shard_beyond_memory_goes_to_disk(monkeypatch):
    """A shard 40 times as large as what may be held: queues and arrays are files, and the result is the same."""
    rng, spilled = random.Random(7), []
    spill = I.Queue.spill
    monkeypatch.setattr(I.Queue, "spill", lambda q: (spilled.append(q.now), spill(q))[1])
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(900))
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(2000)) + passage[k:] for k in range(40)]
    small = I.repeated(texts, 200, 3000, 1000)
    assert len(spilled) > 20 and all((a == b).all() for a, b in zip(small, I.repeated(texts, 200), strict=True)) and sum(x.sum() for x in small) > 10_000


def test_stretches_meet_and_cover():
    rng = random.Random(5)
    passage = bytes(rng.choice(b"abcdef ") for _ in range(90))
    a, b = (bytes(rng.choice(b"abcdef ") for _ in range(70)) + passage + bytes(rng.choice(b"abcdef ") for _ in range(50)) for _ in "xy")
    one, two = (list(zip(*(x.tolist() for x in D.stretches(d, 40, 12)), strict=True)) for d in (a, b))
    assert sum(n for _, n, *_ in one) == len(a) - 39
    at = lambda s, p: next((k, st) for st, n, k, *_ in s if st <= p < st + n)
    assert all(at(one, 70 + i)[0] == at(two, 70 + i)[0] for i in range(51))


def rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_small_cases(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    p, q = word(60), word(45)
    docs = [(1, word(50) + p + word(20)), (2, p), (3, word(10) + p[5:50] + q + word(9)), (4, q + word(3) + q), (5, None), (6, ""), (7, "ab" * 60), (8, word(200)), (8, p), (9, p + q), (9, p + q), (None, q + word(30)), (10, "x" * 39)]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, h string")
    want = brute(docs, 40)
    assert rows(D.dedup(df, 40, 12)) == want
    assert rows(D.dedup(df, 40, 12, shard_bytes=100)) == want
    assert rows(D.dedup(df, 40, 12, sort_all=True)) == rows(D.dedup(df, 40, 12, shard_bytes=100, sort_all=True)) == want
    assert D.dedup(df.limit(0), 40, 12).count() == 0


def test_hot_anchors_are_split(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, near = word(70), word(12)
    docs = [(i, word(30) + (near[i % 9 :] if i % 2 else "") + passage + word(30)) for i in range(150)]
    strips = [(int(a), int(c), int(k), int(n), 1, t.encode()[s : s + n + 39]) for _, t in docs for s, n, a, c, k in zip(*D.stretches(t.encode(), 40, 12), strict=True)]
    df = spark.createDataFrame(list({x[:4]: x for x in strips}.values()), "anchor long, content long, check long, n long, copies long, data binary")
    assert df.groupBy("anchor").agg(F.sum(F.octet_length("data")).alias("b")).agg(F.max("b")).first()[0] > 5000
    shards, single = D.dealt(df, 40, 12, 2000)
    assert single is not None and max(max(r.b for r in x.groupBy("part").agg(F.sum(F.octet_length("data")).alias("b")).collect()) for x in shards) <= 2000
    rows_df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(D.dedup(rows_df, 40, 12, shard_bytes=2000)) == brute(docs, 40)


def test_query_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows(D.query(spark, sf))
    assert got == brute(docs, 200) and sum(r[2] for r in got) > 0
    assert rows(D.dedup(spark.read.parquet(f"{sf}/documents.parquet"), sort_all=True)) == got


def test_the_sort_alone_tells_what_is_repeated(spark, monkeypatch):
    """With no digest counted as a result (sort_all), a sort that finds nothing leaves all bytes."""
    passage = "one passage that two documents share, longer than any window"
    df = spark.createDataFrame([(i, passage) for i in (1, 2)], "doc_id long, text string")
    assert {r.n_removed for r in D.dedup(df, 40, 12, sort_all=True).collect()} == {len(passage)}
    monkeypatch.setattr(D, "repeated", lambda texts, width: [np.zeros(max(0, len(t) - width + 1), dtype=bool) for t in texts])
    assert {r.n_removed for r in D.dedup(df, 40, 12, sort_all=True).collect()} == {0}
