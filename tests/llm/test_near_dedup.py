import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachspark.llm import near_dedup as N


def brute_bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_similarity(a, b):
    every = set(a) | set(b)
    if {*a.values(), *b.values()} == {1}:
        return len(set(a) & set(b)) / len(every)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in set(a) & set(b))


def brute_classes(docs, least=0.8):
    bags = {i: brute_bag(t) for i, t in docs}
    where, parent = defaultdict(list), {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, b in bags.items():
        for j in {j for s in b for j in where[s]}:
            if root(i) != root(j) and sum((bags[j] & b).values()) > 0.3 * sum(b.values()) and brute_similarity(bags[j], b) >= least:
                parent[max(root(i), root(j))] = min(root(i), root(j))
        for s in b:
            where[s].append(i)
    return {i: root(i) for i in bags}


def hashes(words):
    return np.array([hash(w) & 0x7FFFFFFFFFFFFFFF for w in words], dtype=np.int64)


def test_exact_similarity():
    rng = random.Random(1)
    for _ in range(40):
        a, b = (" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in "xy")
        assert N.similarity(N.bag(hashes(a.split())), N.bag(hashes(b.split()))) == pytest.approx(brute_similarity(brute_bag(a), brute_bag(b)))


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(2)
    a = [rng.choice("abcdefgh") for _ in range(300)]
    b = a[:240] + [rng.choice("abcdefgh") for _ in range(40)] + a[:30]
    bags = [N.bag(hashes(x)) for x in (a, b, ["q"], a)]
    s = N.signatures(bags, 4096)
    assert abs((s[0] == s[1]).mean() - N.similarity(bags[0], bags[1])) < 0.04
    assert (s[0] == s[3]).all() and len(set(s[2].tolist())) == 1


def some(seed, n=60):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, 400)}" for _ in range(n)]


def edited(words, n, seed):
    rng, w = random.Random(seed), list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.random()}"
    return w


def test_classes_match_brute_force(spark):
    base = some(1, 150)
    texts = [" ".join(edited(base, n % 9, n)) for n in range(60)] + [" ".join(some(s)) for s in range(2, 20)] + ["a b", "A  b", "a b c", "", None, None, " ".join(base).upper(), "x y z " * 50, "x y z " * 70, "x y z " * 70 + "q r s t u"]
    docs = [(100 + i * 7 % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (N.PART_ROWS, 4):  # hot keys in parts
        assert {r.doc_id: r.class_id for r in N.classes(df, most=most).collect()} == brute_classes(sorted(docs))


def test_rows_of_hot_keys_meet_once(spark):
    rows = [(k, n) for k in (1, 2, 3) for n in range((0, 1, 7, 30)[k])]
    left, right = N.dealt(spark.createDataFrame(rows, "key long, node long"), "key", 5)
    right = right.withColumnRenamed("node", "other")
    got = sorted((r.key, r.node, r.other) for r in left.join(right, ["key", "part"]).collect())
    assert got == sorted((k, a, b) for k, a in rows for j, b in rows if k == j)
    assert left.filter("key = 3").select("part").distinct().count() > 1


def test_odd_rows(spark):
    text = " ".join(some(5))
    rows = [(1, text, "a"), (1, text, "b"), (2, text, "c"), (None, text, "d"), (None, "other words", "e"), (3, "lone text", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = sorted(((r.doc_id, r.class_id) for r in N.classes(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (None, None), (3, 3)], key=str)
    kept = N.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, None, 3], key=str)
    assert N.classes(df.limit(0)).count() == 0


def test_query_matches_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert {r.doc_id: r.class_id for r in N.query(spark, sf).collect()} == brute_classes(docs)


def test_rows_of_shingles_are_small(spark, monkeypatch):
    """No row that is dealt by shingle holds its whole prefix, and a pair with many common shingles comes once."""
    seen, deal = [], N.dealt
    monkeypatch.setattr(N, "dealt", lambda rows, key, most: (seen.append(rows.columns), deal(rows, key, most))[1])
    base = some(3, 150)
    texts = spark.createDataFrame([(n, " ".join(edited(base, n, n))) for n in range(4)], "node long, text string")
    pairs = sorted((r.a, r.b) for r in N.across(texts.select("node", F.col("node").alias("class")), texts, 0.6).collect())
    assert pairs == sorted(set(pairs)) and (0, 1) in pairs
    assert seen == [["node", "class", "n_bits", "s", "out"]]


def test_unlike_copies_of_one_text_make_few_pairs(spark):
    """Copies of one text with several edits each share rare shingles but most aren't similar: few pairs are made but similar ones, and fewer
    once each copy was compared with the first of its shingles."""
    base = some(4, 150)
    texts = [" ".join(edited(base, 3, 1000 + n)) for n in range(80)] + [" ".join(edited(base, 1, 2000 + n)) for n in range(40)]
    bags = {n: brute_bag(t) for n, t in enumerate(texts)}
    similar = {(a, b) for a in bags for b in bags if a < b and brute_similarity(bags[a], bags[b]) >= 0.8}
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    nodes = df.select("node", F.col("node").alias("class"))
    pairs = {(r.a, r.b) for r in N.across(nodes, df, 0.8).collect()}
    assert similar <= pairs and len(pairs) <= 1.5 * len(similar)
    first = N.verified(N.to_first(nodes, N.sketched(nodes, df, 0.8), 0.8), df, 0.8)
    label = N.components(first)
    left = N.across(nodes.select("node").join(label, "node", "left").select("node", F.coalesce("class", "node").alias("class")), df, 0.8)
    assert left.count() < len(pairs) / 4


def test_sketches_exclude_no_similar_pair(spark):
    """The bound by sketches is never below the similarity, with repeats too."""
    rng = random.Random(6)
    bags = []
    for n in range(60):
        words = edited(some(7 + n % 3, 120), n % 12, n)
        bags.append(N.bag(hashes(words + words[: rng.choice((0, 0, 40, 120))] * rng.randint(1, 3))))
    rows = [(i, w.tolist()) for i, w in enumerate(N.sketches(bags))]
    df = spark.createDataFrame(rows, "i int, w array<long>")
    pairs = df.join(df.selectExpr("i as j", "w as v"), F.col("i") < F.col("j"))
    for least in (0.3, 0.6, 0.8, 0.95):
        kept = {(r.i, r.j) for r in pairs.filter(N.may_be_similar((F.col("w"), F.lit(0.0)), (F.col("v"), F.lit(0.0)), least)).select("i", "j").collect()}
        like = {(i, j) for i in range(60) for j in range(i + 1, 60) if N.similarity(bags[i], bags[j]) >= least}
        assert like <= kept < {(i, j) for i in range(60) for j in range(i + 1, 60)}
