import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from reachspark.llm import language_id as L


def brute_grams(text):
    import unicodedata

    low = "".join(c.lower() if unicodedata.category(c)[0] == "L" and len(c.lower()) == 1 else (c if unicodedata.category(c)[0] == "L" else " ") for c in text or "")
    words = low.split()
    if not words:
        return Counter()
    s = " " + " ".join(words) + " "
    return Counter(g for n in (1, 2, 3) for g in (s[i : i + n] for i in range(len(s) - n + 1)) if g != " ")


def name(code):
    out = ""
    while code:
        c = int(code) & ((1 << L.BITS) - 1)
        out = (" " if c == 1 else chr(c)) + out
        code = int(code) >> L.BITS
    return out


def test_grams_match_brute_force():
    for t in [None, "", "12 !?", "a", "Ab, cd", "Été à l'Ü x", "  a  b--c ", "日本 語", "ß" * 5 + "😀x"]:
        codes, counts = L.grams(t)
        assert {name(c): n for c, n in zip(codes, counts, strict=True)} == dict(brute_grams(t))


def test_ranked_cuts_by_count_then_number():
    codes, counts = np.array([1, 2, 3, 4], np.uint64), np.array([1, 5, 1, 2])
    assert L.ranked(codes, counts, 3).tolist() == [2, 4, 1]


def test_predicts_held_out_documents(spark, sf):
    got = {r.doc_id: r for r in L.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and 0 <= got[d.doc_id].score <= 1 for d in docs)
    held = [d for d in docs if got[d.doc_id].held_out and len(d.text.split()) >= 20]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.9 * len(held)


def test_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "123 ...", None), (5, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = L.predict(df, L.profiles(df.withColumnRenamed("score", "lang")))
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    assert {r.doc_id: r.lang_pred for r in out.collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}
    assert {r.lang_pred for r in L.predict(df, {}).collect()} == {"und"}


def test_query_matches_brute_force(spark, sf):
    """Out-of-place distances by counting and sorting; all labelled documents are in the sample here."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    number = lambda g: sum((1 if c == " " else ord(c)) << L.BITS * (len(g) - 1 - i) for i, c in enumerate(g))
    top = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))[: L.PROFILE]]
    own = {d.doc_id: Counter(brute_grams(d.text)) for d in docs}
    learned = {}
    for d in docs:
        if d.lang is not None and d.text is not None and zlib.crc32(str(d.doc_id).encode()) % 4 != 2:
            learned.setdefault(d.lang, Counter()).update(own[d.doc_id])
    lists = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in learned.items()}
    for r in L.query(spark, sf).collect():
        mine = top(own[r.doc_id])
        far = {lang: sum(abs(ranks[g] - i) if g in ranks else L.PROFILE for i, g in enumerate(mine)) for lang, ranks in lists.items()}
        best = min(sorted(far), key=far.get) if mine else "und"
        assert (r.lang_pred, round(r.score, 9)) == (best, round(1 - far[best] / (L.PROFILE * len(mine)), 9) if mine else 0.0)


def test_every_language_has_a_profile_whatever_the_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang is not null and text is not null")
    langs = {r.lang for r in docs.select("lang").distinct().collect()}
    for doc_id in (F.lit(None).cast("long"), F.lit(7)):
        for most in (20, 1):
            lists = L.profiles(docs.withColumn("doc_id", doc_id), per_language=most)
            assert set(lists) == langs
    copies = spark.createDataFrame([(None, "one and the same", "en")] * 50 + [(None, "der eine", "de")], "doc_id long, text string, lang string")
    assert set(L.profiles(copies, per_language=1)) == {"en", "de"}
