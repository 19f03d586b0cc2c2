import hashlib
import random

import numpy as np

from reachspark.llm import decontaminate as D
from reachspark.llm import word_hashes as W


def brute(docs, items, width=10):
    """doc -> (n_words, n_hit, n_items, sha) by trying every window at every place."""
    out = {}
    words = {i: D.tokens(t) for i, t in items}
    for d, text in docs:
        w = D.tokens(text)
        hit, found = set(), set()
        for i, item in words.items():
            size = min(width, len(item))
            wins = {tuple(item[k : k + size]) for k in range(len(item) - size + 1)} if item else set()
            for p in range(len(w) - size + 1):
                if item and tuple(w[p : p + size]) in wins:
                    hit.update(range(p, p + size))
                    found.add(i)
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
    return out


DOCS = [(1, None), (2, ""), (3, "a b c d e f g h i j k"), (4, "x A B. c, d e f g h i j y"), (5, "Hello hello HELLO world"), (6, "été l'été a"), (7, "c d e " * 300), (8, "a b c d e f g h i j " * 3)]
ITEMS = [(1, "a b c d e f g h i j k l"), (2, "hello world"), (3, None), (4, "..."), (10, "b c d e f g h i j k"), (11, "Été"), (2, "hello world"), (12, "c d e c d e c d e c d e")]


def rows(spark, docs, items, **how):
    d = spark.createDataFrame([(str(i), t) for i, t in docs], "d_row string, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {int(r.d_row): (r.n_words, sum(e - s for s, e in zip(r.starts or [], r.ends or [], strict=True)), len(r["items"] or []), D.digest(r["items"] or [])) for r in D.hits(d, b, **how).collect()}


def test_small_cases_match_brute_force(spark):
    assert rows(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_other_paths_give_the_same(spark):
    """Windows too many to broadcast, and a filter that lets nearly all through."""
    assert rows(spark, DOCS, ITEMS, broadcast_bytes=-1) == brute(DOCS, ITEMS)
    assert rows(spark, DOCS, ITEMS, broadcast_bytes=-1, filter_bits=7) == brute(DOCS, ITEMS)


def test_rows_are_kept_apart(spark):
    """Rows that share a doc_id, or have none, stay rows of their own on both paths."""
    docs = [(1, "x a b c d e f g h i j"), (1, "hello world and more"), (1, "hello world and more"), (None, "c d e " * 9), (None, None), (None, "q hello world")]
    d = spark.createDataFrame([(None if i is None else str(i), t) for i, t in docs], "d_row string, text string")
    b = spark.createDataFrame([*ITEMS, (None, "and more")], "item_id long, text string")
    got = {}
    for most in (10**6, -1):
        got[most] = sorted(((r.d_row, r.n_words, tuple(r.starts), tuple(r.ends), tuple(r["items"])) for r in D.hits(d, b, broadcast_bytes=most).collect()), key=str)
    assert got[-1] == got[10**6] and len(got[-1]) == len(docs)
    assert (None, 3, (1,), (3,), (2,)) in got[-1] and got[-1].count(("1", 4, (0,), (4,), (-(2**63), 2))) == 2


def test_long_words_and_texts(spark, monkeypatch):
    """Sums and parts are cut at words; a word longer than either is hashed whole."""
    monkeypatch.setattr(W, "SUM_BYTES", 50)
    rng = random.Random(2)
    texts = [" ".join("ab"[rng.randint(0, 1)] * rng.choice([1, 2, 3, 200]) for _ in range(rng.randint(0, 60))) for _ in range(20)]
    w = W.Words([*texts, None])
    words = [t for x in texts for t in D.tokens(x)]
    assert np.diff(w.first).tolist() == [len(D.tokens(t)) for t in [*texts, None]]
    assert len({(t, h) for t, h in zip(words, w.hash.tolist(), strict=True)}) == len(set(words)) == len(set(w.hash.tolist()))
    assert [len(w.runs(3)[0])] == [sum(max(0, len(D.tokens(t)) - 2) for t in texts)]


def test_no_items(spark):
    assert rows(spark, DOCS, []) == brute(DOCS, [])


def test_query_matches_brute_force(spark, sf):
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in D.query(spark, sf).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got == brute(docs, items)
    assert any(v[1] for v in got.values())


def test_clean_keeps_columns_and_other_rows(spark):
    df = spark.createDataFrame([(i, t, 7, 8, 9) for i, t in [*DOCS, DOCS[3]]], "doc_id long, text string, d_row int, D_KEY int, d_all int")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = D.clean(df, b)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, v in brute(DOCS, ITEMS).items() if not v[1])
