import zlib

import numpy as np
import pytest

from reachspark.llm import toxicity as T


def test_sentences_and_spans_go_together():
    for text in [None, "", " .. !", "One two. Three!\nfour_five", "x" * 95, " ".join(["w"] * 95) + ". End", "Ärger über 日本. İstanbul"]:
        words, at = list(T.sentences(text)), T.spans(text)
        assert len(words) == len(at)
        assert all(text[s:e].startswith(w[0]) and text[s:e].endswith(w[-1]) for w, (s, e) in zip(words, at, strict=True))
    assert [len(w) for w in T.sentences(" ".join(["w"] * 95))] == [40, 40, 15] and [len(x) for x in next(T.sentences("x" * 95))] == [40, 40, 15]


def test_slope_is_the_gradient():
    texts = ["good words here. bad idiot", "fine text. more text", None, "idiot"]
    places = {x: i for i, x in enumerate(sorted({x for t in texts for words in T.sentences(t) for w in words if w != "more" for x in T.features(w)}))}
    b = T.Block(texts, [1, 0, 1, 0], places)
    v = np.random.default_rng(0).normal(0, 0.5, len(places) + 1)
    loss, slope = T.Block.unpacked(b.packed()).slope(v)
    # the loss by its definition, sentence by sentence
    by_hand = 0.0
    for text, toxic in zip(texts, [1, 0, 1, 0], strict=True):
        miss = 1.0
        for words in T.sentences(text):
            z = v[-1] + sum(v[places[i]] for w in set(words) for i in T.features(w) if i in places)
            miss *= 1 - 1 / (1 + np.exp(-z))
        by_hand -= np.log(max(1 - miss, 1e-12)) if toxic else np.log(miss)
    assert loss == pytest.approx(by_hand, rel=1e-9)
    for i in [*(places[x] for w in ("idiot", "text") for x in T.features(w)[:2]), len(v) - 1]:
        e = np.zeros(len(v))
        e[i] = 1e-5
        assert slope[i] == pytest.approx((b.slope(v + e)[0] - b.slope(v - e)[0]) / 2e-5, rel=1e-4, abs=1e-8)


def planted(spark, n=240):
    rng = np.random.default_rng(1)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(vocabulary, 8)) for _ in range(int(rng.integers(1, 9)))]
        toxic = int(i % 3 == 0)
        if toxic:
            lines[int(rng.integers(len(lines)))] += " vile" + str(rng.choice(["", "ness", "st"]))
        rows.append((i, ". ".join(lines) + ".", toxic))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_learns_sentences_from_documents(spark):
    rows, df = planted(spark)
    train = df.filter("doc_id < 180")
    model = T.train(train, train.select("doc_id", "toxic"), penalty=0.1)
    got = {r.doc_id: r for r in T.scored(df.drop("toxic"), model).collect()}
    held = [r for r in rows if r[0] >= 180]
    assert sum((got[i].score >= T.TOXIC) == bool(t) for i, _, t in held) >= 0.95 * len(held)
    found = T.offending(df.filter("doc_id >= 180"), model).collect()
    assert len(found) >= 0.9 * sum(t for *_, t in held) and all("vile" in r.sentence_text and r.text[r.sentence_start : r.sentence_end] == r.sentence_text for r in found)
    assert all("vile" in r.text[r.offending_start : r.offending_end] for r in got.values() if r.score >= T.TOXIC)
    # noisy-or by hand
    for i, text, _ in rows[:20]:
        miss = np.prod([1 / (1 + np.exp(model.level + sum(model.weights.get(j, 0) for w in set(words) for j in T.features(w)))) for words in T.sentences(text)])
        assert got[i].score == pytest.approx(1 - miss, abs=1e-9)


def test_edge_cases(spark):
    _, df = planted(spark, 60)
    model = T.train(df, df.select("doc_id", "toxic"))
    long = "fol gem. " * 200_000 + "vileness"
    rows = [(1, None, 5.0), (2, "", 5.0), (3, " ..!? ", 5.0), (4, long, 5.0), (4, long, 5.0), (None, "fol", 5.0), (5, "a" * 100_000, 5.0)]
    out = T.scored(spark.createDataFrame(rows, "doc_id long, text string, Score double"), model)
    assert out.columns == ["doc_id", "text", "score", "n_sentences", "offending_start", "offending_end"]
    got = out.collect()
    assert [r.score for r in got if r.doc_id in (1, 2, 3)] == [0, 0, 0] and all(0 <= r.score <= 1 for r in got)
    assert [(r.n_sentences, r.offending_start, r.offending_end) for r in got if r.doc_id == 4] == [(200_001, 1_800_000, 1_800_008)] * 2
    none = spark.createDataFrame([], "doc_id long, text string")
    assert T.scored(none, model).count() == 0 and T.offending(none, model).count() == 0
    # nothing to learn from: no label, one class, null labels
    assert T.train(df, df.select("doc_id", "toxic").limit(0)).doubts("x y")[0] == 0
    assert T.train(df, df.filter("toxic = 0").select("doc_id", "toxic")).doubts("x y")[0] == 0
    nulls = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    assert T.labelled(df, nulls).collect() == [tuple(r) for r in df.filter("doc_id = 2").selectExpr("text", "1").collect()]


def test_sample_is_bounded_where_ids_are_shared(spark):
    df = spark.range(4000).selectExpr("7L as doc_id", "concat('word ', id) as text")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, toxic int")
    assert 50 < T.labelled(df, labels, 100).count() < 170


def test_held_out_documents(spark):
    """Labels of held-out documents aren't seen; with few labelled documents most toxic ones are still found."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in T.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in got.values())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [got[i] for i, t in labels.items() if t == 0 and got[i].held_out]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    english = {d.doc_id for d in docs if d.lang == "en"}
    toxic = [got[i] for i, t in labels.items() if t == 1 and got[i].held_out and i in english]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
