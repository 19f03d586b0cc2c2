import functools
import math
import random
from collections import Counter

import public_tokenizers as P
import pytest
import regex

from reachspark.llm import token_counts as T

RANKS = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"th": 259, b"the": 260, b" the": 261, b"he": 262}


SCORES = T.zipf(RANKS)


def cut(word, scores):
    """The best segmentation; of equal ones that with the shorter last piece."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        top, begin = -math.inf, 0
        for start in range(end - 1, max(-1, end - 130), -1):  # no piece is longer
            score = scores.get(word[start:end])
            if score is not None and best[start][0] + score > top:
                top, begin = best[start][0] + score, start
        best.append((top, begin))
    out, end = [], len(word)
    while end:
        out.append(word[best[end][1] : end])
        end = best[end][1]
    return out


def brute(word, scores):
    return len(cut(word, scores))


def test_scores():
    assert math.isclose(sum(map(math.exp, SCORES.values())), 1) and SCORES[b"the"] == pytest.approx(-math.log(261) - math.log(sum(1 / (r + 1) for r in range(263))))


def test_pieces_are_counted():
    used, words = {}, sorted([b"abcabc", b"the", b"then"])
    T.Unigram(SCORES).counts(words, used, [2, 3, 5])
    assert used == Counter({p: n for p, n in Counter([p for w, n in zip(words, [2, 3, 5], strict=True) for p in cut(w, SCORES) * n]).items()})


def fitted(texts, ranks, rounds=T.ROUNDS):
    words, scores = Counter(w.encode() for t in texts for w in regex.findall(P.PATTERN, t or "")), T.zipf(ranks)
    for _ in range(rounds):
        seen = Counter()
        for w, n in words.items():
            for p in cut(w, scores):
                seen[p] += n
        total = math.log(sum(seen.values()) + T.LEAST_COUNT * len(ranks))
        scores = {p: math.log(seen[p] + T.LEAST_COUNT) - total for p in ranks}
    return scores


def test_scores_are_fitted_to_all_documents(spark):
    texts = ["the abc the then", "abab bc", None, "", "the abc the then", "é " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    words = T.word_counts(df, P.PATTERN)
    assert T.fitted(words, RANKS) == pytest.approx(fitted(texts, RANKS))
    assert T.fitted(T.word_counts(df.limit(0), P.PATTERN), RANKS) == pytest.approx(fitted([], RANKS))
    counts = {bytes(r.word).decode(): r.n for r in words.collect()}
    for most in (0, 3, 100):
        often = T.frequent(words, SCORES, most)
        assert len(often) <= most and all(n == brute(w.encode(), SCORES) for w, n in often.items())
        assert not often or min(counts[w] for w in often) > max([n for w, n in counts.items() if w not in often], default=0)
    assert [r.n_tokens for r in T.count_tokens(df, SCORES, P.PATTERN, 2, often).collect()] == [r.n_tokens for r in T.count_tokens(df, SCORES, P.PATTERN).collect()]


def test_trie_matches_one_word_at_a_time():
    words = sorted({b"abc", b"abcd", b"ab", b"the", b" the", b" then", b"", b"xyz", b"ab" * 40, "été".encode()})
    assert T.Unigram(SCORES).counts(words) == [brute(w, SCORES) for w in words]


@pytest.mark.parametrize("remembered", [0, 10**6])
def test_rows(spark, remembered):
    rows = [(1, "the abc the", "x"), (2, None, "y"), (3, "", "z"), (4, "the abc the", "x"), (5, "é" * 100 + " ab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = T.count_tokens(df, SCORES, P.PATTERN, remembered)
    assert out.columns == ["doc_id", "text", "n_pretokens", "n_tokens"]
    for r in out.collect():
        words = regex.findall(P.PATTERN, r.text or "")
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(brute(w.encode(), SCORES) for w in words))


def test_query_matches_brute_force(spark, sf):
    ranks = T.read_vocabulary(spark, P.path("byte_bpe_50k.tiktoken"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    scores = T.fitted(T.word_counts(spark.read.parquet(f"{sf}/documents.parquet"), P.PATTERN), ranks)  # see test_scores_are_fitted_to_all_documents
    known = functools.cache(lambda w: brute(w.encode(), scores))
    for r in T.query(spark, sf).collect():
        words = regex.findall(P.PATTERN, docs[r.doc_id] or "")
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(map(known, words)))


def test_stretches_give_the_same_pretokens():
    rng = random.Random(5)
    signs = [" ", " ", "  ", "\n", "\t", "\u00a0", "\u2028", "\x1c", "\x85", "a", "bc", "'s", "'", "7", "é", "日本", "!", "?!", "😀", "\u0301", "\ud800"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(4000)] + [None, " ", "  ", " a", "a ", "a  ", "x" * 100 + " y"]
    for blanks in (True, False):
        c = T.Cutter(P.PATTERN, blanks)
        for t in texts:
            assert [w for x in c.stretches(t) for w in c.pretokens(x)] == regex.findall(P.PATTERN, t or "")


def test_long_stretches_and_other_patterns(spark):
    pattern = r"\s+|[a-z ]+|[^a-z\s]+"  # matches run across blanks
    rows = [(i, t) for i, t in enumerate(["the then " * 3, "ab" * T.SHORT + " the", None, "", "the  ab\n the", "x" * (T.SHORT + 1)] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for regexp, blanks in ((pattern, False), (P.PATTERN, True), (P.PATTERN, False)):
        want = Counter(w for _, t in rows for w in regex.findall(regexp, t or ""))
        assert {bytes(r.word).decode(): r.n for r in T.word_counts(df, regexp, blanks).collect()} == want
        got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in T.count_tokens(df, SCORES, regexp, remembered=1, blanks=blanks).collect()}
        for i, t in rows:
            words = regex.findall(regexp, t or "")
            assert got[i] == (len(words), sum(brute(w.encode(), SCORES) for w in words))
