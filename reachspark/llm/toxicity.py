"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A document is a bag of sentences. Each sentence has a probability of being toxic from a linear model of its words, and the document's
score is their noisy-or, 1 - prod(1 - p): one offending sentence is enough, and a clean document needs all its sentences clean. The model is
trained from document labels alone, so what it learns about sentences tells where a document offends (`offending`).

A sentence's features are its distinct words and their beginnings of 3 to 8 characters, lower-cased; so a word's share of a sentence's
score is one number, looked up for each word. Of all features those count that toxic documents hold more often than chance allows (G
statistic of LEAST_G or more; Spark counts the documents of each). Their weights minimise the documents' log loss with a penalty on the
squares, by limited-memory quasi-Newton steps on the driver; loss and gradient of each step are sums of Spark tasks over the sample.

Bounds: a model is fitted to about `sample` labelled documents at most (SAMPLE), drawn by a hash, and has FEATURES features at most, those
of the greatest G. All texts are scored, from end to end.

Defined cases: a null or empty text, or one without a word, has no sentence and score 0. A sentence ends at . ! ? or a line's end, and after
SENTENCE words at the latest; a word is a run of letters and digits, of WORD characters at the latest. Labels: null `toxic` doesn't count,
of several labels of a doc_id the highest holds, rows without doc_id have none. With no toxic or no clean labelled document nothing is
learnt and every score is 0 or 1. Repeated rows are scored alike. Columns of docs stay, those named as results give way.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspark.llm.common import put, read, stored

#: The bound on the labelled documents that a model is fitted to, about.
SAMPLE = 12_000
#: The most features, how much more frequent in toxic documents they are, and the beginnings of words that are features beside the word.
FEATURES, LEAST_G, BEGINNINGS = 50_000, 11.0, (3, 4, 5, 6, 7, 8)
#: Words of a sentence and characters of a word, at most; what is longer is cut into several.
SENTENCE, WORD = 40, 40
PENALTY, STEPS = 0.1, 60
#: The score from which on a document counts as toxic.
TOXIC = 0.3
#: Tasks that work on the sample, and documents of a block of it.
PARTS, BLOCK = 12, 250
#: Words whose number a task remembers.
REMEMBERED = 400_000

ENDS, WORDS = re.compile(r"[^.!?\n]+"), re.compile(r"[^\W_]{1,%d}" % WORD)


def features(word: str) -> list[int]:
    """The numbers (32 bits) of a word's features."""
    w = f"<{word.lower()}>"
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in {w, *(w[:n] for n in BEGINNINGS if len(w) > n)}]


def sentences(text: str | None) -> Iterator[list[str]]:
    """The words of each sentence."""
    for part in ENDS.findall(text or ""):
        words = WORDS.findall(part)
        for i in range(0, len(words), SENTENCE):
            yield words[i : i + SENTENCE]


def spans(text: str | None) -> list[tuple[int, int]]:
    """Where each sentence with a word starts and ends, from its first word to its last."""
    out = []
    for part in ENDS.finditer(text or ""):
        words = [m.span() for m in WORDS.finditer(text, part.start(), part.end())]
        out += [(words[i][0], words[min(i + SENTENCE, len(words)) - 1][1]) for i in range(0, len(words), SENTENCE)]
    return out


class Model:
    """Weights of features and a sentence's level."""

    def __init__(self, weights: dict[int, float], level: float):
        self.weights, self.level = weights, level
        self.shares: dict[str, float] = {}

    def share(self, word: str) -> float:
        found = self.shares.get(word)
        if found is None:
            if len(self.shares) >= REMEMBERED:
                self.shares.clear()
            found = self.shares[word] = sum(self.weights.get(x, 0.0) for x in features(word))
        return found

    def doubts(self, text: str | None) -> np.ndarray:
        """-ln(1 - p) for each sentence."""
        levels = [sum(map(self.share, set(words))) for words in sentences(text)]
        return np.logaddexp(0, np.array(levels) + self.level) if levels else np.zeros(0)


# Training


class Block:
    """Documents as arrays: words of sentences, features of words, by their places among the model's. Words without any are left out."""

    def __init__(self, texts: list[str | None], toxic: list[int], places: dict[int, int]):
        number: dict[str, int | None] = {}
        of_words: list[list[int]] = []
        rows, cols, docs = [], [], []
        for d, text in enumerate(texts):
            for words in sentences(text):
                for w in set(words):
                    if w not in number:
                        own = [places[x] for x in features(w) if x in places]
                        number[w] = len(of_words) if own else None
                        of_words += [own] if own else []
                    if number[w] is not None:
                        rows.append(len(docs))
                        cols.append(number[w])
                docs.append(d)
        self.word = np.repeat(np.arange(len(of_words), dtype=np.int32), [len(x) for x in of_words])
        self.feature = np.array([i for x in of_words for i in x], dtype=np.int32)
        self.row, self.col, self.doc = (np.array(x, dtype=np.int32) for x in (rows, cols, docs))
        self.toxic = np.array(toxic, dtype=np.int32)

    ARRAYS = ("word", "feature", "row", "col", "doc", "toxic")

    def packed(self) -> list[bytes]:
        return [getattr(self, a).tobytes() for a in self.ARRAYS]

    @classmethod
    def unpacked(cls, parts) -> Block:
        self = cls.__new__(cls)
        for a, b in zip(cls.ARRAYS, parts, strict=True):
            setattr(self, a, np.frombuffer(b, dtype=np.int32))
        return self

    def slope(self, v: np.ndarray) -> tuple[float, np.ndarray]:
        """Log loss of the documents and its gradient at weights and level v."""
        n_words = int(self.word[-1]) + 1 if len(self.word) else 0
        shares = np.bincount(self.word, v[self.feature], n_words)
        levels = v[-1] + np.bincount(self.row, shares[self.col], len(self.doc))
        doubt = np.maximum(np.bincount(self.doc, np.logaddexp(0, levels), len(self.toxic)), 1e-12)
        toxic = self.toxic == 1
        odds = np.where(toxic, -np.exp(-doubt) / -np.expm1(-doubt), 1.0)
        at = odds[self.doc] / (1 + np.exp(-levels))
        by_word = np.bincount(self.col, at[self.row], n_words)
        out = np.bincount(self.feature, by_word[self.word], len(v)).astype(float)
        out[-1] += at.sum()
        return float(np.where(toxic, -np.log(-np.expm1(-doubt)), doubt).sum()), out


def least(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, kept: int = 8) -> np.ndarray:
    """A point where f (value, gradient) is least nearby: quasi-Newton steps from the last changes, each shortened until it helps."""
    now, slope = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        to, shares = slope.copy(), []
        for s, y in reversed(moves):
            shares.append((s @ to) / (s @ y))
            to -= shares[-1] * y
        to *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (s, y), a in zip(moves, reversed(shares), strict=True):
            to += (a - (y @ to) / (s @ y)) * s
        for cut in 3.0 ** -np.arange(9):
            new, new_slope = f(x - cut * to)
            if new <= now - 1e-4 * cut * (slope @ to):
                break
        else:
            break
        move = (-cut * to, new_slope - slope)
        if move[0] @ move[1] > 1e-10:
            moves = [*moves, move][-kept:]
        x, done = x + move[0], now - new < 1e-4 * abs(now)
        now, slope = new, new_slope
        if done:
            break
    return x


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of a sample of the labelled documents, about `sample` of them."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").cast("int").alias("l_toxic"))
    known = stored(known, "toxic-labels")
    chance = lambda *c: F.pmod(F.xxhash64(*c, F.lit("toxic")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = known.filter(chance("l_id") < sample / max(known.count(), 1))  # about `sample` rows, so it may be broadcast
    found = stored(docs.join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).select("text", F.col("l_toxic").alias("toxic"), F.monotonically_increasing_id().alias("at")), "toxic-sample")
    n = found.count()  # ids that many documents share give more rows than ids
    return found.filter(chance("at") < sample / n).drop("at") if n > 2 * sample else found.drop("at")


def telling(rows: DataFrame, n_toxic: int, n_clean: int) -> list[int]:
    """The features that toxic documents of rows (text, toxic) hold more often than chance allows."""

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for toxic, texts in b.groupby("toxic")["text"]:
                count: Counter[int] = Counter()
                for text in texts:
                    count.update({x for w in set(WORDS.findall(text or "")) for x in features(w)})
                yield pd.DataFrame({"feature": list(count), "toxic": toxic, "docs": list(count.values())})

    seen = rows.mapInPandas(hold, "feature long, toxic int, docs long").groupBy("feature").agg(*(F.coalesce(F.sum(F.when(F.col("toxic") == t, F.col("docs"))), F.lit(0)).cast("double").alias(c) for c, t in (("a", 1), ("b", 0))))
    n, with_it = n_toxic + n_clean, F.col("a") + F.col("b")
    part = lambda found, usual: F.when(found > 0, found * F.log(found / usual)).otherwise(0.0)
    g = 2 * sum((part(held, with_it * m / n) + part(m - held, (n - with_it) * m / n) for held, m in ((F.col("a"), n_toxic), (F.col("b"), n_clean))), F.lit(0.0))
    top = seen.filter(F.col("a") * n > with_it * n_toxic).withColumn("g", g).filter(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "feature").limit(FEATURES)
    return [r.feature for r in top.select("feature").collect()]


def blocks(rows: DataFrame, found: list[int]) -> DataFrame:
    """The sample as packed Blocks of BLOCK documents."""
    places = {x: i for i, x in enumerate(found)}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [b.iloc[i : i + BLOCK] for i in range(0, len(b), BLOCK)]
            yield pd.DataFrame([Block(x["text"].tolist(), x["toxic"].tolist(), places).packed() for x in cut], columns=Block.ARRAYS)

    return stored(rows.repartition(PARTS).mapInPandas(pack, ", ".join(f"{a} binary" for a in Block.ARRAYS)), "toxic-blocks")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic)."""
    rows = stored(labelled(docs, labels, sample).withColumn("toxic", (F.col("toxic") > 0).cast("int")).repartition(PARTS), "toxic-rows")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    if len(n) < 2:
        return Model({}, 1e3 if n.get(1) else -1e3)
    found = telling(rows, n[1], n[0])
    packed = blocks(rows, found)

    def f(v: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loss, total = 0.0, np.zeros(len(v))
            for b in batches:
                for parts in b.itertuples(index=False):
                    own, slope = Block.unpacked(parts).slope(v)
                    loss, total = loss + own, total + slope
            yield pd.DataFrame({"loss": [loss], "slope": [total.tobytes()]})

        parts = packed.coalesce(PARTS).mapInPandas(sums, "loss double, slope binary").collect()  # PARTS gradients at most
        rest = penalty * np.append(v[:-1], 0.0)
        return sum(p.loss for p in parts) + v @ rest / 2, sum(np.frombuffer(p.slope) for p in parts) + rest

    v = least(f, np.append(np.zeros(len(found)), -5.0), steps)
    return Model(dict(zip(found, v.tolist(), strict=False)), float(v[-1]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, n_sentences, and offending_start and offending_end of the sentence that offends most (null without one)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    @F.pandas_udf("score double, n long, s long, e long")
    def look(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            doubts = held.value.doubts(text)
            at = spans(text)[int(np.argmax(doubts))] if len(doubts) else (None, None)
            out.append((float(-np.expm1(-doubts.sum())), len(doubts), *at))
        return pd.DataFrame(out, columns=["score", "n", "s", "e"]).astype({"s": "Int64", "e": "Int64"})

    df = put(docs, x_toxic=look("text"))
    return put(df, score=F.col("x_toxic.score"), n_sentences=F.col("x_toxic.n"), offending_start=F.col("x_toxic.s"), offending_end=F.col("x_toxic.e")).drop("x_toxic")


def offending(docs: DataFrame, model: Model, least: float = TOXIC) -> DataFrame:
    """docs with a row for each sentence whose own probability is `least` or more: sentence (0-based), sentence_start, sentence_end (code points),
    sentence_score, sentence_text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<n long, s long, e long, p double>>")
    def look(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            p = -np.expm1(-held.value.doubts(text))
            at = spans(text) if (p >= least).any() else []
            out.append([(int(i), *at[i], float(p[i])) for i in np.flatnonzero(p >= least)])
        return pd.Series(out)

    df = put(docs, x_found=F.explode(look("text")))
    cut = F.substring("text", (F.col("x_found.s") + 1).cast("int"), (F.col("x_found.e") - F.col("x_found.s")).cast("int"))
    return put(df, sentence=F.col("x_found.n"), sentence_start=F.col("x_found.s"), sentence_end=F.col("x_found.e"), sentence_score=F.col("x_found.p"), sentence_text=cut).drop("x_found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs, read(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", "toxic"))
    out = scored(docs.withColumn("held_out", held_out()), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "n_sentences", "offending_start", "offending_end")
