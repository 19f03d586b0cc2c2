"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (one to three characters of a lower-cased text, words
padded with a blank, anything but letters cut away). A document gets the language whose profile is nearest to its own
by out-of-place distance: for each of its n-grams the difference in rank, or the greatest difference where the
profile lacks it. Profiles are learnt from labelled documents: at most about `per_language` of them for each language,
drawn by a hash of doc_id and text; counts of their n-grams are summed by Spark. The row of a language's least hash is always drawn, so every
labelled language has a profile.

Defined cases: a null text, or one without a letter, gives `und` and score 0. A tie goes to the language first in code
point order. With no labelled document every text gives `und`. Repeated rows are each predicted alike; extra columns
stay. Rows may share a doc_id or have none; copies of one id and text are drawn together or not at all. A row without doc_id isn't held out. Score is 1 - distance / greatest possible distance.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachspark.llm.common import put, read, stored

PROFILE = 300
LONGEST = 3
#: The bound on the labelled sample: documents of a language that profiles are learnt from, about.
PER_LANGUAGE = 2000
#: Languages whose counts are broadcast; with more the sample's join shuffles.
BROADCAST_LANGUAGES = 10_000
BITS = 21  # a code point fits


def letter_table() -> np.ndarray:
    """For each code point: itself in lower case if it is a letter, else 0."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_table: list[np.ndarray] = []


def letters(text: str | None) -> np.ndarray:
    """Code points of the letters, with one blank (1) around and between words; empty if there is no letter."""
    if not _table:
        _table.append(letter_table())
    points = _table[0][np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    points = np.concatenate([[0], points, [0]]).astype(np.uint64)
    keep = points > 0
    keep[1:] |= points[:-1] > 0  # the first blank after a word
    points = points[keep]
    points[points == 0] = 1
    return np.concatenate([np.ones(1, np.uint64), points]) if len(points) else points


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as numbers, in order, and how often each occurs. A lone blank is not one."""
    p = letters(text)
    if not len(p):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    runs = [p[p > 1]]
    code = p
    for _ in range(1, LONGEST):
        code = (code[:-1] << np.uint64(BITS)) | p[len(p) - len(code) + 1 :]
        runs.append(code)
    every = np.sort(np.concatenate(runs))
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.diff(np.concatenate([first, [len(every)]]))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent; of equal counts, the smaller number."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")][:size]


def profiles(labelled: DataFrame, size: int = PROFILE, per_language: int = PER_LANGUAGE) -> dict[str, list[int]]:
    """Language -> its n-grams by rank, from rows with doc_id, text, lang. One short list for each language comes back."""
    labelled = labelled.filter("lang is not null and text is not null")
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    n = stored(labelled.groupBy(F.col("lang").alias("p_lang")).agg(F.count("*").alias("p_n"), F.min(share).alias("p_least")), "languages")
    n = n.hint("broadcast" if n.count() <= BROADCAST_LANGUAGES else "merge")
    drawn = share < F.greatest(per_language / F.col("p_n"), F.col("p_least") + F.lit(2.0**-30))
    sample = labelled.join(n, F.col("lang") == F.col("p_lang")).filter(drawn).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                found = [grams(t) for t in texts]
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([c for _, c in found]))
                yield pd.DataFrame({"lang": lang, "gram": codes.astype(np.int64), "n": n.astype(np.int64)})

    sums = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # First the leaders of slices, then of all: no task sorts all n-grams of a language
    sliced = Window.partitionBy("lang", F.pmod("gram", F.lit(64))).orderBy(F.desc("n"), "gram")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("r", F.row_number().over(sliced)).filter(F.col("r") <= size).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= size)
    out: dict[str, list[int]] = {}
    for row in stored(top.select("lang", "gram", "r"), "language-profiles").orderBy("lang", "r").toLocalIterator():
        out.setdefault(row.lang, []).append(row.gram)
    return out


class Ranks:
    """Profiles as a sorted array of n-grams and a table of ranks, a row for each language."""

    def __init__(self, lists: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(lists), size
        self.grams = np.unique(np.array([g for x in lists.values() for g in x], dtype=np.uint64))
        self.rank = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.grams, np.array(lists[lang], dtype=np.uint64))] = np.arange(len(lists[lang]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        own = ranked(*grams(text), self.size)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == own[known]
        at[~known] = len(self.grams)
        rank = self.rank[:, at]
        away = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.size * len(own)))


def predict(docs: DataFrame, lists: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score; only the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(Ranks(lists, size))  # at most `size` n-grams for each language

    @F.pandas_udf("lang string, score double")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.nearest(t) for t in texts], columns=["lang", "score"])

    df = put(docs, p_found=nearest("text"))
    return put(df, lang_pred=F.col("p_found.lang"), score=F.col("p_found.score")).drop("p_found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    lists = profiles(docs.filter(~held_out))
    out = predict(docs.select("doc_id", "text", held_out.alias("held_out")), lists)
    return out.select("doc_id", "held_out", "lang_pred", "score")
