"""Benchmark decontamination: a prefix-filtered join of document words with the windows of benchmark items.

An item's windows are its runs of `width` words (the whole item if it is shorter). A window lies in a document only if
all its shingles (three words, or fewer in a shorter window) do, so one of them suffices to find candidates: the one
that is rarest over all documents, the window's prefix. Both tables meet at that shingle's hash; the shingle's place in the window
and the ends of the document bound where the window must start; there the words themselves are compared.

Documents are read twice. The first pass counts the benchmark's shingles, the second hands out the places of prefixes with the
words around them. What isn't in the benchmark stays where it is: both passes look shingles up in a broadcast bit filter, whose size
is fixed (`filter_bits`) and whose false positives the join drops. The windows meet the places in a broadcast join while
they are few, and beyond that in a shuffled one in which places are dealt into `SALTS` parts, so a hot passage is no one task's work.

Defined cases: null and empty texts have no words: such documents are clean, such items have no window. Every row of docs
gives a row, whatever its d_row: rows are told apart by a number that is stored. Repeated items, also under one id, count once for
each id. A null item_id is left out of items_sha256 but its windows hit and it counts as one item.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspark.llm.common import put, read, stored
from reachspark.llm.word_hashes import Words, filter_of, parts

WIDTH, SHINGLE = 10, 3
#: Bits of a filter as a power of two: 2^25 are 4 MB.
FILTER_BITS = 25
#: Bytes of windows up to which they are broadcast, and parts of a shuffled join's keys beyond.
BROADCAST_BYTES, SALTS = 16_000_000, 16
#: Stands for a null item_id in a task.
NO_ID = -(2**63)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(text: str | None) -> list[bytes]:
    """Words in lower-case ASCII letters, digits, and whatever is not ASCII."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def windows(benchmark: DataFrame, width: int, shingle: int) -> DataFrame:
    """(item_id, words, size, shingles) of every window of every item; shingles are hashes, in the window's order."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, text in zip(b["item_id"], b["text"], strict=True):
                w = Words([text])
                n = len(w.hash)
                if not n:
                    continue
                size, runs = min(width, n), w.runs(min(shingle, width, n))[1].view(np.int64)
                many = size - min(shingle, size) + 1
                for a in range(0, n - size + 1, 5000):
                    at = range(a, min(a + 5000, n - size + 1))
                    yield pd.DataFrame({"item_id": item, "words": [w.joined(i, i + size) for i in at], "size": size, "shingles": [runs[i : i + many] for i in at]})

    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), "text").dropDuplicates()
    return items.mapInPandas(cut, "item_id long, words string, size int, shingles array<long>")


def frequencies(docs: DataFrame, wanted, sizes: list[int]) -> DataFrame:
    """(s, n): how often the shingles that the filter lets through are in the documents. Batches add up before they hand on."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in parts(b):
                w = Words(part["text"].tolist())
                found = [code[wanted.value.has(code)] for _, code in map(w.runs, sizes)]
                s, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"s": s.view(np.int64), "n": n})

    return docs.select("text").mapInPandas(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))


def places(docs: DataFrame, wanted, sizes: list[int], reach: int) -> DataFrame:
    """docs' d_row with n_words and d_places: the shingles that the filter lets through, where they are, and the words around."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in parts(b):
                w = Words(part["text"].tolist())
                found: list[list[dict]] = [[] for _ in range(len(part))]
                for size in sizes:
                    place, code = w.runs(size)
                    hit = np.flatnonzero(wanted.value.has(code))
                    for p, s in zip(place[hit].tolist(), code[hit].view(np.int64).tolist(), strict=True):
                        t = int(w.text[p])
                        first, last = max(int(w.first[t]), p - reach + size), min(int(w.first[t + 1]), p + reach)
                        found[t].append({"s": s, "at": p - int(w.first[t]), "lead": p - first, "around": w.joined(first, last)})
                yield pd.DataFrame({"d_row": part["d_row"], "n_words": np.diff(w.first), "d_places": found})

    found = docs.select(F.col("d_row").cast("string").alias("d_row"), "text").mapInPandas(find, "d_row string, n_words long, d_places array<struct<s: long, at: long, lead: int, around: string>>")
    return stored(found.withColumn("d_number", F.monotonically_increasing_id()), "places")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, filter_bits: int = FILTER_BITS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For each row of docs (d_row, text): d_row, n_words, the hit word ranges (starts, ends), and the items that occur (items)."""
    context = docs.sparkSession.sparkContext
    every = stored(windows(benchmark, width, shingle), "windows")
    sizes = sorted(r.n for r in every.select(F.least("size", F.lit(shingle)).alias("n")).distinct().collect())  # shingle values at most
    one = every.groupBy("words").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    of = one.select("words", "size", F.posexplode("shingles").alias("offset", "s"))
    if sizes:
        often = frequencies(docs, context.broadcast(filter_of(of, "s", filter_bits)), sizes)
        often = stored(often.join(of.select("s").distinct(), "s", "left_semi"), "shingle-counts")
        least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "s"))
        one = of.join(often, "s", "left").groupBy("words", "size").agg(least.alias("p")).select("words", "size", "p.offset", "p.s", "p.n")
    else:
        one = of.withColumn("n", F.lit(0).cast("long"))
    one = stored(one.filter("n > 0").drop("n"), "prefixes")  # a window whose rarest shingle is in no document hits none
    base = places(docs, context.broadcast(filter_of(one, "s", filter_bits)), sizes, width)
    bytes_ = F.coalesce(F.sum(F.octet_length("words") + 60), F.lit(0))
    small = every.agg(bytes_).first()[0] <= broadcast_bytes  # one also has no more than this
    at = base.select("d_number", F.explode("d_places").alias("x")).select("d_number", "x.*")
    if small:
        both = at.join(F.broadcast(one), "s")
    else:
        dealt = one.withColumn("d_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        both = at.withColumn("d_salt", F.pmod(F.xxhash64("d_number"), F.lit(SALTS)).cast("int")).join(dealt.hint("merge"), ["s", "d_salt"])
    begin = F.col("lead") - F.col("offset")
    same = F.array_join(F.slice(F.split("around", " "), F.greatest(begin, F.lit(0)) + 1, F.col("size")), " ") == F.col("words")
    start = F.col("at") - F.col("offset")
    found = stored(both.filter((begin >= 0) & same).select("d_number", start.alias("start"), (start + F.col("size")).alias("stop"), "words"), "hits")
    items = every.select("words", "item_id").distinct()
    which = found.select("d_number", "words").distinct()
    which = which.join(F.broadcast(items), "words") if small else which.join(items.hint("merge"), "words")
    which = which.select("d_number", "item_id").distinct().groupBy("d_number").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    ranges = found.groupBy("d_number").agg(F.collect_set(F.struct("start", "stop")).alias("r")).mapInPandas(merged, "d_number long, starts array<long>, ends array<long>")
    out = base.select("d_row", "n_words", "d_number").join(ranges, "d_number", "left").join(which, "d_number", "left")
    none = F.array().cast("array<long>")
    return out.select("d_row", "n_words", *(F.coalesce(c, none).alias(c) for c in ("starts", "ends", "items")))


def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges r (start, stop) of each row as the maximal ranges that they cover."""
    for b in batches:
        rows = []
        for row, ranges in zip(b["d_number"], b["r"], strict=True):
            out: list[list[int]] = []
            for a, z in sorted((x["start"], x["stop"]) for x in ranges):
                if out and a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], z)
                else:
                    out.append([a, z])
            rows.append((row, [x[0] for x in out], [x[1] for x in out]))
        yield pd.DataFrame(rows, columns=["d_number", "starts", "ends"])


def digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items if i != NO_ID)).encode()).hexdigest()


def clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents without a hit word, with the input's own columns, whatever their names.

    Rows are matched by the digest of the text: texts that are equal have equal hits, so repeated rows go or stay together."""
    key = F.md5(F.coalesce("text", F.lit("")))
    found = hits(docs.select(key.alias("d_row"), "text"), benchmark, **parameters).filter(F.size("starts") > 0).select("d_row").distinct()
    found = stored(found, "leaks")
    rows = docs.select(key.alias("d_row"), F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("d_all"))
    return rows.join(found, "d_row", "left_anti").select(*(F.col(f"d_all.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("d_row"), "text")
    found = hits(docs, read(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join(F.array_sort(F.transform(F.filter("items", lambda x: x != NO_ID), lambda x: x.cast("string"))), ","), 256)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return put(found, doc_id=F.col("d_row").cast("long"), n_hit=n_hit, n_items=F.size("items").cast("long"), items_sha256=sha, contaminated=F.size("starts") > 0).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
