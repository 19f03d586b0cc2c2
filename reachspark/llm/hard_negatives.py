"""Hard negatives for anchors, by length buckets and feasible coordinate ranges.

An anchor's positives are the rows of its label with the greatest inner products; for each positive its hard negatives are the best rows
of other labels whose score lies between two shares of the positive's. Both are searches for the greatest inner products over a threshold,
the second under a ceiling too.

Rows are written in the order of their lengths. A task takes them in buckets: consecutive rows, so of about one length, with a sorted list
for each coordinate of the rows scaled to length 1. A score of theta needs a cosine of theta / (anchor's length * bucket's length): where that
is over 1 the anchor skips the bucket. Otherwise each of the anchor's greatest coordinates (its focus) leaves a row's coordinate a feasible
range, since two vectors' angles to an axis differ by their own angle at most. Ranges are slices of the sorted lists; the rows in all of an
anchor's slices are its candidates, and their scores are worked out in whole numbers. A threshold is what the k-th best row has so far: from a
bounded sample of rows (SEEDS) to begin with, then rising from bucket to bucket. Thresholds only save work, results don't depend on them.

Anchors are taken in blocks of `block` (ANCHORS), each broadcast to the tasks: a bounded set against all rows. A block's best rows in each
task, and only those, are shuffled.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part. Shorter vectors count as filled up with
zeros. Each row is itself: of repeated rows the others are others, and repeated anchors each have their results. Equal scores go by id,
then by place in the written table. A positive with no row in its range has no result. Whole numbers must allow products below 2^63, else
it is an error. Other columns of the input don't take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachspark.llm.common import read, stored
from reachspark.llm.whitening import matrix, usable

SCALE, EVERY = 256, 100
POSITIVES, NEGATIVES = 5, 10
#: Percentages of a positive's score between which its negatives' lie.
LOW, HIGH = 30, 90
#: Anchors of a block, rows that give first thresholds, coordinates of a focus, anchors scored at once.
ANCHORS, SEEDS, FOCUS, CHUNK = 20_000, 4096, 4, 256
NONE, ALL = -(1 << 62), 1 << 62


class Anchors(NamedTuple):
    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    vectors: np.ndarray


class Wanted(NamedTuple):
    """Searches: `most` rows of scores in [least, up_to] for the anchor at place `anchor`, of its label or of others."""

    anchor: np.ndarray
    least: np.ndarray
    up_to: np.ndarray
    same: bool
    most: int


def taking_part(df: DataFrame, vector: str, label: Column, scale: int = SCALE) -> DataFrame:
    """row, vec_id, label, y (whole numbers), length; written in the order of lengths, equal ones dealt over tasks."""
    y = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    rows = df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), y.alias("y"))
    rows = rows.withColumns({"length": F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), "salt": F.xxhash64("vec_id", "label", "y")})
    order = [F.desc("length"), F.asc("salt")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "vec_id", "label").drop("salt")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "by-length")


class Bucket:
    """Rows of about one length with sorted lists of their scaled coordinates."""

    def __init__(self, rows: pd.DataFrame, d: int, exact_doubles: bool):
        self.row, self.vec_id, self.label = (rows[c].to_numpy(np.int64) for c in ("row", "vec_id", "label"))
        y = matrix(rows["y"], d)
        self.y = y.astype(float) if exact_doubles else y
        self.lengths = np.sqrt((y.astype(float) ** 2).sum(axis=1))
        self.scaled = y / np.maximum(self.lengths, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.scaled[:, f], kind="stable")
            self.lists[f] = order, self.scaled[order, f]
        return self.lists[f]

    def candidates(self, q: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Places of rows that may score `least` or more with q; None stands for all."""
        if not len(self.y):
            return np.zeros(0, np.int64)
        of = length * (self.lengths.max() if least > 0 else self.lengths.min())
        if of == 0:
            return np.zeros(0, np.int64) if least > 0 else None
        cosine = least / of
        if cosine > 1 + 1e-9:
            return np.zeros(0, np.int64)
        if cosine <= -1:
            return None
        angle, scaled = np.arccos(min(cosine, 1.0)), q / length
        slices = []
        for f in np.argsort(-np.abs(scaled), kind="stable")[:FOCUS]:
            own = np.arccos(np.clip(scaled[f], -1, 1))
            low, high = np.cos(min(np.pi, own + angle)) - 1e-9, np.cos(max(0.0, own - angle)) + 1e-9
            order, values = self.sorted_list(int(f))
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            if b - a < len(values):
                slices.append(order[a:b])
        if not slices:
            return None
        seen = np.zeros(len(self.y), np.int8)  # how many of the slices hold a row
        for s in slices:
            seen[s] += 1
        return np.flatnonzero(seen == len(slices))


class Search:
    """The best rows so far for each of some searches."""

    def __init__(self, anchors: Anchors, wanted: Wanted, exact_doubles: bool):
        self.anchors, self.wanted = anchors, wanted
        self.q = anchors.vectors.astype(float) if exact_doubles else anchors.vectors
        self.lengths = np.sqrt((anchors.vectors.astype(float) ** 2).sum(axis=1))
        self.least = wanted.least.copy()
        # searches of an anchor, side by side
        self.order = np.argsort(wanted.anchor, kind="stable")
        self.first = np.searchsorted(wanted.anchor[self.order], np.arange(len(anchors.row) + 1))
        self.best = tuple(np.zeros(0, np.int64) for _ in range(4))  # search, score, id, row

    def add(self, bucket: Bucket) -> None:
        held = np.diff(self.first)
        lowest = np.full(len(self.anchors.row), ALL)
        np.minimum.at(lowest, self.wanted.anchor, self.least)
        active = np.flatnonzero(held > 0)
        for i in range(0, len(active), CHUNK):
            self.add_for(bucket, active[i : i + CHUNK], lowest)

    def add_for(self, bucket: Bucket, places: np.ndarray, lowest: np.ndarray) -> None:
        every, who, at, scores = [], [], [], []
        for a in places:
            found = bucket.candidates(self.q[a], self.lengths[a], lowest[a])
            if found is None:
                every.append(a)
            elif len(found):
                s = (bucket.y[found] @ self.q[a]).astype(np.int64)
                good = s >= lowest[a]
                who.append(np.full(int(good.sum()), a))
                at.append(found[good])
                scores.append(s[good])
        if every:
            s = (self.q[every] @ bucket.y.T).astype(np.int64)
            a, p = np.nonzero(s >= lowest[every][:, None])
            who.append(np.array(every)[a])
            at.append(p)
            scores.append(s[a, p])
        if not who:
            return
        who, at, scores = np.concatenate(who), np.concatenate(at), np.concatenate(scores)
        good = (bucket.label[at] == self.anchors.label[who]) == self.wanted.same
        good &= bucket.row[at] != self.anchors.row[who]
        who, at, scores = who[good], at[good], scores[good]
        new = [self.best]
        for j in range(int(np.diff(self.first).max(initial=0))):  # the j-th search of each anchor
            one = self.first[who] + j < self.first[who + 1]
            search = self.order[(self.first[who] + j)[one]]
            fits = (scores[one] >= self.least[search]) & (scores[one] <= self.wanted.up_to[search])
            new.append((search[fits], scores[one][fits], bucket.vec_id[at[one][fits]], bucket.row[at[one][fits]]))
        search, score, vec_id, row = (np.concatenate(x) for x in zip(*new, strict=True))
        order = np.lexsort((row, vec_id, -score, search))
        search, score, vec_id, row = search[order], score[order], vec_id[order], row[order]
        starts = np.flatnonzero(np.concatenate([[True], search[1:] != search[:-1]])) if len(search) else np.zeros(0, np.int64)
        rank = np.arange(len(search)) - np.repeat(starts, np.diff(np.append(starts, len(search))))
        keep = rank < self.wanted.most
        last = rank == self.wanted.most - 1
        self.least[search[last]] = np.maximum(self.least[search[last]], score[last])
        self.best = search[keep], score[keep], vec_id[keep], row[keep]


def found_by(rows: DataFrame, anchors: Anchors, wanted: Wanted, d: int, exact_doubles: bool) -> DataFrame:
    """search, score, vec_id, row: the best rows for each search, and their rank."""
    held = rows.sparkSession.sparkContext.broadcast((anchors, wanted))  # a block

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Search(*held.value, exact_doubles)
        for b in batches:
            search.add(Bucket(b, d, exact_doubles))
        yield pd.DataFrame(dict(zip(("search", "score", "vec_id", "row"), search.best, strict=True)))

    best = rows.select("row", "vec_id", "label", "y").mapInPandas(look, "search long, score long, vec_id long, row long")
    rank = F.row_number().over(Window.partitionBy("search").orderBy(F.desc("score"), "vec_id", "row"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= wanted.most)


def raised(spark: SparkSession, seeds: pd.DataFrame, anchors: Anchors, wanted: Wanted, d: int, exact_doubles: bool) -> Wanted:
    """The searches with what a sample of rows says of their thresholds; chunks of searches are tasks."""
    if not len(wanted.anchor):
        return wanted
    held = spark.sparkContext.broadcast((seeds, anchors, wanted))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds, anchors, wanted = held.value
        bucket = Bucket(seeds, d, exact_doubles)
        for b in batches:
            for c in b["id"].tolist():
                some = np.flatnonzero(wanted.anchor // CHUNK == c)
                search = Search(anchors, Wanted(wanted.anchor[some], wanted.least[some], wanted.up_to[some], wanted.same, wanted.most), exact_doubles)
                search.add(bucket)
                yield pd.DataFrame({"search": some, "least": search.least})

    chunks = spark.range(0, -(-len(anchors.row) // CHUNK))
    got = chunks.mapInPandas(look, "search long, least long").collect()  # a number for each search of a block
    least = wanted.least.copy()
    for r in got:
        least[r.search] = r.least
    return wanted._replace(least=least)


def mined(df: DataFrame, vector: str, label: Column, block: int = ANCHORS, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for anchors whose vec_id is divisible by `every`."""
    spark = df.sparkSession
    rows = taking_part(df, vector, label, scale)
    facts = rows.agg(F.max(F.size("y")).alias("d"), F.max(F.array_max(F.transform("y", lambda x: F.abs(x)))).alias("top")).first()
    d, top = facts.d or 0, facts.top or 0
    if top * top * max(d, 1) >= 1 << 63:
        raise ValueError("inner products of these vectors don't fit 64 bits")
    doubles = top * top * max(d, 1) < 1 << 53
    seeds = rows.orderBy(F.xxhash64("row"), "row").limit(SEEDS).select("row", "vec_id", "label", "y").toPandas()  # SEEDS rows
    picked = stored(rows.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "y"), "anchors")
    out = []
    each = picked.toLocalIterator()
    while some := list(islice(each, block)):  # a block at a time
        anchors = Anchors(*(np.array([r[c] for r in some], np.int64) for c in ("row", "vec_id", "label")), matrix([r.y for r in some], d))
        n = len(some)
        first = Wanted(np.arange(n), np.full(n, NONE), np.full(n, ALL), True, POSITIVES)
        first = raised(spark, seeds, anchors, first, d, doubles)
        positives = stored(found_by(rows, anchors, first, d, doubles), "positives").select("search", "rank", "vec_id", "score").orderBy("search", "rank").toPandas()  # POSITIVES for each anchor of the block
        scores = positives["score"].to_numpy(np.int64)
        second = Wanted(positives["search"].to_numpy(np.int64), -(-LOW * scores // 100), HIGH * scores // 100, False, NEGATIVES)
        some_fit = second.least <= second.up_to
        second, kept = second._replace(anchor=second.anchor[some_fit], least=second.least[some_fit], up_to=second.up_to[some_fit]), positives[some_fit]
        second = raised(spark, seeds, anchors, second, d, doubles)
        pairs = pd.DataFrame({"search": np.arange(len(kept)), "anchor_id": anchors.vec_id[second.anchor], "positive_id": kept["vec_id"].to_numpy(), "positive_score": kept["score"].to_numpy()}).astype("int64")
        named = spark.createDataFrame(pairs, "search long, anchor_id long, positive_id long, positive_score long")
        best = found_by(rows, anchors, second, d, doubles).join(F.broadcast(named), "search")  # POSITIVES rows for each anchor of a block
        out.append(stored(best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, out) if out else empty


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return mined(rows, "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


SQL = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS y FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.y, b.y) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT * FROM (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score) WHERE rank <= {NEGATIVES}"""
