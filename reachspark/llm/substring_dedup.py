"""Removal of byte strings that occur twice or more, by suffix sorting of shards.

A byte goes if some string of `width` bytes over it starts at another place as well, in the same text or in another one.

Two equal strings of `width` bytes hold the same anchor at the same place: of their substrings of `inner` bytes the one with
the least hash. A text is cut into stretches of strings with a common anchor. Stretches whose anchor is found once
are unique. Stretches of equal bytes (equal 128-bit digests) are one stretch with a count, so where all of a repeated anchor
are equal, there is one string to sort, which is beside itself in any order: all of it is repeated. The distinct stretches of other
anchors, where a repeated passage begins or ends, are read, those found several times as two, and dealt into shards by their anchor;
each shard is sorted by suffix (see induced_sort), and the common prefixes that the sort carries, nothing else, show the strings that
occur twice. With sort_all the stretches of all repeated anchors are sorted so, to the same result. An anchor with more than a shard of stretches is split: equal
strings hold the anchor at the same offset, so stretches are cut into runs of a few offsets and dealt by what all strings of those
offsets share; what is too much even so is cut into single strings, dealt by all of their bytes, and equal ones are counted.

Defined cases: null and empty texts, and those shorter than `width`, keep all they have. Matches never cross
texts. Repeated rows are each other's copies, so long ones lose all. A row without doc_id is told from others
by its text. Ties between equal hashes go to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspark.llm.common import put, read, stored
from reachspark.llm.induced_sort import repeated

WIDTH, INNER = 200, 80
#: Bytes of stretches in a shard, about, and starts of a text that a task handles at a time.
SHARD_BYTES, STRETCH = 4_000_000, 1 << 19
#: Offsets of the anchor in one run of a split stretch.
OFFSETS = 11
LOW = np.uint64((1 << 20) - 1)
#: Bytes of a strip in a sort: what is found several times is there twice.
SORTED_BYTES = "octet_length(data) * least(copies, 2)"


class Hasher:
    """Hashes of all substrings of one length, from sums of powers modulo 2^64."""

    def __init__(self, size: int = STRETCH + 4096):
        rng = np.random.default_rng(20240229)
        odd = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(odd), -1, 1 << 64))
        self.value = rng.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, odd, np.uint64))])
        self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, inverse, np.uint64))])

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.up[: len(data)])])

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        x = (sums[stop] - sums[start]) * self.down[start]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


_hasher: list[Hasher] = []


def least_in_windows(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w successive values: least since a multiple of w, and until the next one."""
    n = len(x)
    blocks = np.pad(x, (0, -n % w), constant_values=np.uint64(0xFFFFFFFFFFFFFFFF)).reshape(-1, w)
    until = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    since = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(until[: n - w + 1], since[w - 1 : n])


def stretches(data: bytes, width: int = WIDTH, inner: int = INNER) -> tuple[np.ndarray, ...]:
    """(start, n, anchor, content, check): n successive strings from start share an anchor; the digest of all their bytes is in two halves."""
    if not _hasher:
        _hasher.append(Hasher())
    h, every, out = _hasher[0], np.frombuffer(data, dtype=np.uint8), []
    for begin in range(0, len(every) - width + 1, STRETCH):
        part = every[begin : begin + STRETCH + width - 1]
        n = len(part) - inner + 1
        sums = h.sums(part)
        place = np.arange(n)
        hashed = h.of(sums, place, place + inner)
        least = least_in_windows((hashed & ~LOW) | place.astype(np.uint64), width - inner + 1)
        start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        many = np.diff(np.concatenate([start, [len(least)]]))
        anchor = hashed[(least[start] & LOW).astype(np.int64)]
        digests = b"".join([hashlib.blake2b(data[a:z], digest_size=16).digest() for a, z in zip((start + begin).tolist(), (start + begin + many + width - 1).tolist(), strict=True)])
        content = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
        out.append((start + begin, many, anchor.view(np.int64), content[:, 0], content[:, 1]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def keyed(docs: DataFrame) -> DataFrame:
    """(id, h, text): doc_id and a hash of the text stand for a row."""
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64("text", F.length("text")).alias("h"), "text")


def anchored(rows: DataFrame, width: int, inner: int) -> DataFrame:
    """(id, h, start, n, anchor, content, check) of all stretches of all texts."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, size = [], 0
            for i, h, t in zip(b["id"], b["h"], b["text"], strict=True):
                s = stretches(as_bytes(t), width, inner)
                found.append((i, h, s))
                size += len(s[0])
                if size > 100_000:
                    yield frame(found)
                    found, size = [], 0
            if size:
                yield frame(found)

    def frame(found: list) -> pd.DataFrame:
        n = [len(s[0]) for _, _, s in found]
        columns = {"id": pd.array(np.repeat(np.array([i for i, _, _ in found], dtype=object), n), dtype="Int64"), "h": np.repeat([h for _, h, _ in found], n)}
        return pd.DataFrame(columns | {c: np.concatenate([s[k] for _, _, s in found]) for k, c in enumerate(("start", "n", "anchor", "content", "check"))})

    return rows.filter(F.octet_length("text") >= width).mapInPandas(cut, "id long, h long, start long, n long, anchor long, content long, check long")


def beside(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (id, h, text) with the `ranges` that a list has for them, null where it has none. Lists grow with the texts, so none is broadcast."""
    right = ranges.select(F.col("id").alias("r_id"), F.col("h").alias("r_h"), "ranges").hint("merge")
    return rows.join(right, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h")), "left").drop("r_id", "r_h")


def split(strips: DataFrame, width: int, inner: int, most: int) -> DataFrame:
    """Strips cut into runs of at most `most` offsets of the anchor, with the bytes that all strings of these offsets share as part."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not _hasher:
            _hasher.append(Hasher())
        h = _hasher[0]
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                bare = np.frombuffer(r.data, dtype=np.uint8)
                place = np.arange(len(bare) - inner + 1)
                p = int(np.argmax(h.of(h.sums(bare), place, place + inner).view(np.int64) == r.anchor))
                for run in range((p - r.m + 1) // most, p // most + 1):
                    low, high = run * most, min(run * most + most - 1, width - inner)
                    a, z = max(0, p - high), min(r.m - 1, p - low)
                    core = b"%d %d %d " % (r.anchor, most, run) + r.data[p - low : p - high + width]
                    part = int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True)
                    out.append((r.anchor, r.content, r.check, r.n, r.copies, r.data[a : z + width], r.at + a, z - a + 1, part))
            yield pd.DataFrame(out, columns=list(b.columns))

    return strips.mapInPandas(cut, strips.schema)


def dealt(strips: DataFrame, width: int, inner: int, shard_bytes: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Strips (anchor, content, check, n, copies, data) with the shard that each is sorted in, and single strings of parts that fit no shard.

    data holds m strings from the strip's string `at` on; equal strings have the same part, and a part is in one shard."""
    rest = strips.select("anchor", "content", "check", "n", "copies", "data", F.lit(0).cast("long").alias("at"), F.col("n").alias("m"), F.col("anchor").alias("part"))
    out = []

    def deal(some: DataFrame) -> None:
        total = some.agg(F.coalesce(F.sum(F.expr(SORTED_BYTES)), F.lit(0))).first()[0]
        out.append(some.withColumn("shard", F.pmod(F.col("part"), F.lit(max(1, -(-total // shard_bytes))))))

    for most in (OFFSETS, 1):
        hot = rest.groupBy("part").agg(F.sum(F.expr(SORTED_BYTES)).alias("bytes")).filter(F.col("bytes") > shard_bytes).select("part")
        hot = stored(hot, "hot-parts")  # no more than there are shards
        if hot.isEmpty():
            deal(rest)
            return out, None
        deal(rest.join(F.broadcast(hot), "part", "left_anti"))
        rest = stored(split(rest.join(F.broadcast(hot), "part", "left_semi").select(*rest.columns), width, inner, most), "split")
        again = rest.groupBy("part").agg(F.sum("copies").alias("c")).filter("c > 1").select("part")  # others can't be repeated
        rest = stored(rest.join(again, "part", "left_semi").select(*rest.columns), "split-again")
    return out, rest


def sorted_shards(strips: DataFrame, width: int, inner: int, shard_bytes: int) -> DataFrame:
    """(anchor, content, check, n, first, last) for every range of repeated strings in the strips (anchor, content, check, n, copies, data)."""

    def find(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.drop_duplicates(["anchor", "content", "check", "n", "at"]).reset_index(drop=True)
        out, data = [], list(shard["data"])
        again = [data[k] for k in np.flatnonzero(shard["copies"] > 1)]
        for k, flag in zip(range(len(data)), repeated(data + again, width), strict=False):
            edge, at = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])), shard["at"][k]
            out += [(shard["anchor"][k], shard["content"][k], shard["check"][k], shard["n"][k], at + a, at + b) for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True)]
        return pd.DataFrame(out, columns=["anchor", "content", "check", "n", "first", "last"])

    shards, single = dealt(strips, width, inner, shard_bytes)
    found = [x.groupBy("shard").applyInPandas(find, "anchor long, content long, check long, n long, first long, last long") for x in shards]
    if single is not None:
        twice = single.groupBy("part", "data").agg(F.sum("copies").alias("c")).filter("c > 1").select("part", "data")
        found.append(single.join(twice, ["part", "data"], "left_semi").select("anchor", "content", "check", "n", F.col("at").alias("first"), (F.col("at") + 1).alias("last")))
    return reduce(DataFrame.unionByName, found)


def repeats(docs: DataFrame, width: int = WIDTH, inner: int = INNER, shard_bytes: int = SHARD_BYTES, sort_all: bool = False) -> DataFrame:
    """(id, h, ranges): the maximal byte ranges (start, stop) of each text that repeated strings cover."""
    rows = keyed(docs)
    every = stored(anchored(rows, width, inner), "stretches")
    differ = (F.min("content") < F.max("content")) | (F.min("check") < F.max("check")) | (F.min("n") < F.max("n"))
    # Written first: the join below it has no aggregation in its stage, so adaptive execution can split a hot anchor's rows
    often = stored(every.groupBy("anchor").agg(F.count("*").alias("c"), (differ | F.lit(sort_all)).alias("mixed")).filter("c > 1").select("anchor", "mixed"), "repeated-anchors")
    here = stored(every.join(often.hint("merge"), "anchor"), "anchored")
    plain = here.filter("not mixed").select("id", "h", "start", (F.col("start") + F.col("n") + width - 1).alias("stop"))
    mixed = here.filter("mixed")
    distinct = mixed.groupBy("anchor", "content", "check", "n").agg(F.count("*").alias("copies"), F.min(F.struct("id", "h", "start")).alias("at"))
    wanted = distinct.groupBy("at.id", "at.h").agg(F.collect_list(F.struct("at.start", "n", "anchor", "content", "check", "copies")).alias("ranges"))
    wanted = stored(wanted, "strips-wanted")

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, ranges in zip(b["text"], b["ranges"], strict=True):
                data = as_bytes(text)
                out = [(r["anchor"], r["content"], r["check"], r["n"], r["copies"], data[r["start"] : r["start"] + r["n"] + width - 1]) for r in ranges]
                yield pd.DataFrame(out, columns=["anchor", "content", "check", "n", "copies", "data"])

    strips = beside(rows, wanted).filter("ranges is not null").mapInPandas(strip, "anchor long, content long, check long, n long, copies long, data binary")
    found = sorted_shards(stored(strips, "strips"), width, inner, shard_bytes)
    edges = mixed.join(stored(found, "sorted").hint("merge"), ["anchor", "content", "check", "n"]).select("id", "h", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + width - 1).alias("stop"))
    both = plain.unionByName(edges).groupBy("id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(ranges=[[{"start": x, "stop": y} for x, y in spans(r)] for r in b["ranges"]])

    return stored(both.mapInPandas(merge, both.schema), "repeats")


def spans(ranges) -> list[list[int]]:
    """Maximal ranges that cover what the given ones do."""
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["stop"]) for r in ranges) if ranges is not None else ():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def dedup(docs: DataFrame, width: int = WIDTH, inner: int = INNER, shard_bytes: int = SHARD_BYTES, sort_all: bool = False) -> DataFrame:
    """doc_id, kept (the bytes that stay, as binary), n_bytes, n_removed, n_spans and kept_sha256 for every row of docs."""
    rows = beside(keyed(docs), repeats(docs, width, inner, shard_bytes, sort_all))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, ranges in zip(b["text"], b["ranges"], strict=True):
                data, cut = as_bytes(text), spans(ranges)
                kept = b"".join(data[x:y] for x, y in zip([0, *(s[1] for s in cut)], [*(s[0] for s in cut), len(data)], strict=True))
                out.append((kept, len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
            done = pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            done.insert(0, "doc_id", pd.array(b["id"].astype(object).where(b["id"].notna(), None), dtype="Int64"))
            yield done

    return rows.mapInPandas(apply, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return put(dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
