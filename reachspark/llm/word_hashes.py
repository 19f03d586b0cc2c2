"""Hashes of all words of a batch of texts at once, and bit filters of bounded size for them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text, about, that are hashed at a time.
PART_BYTES = 1 << 21
#: Bytes of words whose sums are held at a time.
SUM_BYTES = 1 << 18


def byte_table() -> np.ndarray:
    """For each byte: itself, in lower case, if it is part of a word (ASCII letter, digit, not ASCII), else 0."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    keep = np.zeros(256, dtype=bool)
    keep[ord("0") : ord("9") + 1] = keep[ord("a") : ord("z") + 1] = keep[ord("A") : ord("Z") + 1] = keep[128:] = True
    return np.where(keep, table, 0).astype(np.uint8)


TABLE = byte_table()
ODD = 0x9E3779B97F4A7C15
VALUE = np.random.default_rng(20240311).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SUM_BYTES + 4096)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (ODD, pow(ODD, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of several texts: hash, begin and end in `low` (the texts' lower-cased bytes, 0 between words), and text of each."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.low = TABLE[np.frombuffer(b"\0".join([*raw, b""]), dtype=np.uint8)]
        begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        edge = np.diff(np.concatenate([[0], (self.low > 0).view(np.int8), [0]]))
        self.start, self.stop = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        #: first[i] is the place of text i's first word among all words
        self.first = np.searchsorted(self.start, begins)
        self.text = np.repeat(np.arange(len(raw)), np.diff(self.first))
        self.hash = np.empty(len(self.start), dtype=np.uint64)
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.stop, self.start[i] + SUM_BYTES, "right")))
            a, z = int(self.start[i]), int(self.stop[j - 1])
            up, down = powers(z - a + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE[self.low[a:z]] * up[: z - a])])
            self.hash[i:j] = mix((sums[self.stop[i:j] - a] - sums[self.start[i:j] - a]) * down[self.start[i:j] - a])
            i = j

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, hash) of all runs of `size` words inside one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        code = np.full(n, size, dtype=np.uint64)
        for j in range(size):
            code = mix(code * np.uint64(ODD) + self.hash[j : j + n])
        place = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return place, code[place]

    def joined(self, first: int, last: int) -> str:
        """The words first to last (exclusive) with a blank between."""
        words = self.low[self.start[first] : self.stop[last - 1]].tobytes().split(b"\0")
        return b" ".join(w for w in words if w).decode("utf-8", "surrogatepass")


def parts(b: pd.DataFrame, text: str = "text") -> Iterator[pd.DataFrame]:
    """A batch in parts of bounded text, or of one text."""
    size = b[text].map(lambda t: len(t) if t else 0).cumsum() // PART_BYTES
    for _, part in b.groupby(size, sort=False):
        yield part


class Filter:
    """A set of 64-bit hashes as bits at their upper `width` bits: it may hold more than was put in, never less."""

    def __init__(self, words: np.ndarray, width: int):
        self.words, self.width = words, width

    def has(self, code: np.ndarray) -> np.ndarray:
        at = code >> np.uint64(64 - self.width)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def filter_of(hashes: DataFrame, column: str, width: int) -> Filter:
    """A filter of a column of hashes, made by Spark: 2^(width - 6) words at most come to the driver, whatever the rows."""
    at = F.shiftrightunsigned(F.col(column), 64 - width)
    bits = hashes.groupBy(F.shiftrightunsigned(at, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    found = bits.toPandas()
    words = np.zeros(1 << (width - 6), dtype=np.uint64)
    words[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return Filter(words, width)
