"""Token counts by unigram segmentation, with dynamic programming shared along a trie of pre-tokens.

A text is cut into pre-tokens by the vocabulary's pattern. The distinct pre-tokens of a stretch of documents, in sorted
order, are a trie walked depth first: the best score of each prefix is kept on a stack, so a prefix that many pre-tokens
share is scored once. The score of a prefix is the best sum of piece scores over its segmentations; at the end of a
pre-token the number of pieces of that segmentation is stored. Scores are log probabilities, fitted to the documents: Spark counts the
distinct pre-tokens of all of them; each is cut by the scores so far (at first by Zipf's law over the vocabulary's ranks), pieces are counted
over all cuts, and their shares are the next scores. A piece that no cut has keeps a small share.

Defined cases: null and empty texts have no pre-tokens and no tokens. Strings of special tokens are ordinary text. All
single bytes are pieces, so every text has a segmentation; of equal scores the one with the shorter last piece wins.
Repeated rows count alike.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspark.llm.common import put, read, stored

#: Counts that a task remembers; it forgets all beyond that and goes on, so memory is bounded and results don't change.
REMEMBERED = 400_000
#: The most frequent pre-tokens whose counts are worked out once and broadcast, at most (about 30 bytes each). Others are cut in the tasks.
FREQUENT = 200_000
#: Rounds of cutting and counting when scores are fitted, and what is added to each piece's count.
ROUNDS, LEAST_COUNT = 2, 0.1
#: Characters of stretches of text whose counts are remembered; longer ones are cut each time.
SHORT = 40
#: Documents whose pre-tokens are put in one trie.
STRETCH = 1000


def read_vocabulary(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Piece -> rank, from a file with a base64 piece and a rank on each line; a plain path is the driver's own."""
    if path.startswith("/"):
        with open(path) as f:
            lines = f.read().splitlines()
    else:
        lines = [r.value for r in spark.read.text(path).toLocalIterator()]  # a vocabulary, of fixed size
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


class Unigram:
    """Scores of pieces, and of every suffix of a piece whether it is one (its score) or only a suffix (None)."""

    def __init__(self, scores: dict[bytes, float]):
        self.suffixes: dict[bytes, float | None] = {}
        for piece in scores:
            for i in range(1, len(piece)):
                self.suffixes.setdefault(piece[i:], None)
        self.suffixes.update(scores)

    def counts(self, words: Iterable[bytes], used: dict[bytes, int] | None = None, weights: Iterable[int] = ()) -> list[int]:
        """For words in sorted order, the number of pieces in the best segmentation of each; `used` gets the pieces, by the words' weights."""
        get, out, last, weight = self.suffixes.get, [], b"", iter(weights)
        best, pieces, begins = [0.0], [0], [0]
        for w in words:
            shared = 0
            for a, b in zip(last, w, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :], begins[shared + 1 :]
            for end in range(shared + 1, len(w) + 1):
                top, n, begin = -math.inf, 0, end - 1
                for start in range(end - 1, -1, -1):
                    score = get(w[start:end], 0.0)
                    if score is None:
                        continue
                    if score == 0.0:  # no piece ends like this, and no longer one does
                        break
                    if best[start] + score > top:
                        top, n, begin = best[start] + score, pieces[start] + 1, start
                best.append(top)
                pieces.append(n)
                begins.append(begin)
            out.append(pieces[-1])
            last = w
            if used is not None:
                many, end = next(weight), len(w)
                while end:
                    piece = w[begins[end] : end]
                    used[piece] = used.get(piece, 0) + many
                    end = begins[end]
        return out


def zipf(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log probabilities in proportion to 1 / (rank + 1)."""
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - total for piece, r in ranks.items()}


class Cutter:
    """Cuts texts into stretches and stretches into pre-tokens.

    Where a blank follows something that isn't white space a pre-token begins, whatever stands before: true of patterns that don't look
    behind and take white space only at the start of a match, or line ends after other marks. So texts are cut there, and equal stretches, mostly
    a blank and a word, are matched once. With `blanks` false, for other patterns, a text is one stretch."""

    def __init__(self, pattern: str, blanks: bool = True):
        import regex

        self.cut, self.blanks = regex.compile(pattern).findall, blanks
        self.irregular, self.split = regex.compile(r"\s ").search, regex.compile(r"(?<=\S) ").split

    def stretches(self, text: str | None) -> list:
        """The stretches of a text: the first as a tuple of itself, the others without their blank."""
        if not text:
            return []
        if not self.blanks:
            return [(text,)]
        out = self.split(text) if self.irregular(text) else text.split(" ")
        out[0] = (out[0],)
        return out

    def pretokens(self, stretch: str | tuple) -> list[str]:
        return self.cut(stretch[0] if isinstance(stretch, tuple) else " " + stretch)


def short(stretch: str | tuple) -> bool:
    """Whether a stretch is worth remembering, and small enough."""
    return len(stretch if isinstance(stretch, str) else stretch[0]) <= SHORT


def word_counts(docs: DataFrame, pattern: str, blanks: bool = True) -> DataFrame:
    """(word, n): the distinct pre-tokens of all documents, as bytes. Tasks add up some hundred thousand at a time before they hand on."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter, seen, stretches = Cutter(pattern, blanks), Counter(), Counter()

        def settle() -> None:
            for x, n in stretches.items():
                for w in cutter.pretokens(x):
                    seen[w] += n
            stretches.clear()

        for b in batches:
            for t in b["text"]:
                found = cutter.stretches(t)
                if len(t or "") > SHORT * len(found):  # some are long
                    for x in found:
                        if not short(x):
                            seen.update(cutter.pretokens(x))
                    found = filter(short, found)
                stretches.update(found)
                if len(stretches) > REMEMBERED:
                    settle()
                if len(seen) > REMEMBERED:
                    yield frame(seen)
                    seen.clear()
        settle()
        yield frame(seen)

    def frame(seen: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": [w.encode("utf-8", "surrogatepass") for w in seen], "n": list(seen.values())})

    return docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, scores: dict[bytes, float], most: int = FREQUENT) -> dict[str, int]:
    """Pieces of the most frequent of words (word, n): of all that occur 2^k times or more, with the least k that leaves `most` or fewer."""
    sizes = words.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("words")).orderBy(F.desc("k")).collect()  # 63 rows at most
    total, least = 0, None
    for r in sizes:
        total += r.words
        if total > most:
            break
        least = r.k
    if least is None:
        return {}
    held = words.sparkSession.sparkContext.broadcast(Unigram(scores))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values("word")
            yield pd.DataFrame({"word": [w.decode("utf-8", "surrogatepass") for w in b["word"]], "pieces": held.value.counts(b["word"])})

    found = words.filter(F.col("n") >= 1 << least).select("word").mapInPandas(cut, "word string, pieces int").toPandas()
    return dict(zip(found["word"], found["pieces"].tolist(), strict=True))


def fitted(words: DataFrame, ranks: dict[bytes, int], rounds: int = ROUNDS) -> dict[bytes, float]:
    """Scores of the vocabulary's pieces by their shares in the best segmentations of words (word, n). No more than the vocabulary comes back."""
    scores, context = zipf(ranks), words.sparkSession.sparkContext
    for _ in range(rounds):
        held = context.broadcast(Unigram(scores))  # as large as the vocabulary

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                used: dict[bytes, int] = {}
                b = b.sort_values("word")
                held.value.counts(b["word"], used, b["n"].tolist())  # noqa: B023
                yield pd.DataFrame({"piece": list(used), "n": list(used.values())})

        counts = words.mapInPandas(cut, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        seen = {bytes(r.piece): r.n for r in counts.toLocalIterator()}
        total = math.log(sum(seen.values()) + LEAST_COUNT * len(ranks))
        scores = {piece: math.log(seen.get(piece, 0) + LEAST_COUNT) - total for piece in ranks}
    return scores


def count_tokens(docs: DataFrame, scores: dict[bytes, float], pattern: str, remembered: int = REMEMBERED, often: dict[str, int] | None = None, blanks: bool = True) -> DataFrame:
    """docs with n_pretokens and n_tokens. `often` has the counts of pre-tokens that are known already."""
    known_often = docs.sparkSession.sparkContext.broadcast(often or {})
    held = docs.sparkSession.sparkContext.broadcast(Unigram(scores))  # as large as the vocabulary

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cutter, model, known = Cutter(pattern, blanks), held.value, dict(known_often.value)
        counts: dict[str | tuple, tuple[int, int]] = {}  # of stretches: pre-tokens and tokens
        for texts in batches:
            rows = []
            for i in range(0, len(texts), STRETCH):
                found = [cutter.stretches(t) for t in texts.iloc[i : i + STRETCH]]
                if len(known) > remembered + len(known_often.value):
                    known = dict(known_often.value)
                if len(counts) > remembered:
                    counts.clear()
                words = {x: cutter.pretokens(x) for x in {x for f in found for x in f if x not in counts}}
                fresh = sorted((w.encode("utf-8", "surrogatepass"), w) for w in {w for x in words.values() for w in x if w not in known})
                known.update(zip((w for _, w in fresh), model.counts(b for b, _ in fresh), strict=True))
                counts.update((x, (len(w), sum(map(known.__getitem__, w)))) for x, w in words.items())
                for f in found:
                    both = [counts[x] for x in f]
                    rows.append((sum(n for n, _ in both), sum(n for _, n in both)))
                for x in words:
                    if not short(x):
                        del counts[x]
            yield pd.DataFrame(rows, columns=["n_pretokens", "n_tokens"])

    df = put(docs, t_found=count(F.col("text")))
    return put(df, n_pretokens=F.col("t_found.n_pretokens"), n_tokens=F.col("t_found.n_tokens")).drop("t_found")


def query(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = read_vocabulary(spark, path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pattern = pattern or public_tokenizers.PATTERN
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    words = stored(word_counts(docs, pattern), "pre-tokens")
    scores = fitted(words, ranks)
    return count_tokens(docs, scores, pattern, often=frequent(words, scores))[["doc_id", "n_pretokens", "n_tokens"]]
