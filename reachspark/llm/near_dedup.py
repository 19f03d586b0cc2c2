"""Near-duplicate classes by ProbMinHash.

A document is a bag of shingles: five successive lower-cased words, weighted by how often they occur. Each shingle runs
a Poisson process whose rate is its weight; arrivals fall on random slots of the signature, and a slot keeps the shingle
that arrives first. Processes stop once no arrival can be first any more. Two signatures agree in a slot with the
probability Jaccard similarity of the bags, which for bags without repeats is the Jaccard similarity of the sets.
Bands of slots give candidates; they are verified with the exact similarity of whole texts; verified pairs join classes.

Groups may be of any size. Equal texts are one node. In a bucket of equal bands every node is compared with one of them, its
leader, so a group of m texts gives m pairs a band. Where verified pairs leave a bucket in several classes, its nodes are
compared across classes too, all pairs but those that can't be similar enough: whose signatures, one bit a slot, differ in
too many bits (by six deviations), that share none of the rarest shingles, of which similar bags share one, or whose shingles,
counted odd or even in cells, differ in more cells than similar bags have different shingles. Before that every node is compared with one node
for each of its rarest shingles, so that fewer classes are left to compare. So no link between different classes is lost.
Both comparisons of all pairs deal the rows of a hot key into parts, so none is one task.

Defined cases: a text of one to four words is one shingle. Null and empty texts have none and are like nothing, not
even each other: their class is their own doc_id. In classes() rows of one doc_id are one document, whatever their texts; a row without
doc_id gets the class of an equal text with one, else null. In keep_one() every distinct row is a document. The class id is the
smallest doc_id in the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachspark.llm.common import HELD, apart, read, stored, together, whole, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Slots in a band and bands: a pair at the threshold shares no band once in 80,000.
ROWS, BANDS = 7, 48
#: Document ids up to which a list of them is broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Words, about, and documents that a task handles at a time.
STRETCH, STRETCH_ROWS = 200_000, 1000
#: Slots of the longer signatures that nodes compared across classes get.
LONG_SLOTS = 1008
#: Cells that the shingles of such nodes are counted in, odd or even.
CELLS = 1008
#: Rows of a key that a task compares with the key's other rows; keys with more are dealt into parts.
PART_ROWS = 2000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bag(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text's word hashes, sorted, and how often each occurs."""
    w = np.asarray(words, dtype=np.int64).astype(np.uint64)
    if not len(w):
        return w, np.zeros(0, np.int64)
    n = min(size, len(w))
    s = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    return np.unique(s, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int) -> np.ndarray:
    """A row of `slots` shingles for each bag that isn't empty."""
    sizes = np.array([len(b[0]) for b in bags])
    shingle = np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] for b in bags]).astype(np.float64)
    doc = np.repeat(np.arange(len(bags)), sizes)
    first = np.full(len(bags) * slots, np.inf)
    found = np.zeros(len(bags) * slots, dtype=np.uint64)
    time, step = np.zeros(len(shingle)), 0
    while len(shingle):
        step += 1
        draw = mix(shingle + np.full(1, step, np.uint64) * np.uint64(0xD1B54A32D192ED03))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) / 9007199254740993.0) / weight
        at = doc * slots + (mix(draw) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        found[at[won]] = shingle[won]
        alive = np.flatnonzero(np.bincount(doc, minlength=len(bags)))
        last = np.full(len(bags), -1.0)
        last[alive] = first.reshape(len(bags), slots)[alive].max(axis=1)
        going = time < last[doc]
        shingle, weight, doc, time = shingle[going], weight[going], doc[going], time[going]
    return found.reshape(len(bags), slots)


def summaries(found: np.ndarray, rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Of signatures: a hash of each band, and one bit of each slot."""
    band = np.tile(np.arange(bands, dtype=np.uint64), (len(found), 1))
    for i in range(rows):
        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + found[:, i::rows][:, :bands])
    return band.view(np.int64), bit_words(found)


def bit_words(found: np.ndarray) -> np.ndarray:
    """One bit of each slot of signatures, 63 in a word."""
    return packed(mix(found) & np.uint64(1))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits, 63 in a word."""
    words = -(-bits.shape[1] // 63)
    bits = np.pad(bits, ((0, 0), (0, words * 63 - bits.shape[1]))).reshape(len(bits), words, 63)
    return (bits << np.arange(63, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)


def sketches(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of words for each bag: the bits of its long signature, whether each cell holds an odd number of its distinct shingles, and
    the number of its shingles with repeats and without."""
    odd = np.array([np.bincount((mix(s) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) & 1 for s, _ in bags], dtype=np.uint64)
    sizes = np.array([(w.sum(), len(s)) for s, w in bags], dtype=np.int64)
    return np.hstack([bit_words(signatures(bags, LONG_SLOTS)), packed(odd), sizes])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two bags, exactly: the sum over shared shingles of 1 / sum of greatest ratios."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    both = (x > 0) & (y > 0)
    if x.max() == y.max() == 1:
        return both.sum() / len(every)
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ratio, x, y, both = ratio[order], x[order], y[order], both[order]
    place = np.searchsorted(ratio, ratio[both], side="left")
    from_here = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])[place]
    before = np.concatenate([[0.0], np.cumsum(y)])[place]
    return float((1 / (from_here / x[both] + before / y[both])).sum())


def parts(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch with word hashes w, in parts of bounded size."""
    size = b["w"].map(len).cumsum() // STRETCH + np.arange(len(b)) // STRETCH_ROWS
    for _, part in b.groupby(size, sort=False):
        yield part


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))


def signed(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_key, n_bands, n_bits) for every row with words; n_key is the digest of the words of the text."""
    words = words_of(F.lower(whole()))
    df = docs.select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    df = df.select("doc_id", F.md5(F.concat_ws(" ", "w")).alias("n_key"), F.transform("w", lambda w: F.xxhash64(w)).alias("w"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in parts(b):
                band, bits = summaries(signatures([bag(w) for w in part["w"]], rows * bands), rows, bands)
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_key": part["n_key"], "n_bands": list(band), "n_bits": list(bits)})

    return df.mapInPandas(sign, "doc_id long, n_key string, n_bands array<long>, n_bits array<long>")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are that similar. b's text travels to a's, so a leader's text isn't copied to its pairs."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", word_hashes(F.col("a_text")).alias("x"), word_hashes(F.col("b_text")).alias("y"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            last, own = None, None
            keep = []
            for a, x, y in zip(p["a"], p["x"], p["y"], strict=True):
                if a != last:
                    last, own = a, bag(x)
                keep.append(similarity(own, bag(y)) >= least)
            yield p.loc[keep, ["a", "b"]]

    return both.mapInPandas(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, class) for every node of the links (a, b): the smallest node that it hangs together with.

    Alternates two steps until nothing changes: every node ties its greater neighbours to its smallest one, then ties itself
    and its smaller neighbours to the smallest. Smallest neighbours are partly found before each shuffle."""
    e = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        round_ = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if round_ == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("class")).union(e.select("v", "v").distinct())
        mark = round_
        every = e.union(e.select("v", "u"))
        least = every.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = every.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.filter("u <> v"), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        e = stored(small.distinct(), "links")


def tied(label: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (node, class) after further links (a, b)."""
    if links.isEmpty():
        return label
    return stored(components(label.select(F.col("node").alias("a"), F.col("class").alias("b")).union(links)), "classes")


def bits_apart(slots: int, least: float) -> int:
    """Bits in which the signatures of a pair of the threshold differ at most, but for six deviations."""
    return int(slots * (1 - least) / 2 + 6 * (slots * (1 - least) / 2 * (1 + least) / 2) ** 0.5)


def bits_that_differ(p: Column, q: Column, slots: int, first: int = 0) -> Column:
    return sum((F.bit_count(p[first + i].bitwiseXOR(q[first + i])) for i in range(-(-slots // 63))), F.lit(0))


def may_be_similar(p: tuple[Column, Column], q: tuple[Column, Column], least: float) -> Column:
    """Whether two bags may be similar enough, by their sketches and the shares x and y of them that are known not to be common.

    If shares x and y of two bags aren't common, their similarity is at most (1 - x)(1 - y) / (1 - xy): with x_i, y_i the shares of common
    shingle i, its term is at most 1 / (1/x_i + y/y_i), which is concave in (x_i, y_i), so the sum is at most that term of the sums.
    A shingle of both bags changes no cell between odd and even, one of a single bag changes one cell. So there are as many shingles of a single bag as
    cells that differ, at least, and as many more in one bag as it has distinct shingles more; each is a share of one shingle at least."""
    (a, x), (b, y) = p, q
    first = -(-LONG_SLOTS // 63)
    total = first + -(-CELLS // 63)
    more = a[total + 1] - b[total + 1]
    single = F.greatest(bits_that_differ(a, b, CELLS, first), F.abs(more))
    enough = lambda x, y: (1 - x) * (1 - y) >= (least - 1e-9) * (1 - x * y)
    exact = enough(F.greatest(x, (single + more) / 2 / a[total]), F.greatest(y, (single - more) / 2 / b[total]))
    return enough(x, y) & (bits_that_differ(a, b, LONG_SLOTS) <= bits_apart(LONG_SLOTS, least)) & exact


def prefixes(own: DataFrame, least: float) -> DataFrame:
    """(node, prefix, before): the shingles, rarest first, before which no more than 1 - least of a bag's weight lies, and that share.

    Similarity is at most the share of a bag's weight that is common to both, so of two bags that are similar enough the
    first shingle that both have is in both prefixes. Rarity is counted among the nodes given (node, w: word hashes); shingles of
    one node are left out."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [bag(w) for w in b["w"]]
            if found:
                yield pd.DataFrame({"node": np.repeat(b["node"].to_numpy(), [len(s) for s, _ in found]), "s": np.concatenate([s for s, _ in found]).view(np.int64), "w": np.concatenate([n for _, n in found])})

    bags = stored(own.mapInPandas(rows, "node long, s long, w long"), "bags")
    often = bags.groupBy("s").agg(F.count("*").alias("n"))
    order = bags.join(often, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "s", "w"))).alias("x"))
    order = order.select("node", "x.n", "x.s", "x.w")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, s, w in zip(b["n"], b["s"], b["w"], strict=True):
                before = np.cumsum(w) - w
                keep = (before <= (1 - least) * w.sum() + 1e-9) & (n > 1)
                out.append((s[keep], before[keep] / w.sum()))
            yield pd.DataFrame({"node": b["node"], "prefix": [x for x, _ in out], "before": [y for _, y in out]})

    return order.mapInPandas(cut, "node long, prefix array<long>, before array<double>")


def sketched(nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(node, n_bits, prefix, before) of nodes: their sketches and prefixes."""
    own = stored(texts.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]).select("node", word_hashes(F.col("text")).alias("w")).repartition("node"), "likely-words")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in parts(b):
                yield pd.DataFrame({"node": part["node"], "n_bits": list(sketches([bag(w) for w in part["w"]]))})

    return stored(own.mapInPandas(sign, "node long, n_bits array<long>").join(prefixes(own, least), "node"), "prefixes")


def by_shingle(nodes: DataFrame, own: DataFrame) -> DataFrame:
    """(node, class, n_bits, s, out) of nodes (node, class): a row for each shingle s of a prefix, with the share of the bag before it."""
    rows = nodes.select("node", "class").join(own, "node")
    rows = rows.select("node", "class", "n_bits", F.explode(F.arrays_zip("prefix", "before")).alias("z"))
    return rows.select("node", "class", "n_bits", F.col("z.prefix").alias("s"), F.col("z.before").alias("out"))


def to_first(nodes: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes (node, class) of different classes that may be similar enough, where a is the node that has least before their
    shingle: one pair at most for each node and shingle of its prefix."""
    rows = by_shingle(nodes, own)
    lead = rows.groupBy("s").agg(F.min(F.struct("out", "node", "class", "n_bits")).alias("l"))
    ok = (F.col("class") != F.col("l.class")) & may_be_similar((F.col("n_bits"), F.col("out")), (F.col("l.n_bits"), F.col("l.out")), least)
    return rows.join(lead, "s").filter(ok).select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct()


def across(nodes: DataFrame, texts: DataFrame, least: float, most: int = PART_ROWS, own: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of nodes (node, class) of different classes that may be similar enough: they share a prefix, and
    their sketches, made here unless given, allow it. Each pair comes once.

    What lies before the first shingle that both prefixes have isn't common; a later one has more before it, so a pair that passes there passes at
    the first too, and no row needs its whole prefix beside it."""
    p, q = dealt(by_shingle(nodes, sketched(nodes, texts, least) if own is None else own), "s", most)
    side = lambda df, k: df.select("s", "part", *(F.col(c).alias(f"{k}_{c}") for c in ("node", "class", "n_bits", "out")))
    similar = may_be_similar((F.col("p_n_bits"), F.col("p_out")), (F.col("q_n_bits"), F.col("q_out")), least)
    ok = (F.col("p_node") < F.col("q_node")) & (F.col("p_class") != F.col("q_class")) & similar
    return side(p, "p").join(side(q, "q"), ["s", "part"]).filter(ok).select(F.col("p_node").alias("a"), F.col("q_node").alias("b")).distinct()


def dealt(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Two sides of a join of rows (key, node, ...) with themselves, on key and part: each row is in one part of its key on the left and
    in all of them on the right, so a hot key is as many groups as it has parts and still every row meets every other."""
    hot = small_list(stored(rows.groupBy(key).count().filter(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("parts")), "hot"))
    rows = rows.join(hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).drop("parts")
    return left, rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def small_list(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """ids, broadcast if there are few enough of them."""
    return ids.hint("broadcast" if ids.count() <= most else "merge")


def classes(docs: DataFrame, least: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS, most: int = PART_ROWS) -> DataFrame:
    """(doc_id, class_id), a row for each row of docs."""
    sig = stored(signed(docs, rows, bands), "signatures")
    nodes = stored(sig.groupBy("n_key").agg(F.min("doc_id").alias("node"), F.first("n_bands").alias("n_bands"), F.first("n_bits").alias("n_bits")).filter("node is not null"), "nodes")
    band = nodes.select("node", F.explode("n_bands").alias("key"))
    shared = band.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    member = stored(band.join(shared, "key").select("key", "lead", "node"), "buckets")
    stars = stored(member.filter("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(small_list(stored(member.select("node").distinct(), "members")), "node", "left_semi")
    texts = stored(texts.filter("text is not null"), "texts")
    links = stored(verified(stars, texts, least), "verified")
    label = stored(components(links), "classes")
    # Buckets that verified links leave in several classes: their nodes are compared across classes
    member = member.join(label, "node", "left").select("key", "node", F.coalesce("class", "node").alias("class"))
    torn = member.groupBy("key").agg(F.min("class").alias("l"), F.max("class").alias("h")).filter("l < h").select("key")
    member = stored(member.join(torn, "key").join(nodes.select("node", "n_bits"), "node"), "torn")
    allowed = bits_apart(rows * bands, least)
    member, other = dealt(member, "key", most)
    other = other.select(F.col("key").alias("q_key"), F.col("part").alias("q_part"), F.col("class").alias("q_class"), F.col("n_bits").alias("q_bits"))
    near = (F.col("key") == F.col("q_key")) & (F.col("part") == F.col("q_part")) & (F.col("class") != F.col("q_class"))
    near = near & (bits_that_differ(F.col("n_bits"), F.col("q_bits"), rows * bands) <= allowed)
    likely = stored(member.join(other, near, "left_semi").select("node", "class").distinct(), "likely")
    own = sketched(likely, texts, least)
    label = tied(label, stored(verified(stored(to_first(likely, own, least), "to-first"), texts, least), "verified"))
    likely = stored(likely.select("node").join(label, "node", "left").select("node", F.coalesce("class", "node").alias("class")), "likely")
    cross = stored(across(likely, texts, least, most, own).join(stars, ["a", "b"], "left_anti"), "across")
    label = tied(label, stored(verified(cross, texts, least), "verified"))
    node_class = nodes.join(label, "node", "left").select("n_key", F.coalesce("class", "node").alias("class"))
    found = sig.select("doc_id", "n_key").join(node_class, "n_key").groupBy("doc_id").agg(F.min("class").alias("class_id"))
    known = found.filter("doc_id is not null")
    out = docs.select("doc_id").join(known, "doc_id", "left")
    if sig.filter("doc_id is null").isEmpty():
        return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    keyed = docs.filter("doc_id is null").select(F.md5(F.concat_ws(" ", words_of(F.lower(whole())))).alias("n_key")).join(node_class, "n_key", "left")
    return out.filter("doc_id is not null").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).union(keyed.select(F.lit(None).cast("long"), "class"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """docs without the rows that are near copies of one that stays, with the input's own columns, whatever their names.

    Rows are told apart by a number of their own, smaller for smaller doc_ids, so texts that share a doc_id, or have none, are documents of
    their own: of each class the row of the least doc_id stays, null last, and of equal ones that of the least text."""
    columns = docs.columns
    rows = apart(docs, "doc_id", "text").withColumn("g_key", F.md5(F.coalesce("text", F.lit(""))))
    # equal rows are one document: (doc_id, text) gets a number by order of doc_id and text
    distinct = rows.groupBy("doc_id", "g_key", F.col("text").isNull().alias("g_null")).agg(F.count("*").alias("g_n"))
    distinct = stored(distinct, "distinct-rows")
    if distinct.filter("doc_id is null").isEmpty() and distinct.groupBy("doc_id").count().filter("count > 1").isEmpty():
        numbered = rows.withColumn("g_id", F.col("doc_id"))
    else:
        ids = stored(ordered(distinct), "row-numbers")
        numbered = rows.join(ids, rows["doc_id"].eqNullSafe(ids["i_id"]) & (rows["g_key"] == ids["i_key"]) & (F.col("text").isNull() == ids["i_null"]))
        numbered = stored(numbered.select("text", "g_id", *(f"in_{i}_{HELD}" for i in range(len(columns)))), "numbered")
    c = stored(classes(numbered.select(F.col("g_id").alias("doc_id"), "text"), **parameters), "document-classes")
    gone = small_list(stored(c.filter("doc_id <> class_id").select(F.col("doc_id").alias("x_id")).distinct(), "gone"))
    out = numbered.join(gone, F.col("g_id") == F.col("x_id"), "left_anti")
    if not distinct.filter("g_n > 1").isEmpty():  # equal rows: one stays
        out = out.dropDuplicates(["g_id"])
    return together(out, columns)


def ordered(distinct: DataFrame) -> DataFrame:
    """(i_id, i_key, i_null, g_id): numbers of distinct rows in the order of doc_id (null last) and text, from counts of ranges and
    places inside them, so no task sorts all."""
    df = distinct.withColumn("r_range", F.coalesce(F.floor(F.col("doc_id") / 4096), F.lit((1 << 62))))
    df = df.withColumn("r_sub", F.when(F.col("doc_id").isNull(), F.substring("g_key", 1, 3)).otherwise(""))
    before = Window.orderBy("r_range", "r_sub").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = df.groupBy("r_range", "r_sub").agg(F.count("*").alias("r_n")).select(F.col("r_range").alias("s_range"), F.col("r_sub").alias("s_sub"), F.coalesce(F.sum("r_n").over(before), F.lit(0)).alias("r_before"))
    inside = Window.partitionBy("r_range", "r_sub").orderBy(F.col("doc_id").asc_nulls_last(), "g_key", "g_null")
    df = df.withColumn("r_in", F.row_number().over(inside)).join(counts, (F.col("r_range") == F.col("s_range")) & (F.col("r_sub") == F.col("s_sub")))
    return df.select(F.col("doc_id").alias("i_id"), F.col("g_key").alias("i_key"), F.col("g_null").alias("i_null"), (F.col("r_before") + F.col("r_in")).cast("long").alias("g_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
