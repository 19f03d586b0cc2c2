"""Quality rules: base rules, then distribution divergence from references of the document's language.

A document's character classes and its counts of common words are set against the mean distributions of all
long enough documents of its language. A document goes if the Jensen-Shannon distance (base 2, square root, so 0 to 1)
of its characters is far, or if those of its characters and its words both are. All of it is column arithmetic: texts are measured once and
their measures written, then one aggregation with one row for each language, and a join with that table.

Defined cases: a null or empty text has no words and fails the base rules. Documents whose language is null or seen in fewer than
`min_reference` long enough documents are compared with the characters of all documents; without as many of these the base
rules alone judge. Words are compared where COMMON_WORDS lists the language. Histograms of fewer than `min_chars` characters or `min_tokens` words aren't
compared (too short to tell). Repeated rows are judged alike, each for itself. Columns of the input whose names
clash with results give way to the results in `score`; `keep` returns the input's columns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspark.llm.common import HELD, SPACE, apart, read, stored, together, whole, words_of

# Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "are", "this", "be"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "sur"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
#: Character classes after ASCII lower case and space, counted in this order, each in what the earlier ones left; what remains is "symbol".
CLASSES = {"lower": r"\p{Ll}+", "upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "point": r"[.,;:'\"?!()-]+"}
PLAIN = r"[a-z\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"

#: Languages whose references are broadcast; with more the join shuffles.
BROADCAST_LANGUAGES = 10_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_CHARS, MIN_TOKENS, MIN_REFERENCE = 200, 80, 20
#: Beyond the first the characters alone reject; beyond both of the others characters and words together do.
MAX_CHAR_DISTANCE, JOINT_CHAR_DISTANCE, JOINT_WORD_DISTANCE = 0.25, 0.14, 0.22


def char_counts(df: DataFrame) -> DataFrame:
    """Adds q_chars (counts by class), q_n_chars, q_word_chars and q_symbols from q_text and q_words."""
    df = df.withColumns({"q_n_chars": F.length("q_text"), "q_word_chars": F.length(F.array_join("q_words", "")), "q_rest": F.regexp_replace("q_text", PLAIN, "")})
    left, counts = "q_rest", []
    for k, pattern in CLASSES.items():
        df = df.withColumn(f"q_no_{k}", F.regexp_replace(left, pattern, ""))
        counts.append((F.length(left) - F.length(f"q_no_{k}")).cast("double"))
        left = f"q_no_{k}"
    space = F.col("q_n_chars") - F.col("q_word_chars")
    plain = F.col("q_n_chars") - F.length("q_rest") - space
    counts = [plain + counts[0], space.cast("double"), *counts[1:], F.length(left).cast("double")]
    df = df.withColumns({"q_chars": F.array(*counts), "q_symbols": F.length("q_no_lower") - F.length(F.regexp_replace("q_no_lower", SYMBOLS, ""))})
    return df.drop("q_rest", *(f"q_no_{k}" for k in CLASSES))


def common_counts(df: DataFrame) -> DataFrame:
    """Adds q_common from q_words: counts of the language's common words as they stand, then the other words; null without a list."""
    lists = F.create_map(*(x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    df = df.withColumn("q_list", F.when(F.col("lang").isin(*COMMON_WORDS), F.element_at(lists, F.col("lang"))))
    df = df.withColumn("q_hits", F.filter("q_words", lambda t: F.array_contains("q_list", t)))
    counts = F.transform("q_list", lambda w: (F.size("q_hits") - F.size(F.array_remove("q_hits", w))).cast("double"))
    return df.withColumn("q_common", F.concat(counts, F.array((F.size("q_words") - F.size("q_hits")).cast("double")))).drop("q_list", "q_hits")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of equal length."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def histograms(docs: DataFrame, min_chars: int, min_tokens: int) -> DataFrame:
    """docs with words, counts, and the shares of both histograms; shares are null where the text is too short."""
    df = docs.withColumn("q_text", whole())
    df = common_counts(char_counts(df.withColumn("q_words", words_of(F.col("q_text"))))).withColumn("q_n", F.size("q_words"))
    chars = F.transform("q_chars", lambda x: x / F.col("q_n_chars"))
    words = F.transform("q_common", lambda x: x / F.col("q_n"))
    return df.withColumns({"q_char_shares": F.when(F.col("q_n_chars") >= max(min_chars, 1), chars), "q_word_shares": F.when(F.col("q_n") >= max(min_tokens, 1), words)})


def references(measured: DataFrame, min_tokens: int = MIN_TOKENS, min_reference: int = MIN_REFERENCE) -> tuple[DataFrame, DataFrame]:
    """From histograms() with lang, a row for each language: the mean shares over all its documents of sufficient length; and one row, or none, of the mean
    shares of characters over the documents of all languages, null too."""
    n_char, n_word = len(CLASSES) + 2, len(next(iter(COMMON_WORDS.values()))) + 1
    long_enough = F.col("q_char_shares").isNotNull() & (F.col("q_n") >= max(min_tokens, 1))
    h = measured.select(F.col("lang").alias("q_lang"), F.when(long_enough, F.concat("q_char_shares", F.coalesce("q_word_shares", F.array().cast("array<double>")))).alias("b"))
    mean = [F.avg(F.get("b", F.lit(i))).alias(f"m{i}") for i in range(n_char + n_word)]
    r = h.groupBy("q_lang").agg(F.count("b").alias("q_seen"), *mean, *(F.sum(F.get("b", F.lit(i))).alias(f"s{i}") for i in range(n_char)))
    r = stored(r, "language-references")
    every = r.agg(*((F.sum(f"s{i}") / F.sum("q_seen")).alias(f"m{i}") for i in range(n_char)), F.sum("q_seen").alias("q_seen")).filter(F.col("q_seen") >= min_reference)
    chars = lambda: F.array(*(f"m{i}" for i in range(n_char)))
    words = F.when(F.col("q_lang").isin(*COMMON_WORDS), F.array(*(f"m{i}" for i in range(n_char, n_char + n_word))))
    own = r.filter((F.col("q_seen") >= min_reference) & F.col("q_lang").isNotNull()).select("q_lang", chars().alias("q_ref_chars"), words.alias("q_ref_words"))
    return own, every.select(chars().alias("q_all_chars"))


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds q_repeat_words from q_words: words that lie in a window of three that the text has twice or more, exactly.

    Windows are first sorted by 31 bits of a hash with the position beside it; only windows with an equal
    neighbour, few in most texts, are then sorted and compared as strings.
    """
    df = df.withColumn("q_hashes", F.transform("q_words", lambda w: F.xxhash64(w)))
    at = lambda i: F.get("q_hashes", i)
    packed = lambda x, i: x.bitwiseXOR(F.shiftleft(at(i + 1), 1)).bitwiseXOR(F.shiftleft(at(i + 2), 2)).bitwiseAND(F.lit(0x7FFFFFFF00000000)).bitwiseOR(i.cast("long"))
    df = df.withColumn("q_sorted", F.sort_array(F.transform("q_hashes", packed)))
    df = df.withColumn("q_pairs", F.filter(F.transform("q_sorted", lambda x, i: F.when(x.bitwiseXOR(F.get("q_sorted", i + 1)) < 0x100000000, i)), lambda i: i.isNotNull()))
    place = lambda i: F.get("q_sorted", i).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    df = df.withColumn("q_likely", F.array_distinct(F.flatten(F.transform("q_pairs", lambda i: F.array(place(i), place(i + 1))))))
    window = lambda p: F.struct(F.concat_ws(" ", F.get("q_words", p), F.get("q_words", p + 1), F.get("q_words", p + 2)).alias("g"), p.alias("p"))
    df = df.withColumn("q_windows", F.sort_array(F.transform("q_likely", window)))
    gram = lambda i: F.get("q_windows", i).getField("g")
    place = lambda i: F.get("q_windows", i).getField("p")
    same = F.filter(F.transform("q_windows", lambda x, i: F.when(x.getField("g") == gram(i + 1), F.array(x.getField("p"), place(i + 1)))), lambda x: x.isNotNull())
    df = df.withColumn("q_at", F.sort_array(F.array_distinct(F.flatten(same))))
    covered = F.transform("q_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("q_at", i + 1) - p, F.lit(3))))
    df = df.withColumn("q_repeat_words", F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long"))
    return df.drop("q_hashes", "q_sorted", "q_pairs", "q_likely", "q_windows", "q_at")


#: What a text's measuring gives; nothing after it looks at texts.
MEASURES = ["q_n", "q_word_chars", "q_symbols", "q_dup_lines", "q_repeat_words", "q_char_shares", "q_word_shares"]


def score(docs: DataFrame, min_chars: int = MIN_CHARS, min_tokens: int = MIN_TOKENS, min_reference: int = MIN_REFERENCE, max_char_distance: float = MAX_CHAR_DISTANCE, joint_char_distance: float = JOINT_CHAR_DISTANCE, joint_word_distance: float = JOINT_WORD_DISTANCE, columns: list[str] | None = None) -> DataFrame:
    """docs, all columns or those named, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance and kept."""
    columns = docs.columns if columns is None else columns
    df = histograms(apart(docs, "text", "lang", columns=columns), min_chars, min_tokens)
    df = with_repeats(df.withColumn("q_lines", F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    df = df.withColumn("q_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
    df = stored(df.select("lang", *(c for c in df.columns if c.endswith(f"_{HELD}")), *MEASURES), "measures")
    refs, all_ = references(df, min_tokens, min_reference)
    refs = refs.hint("broadcast" if refs.count() <= BROADCAST_LANGUAGES else "merge")
    df = df.join(refs, F.col("lang") == F.col("q_lang"), "left").join(F.broadcast(all_), how="left")  # one row
    df = df.withColumn("q_ref_chars", F.coalesce("q_ref_chars", "q_all_chars"))
    df = df.withColumns(
        {
            "q_char_distance": js_distance(F.col("q_char_shares"), F.col("q_ref_chars")),
            "q_word_distance": js_distance(F.col("q_word_shares"), F.col("q_ref_words")),
        }
    )
    df = df.withColumn("q_failed", (F.col("q_n") < MIN_WORDS) | (100 * F.col("q_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n")))
    far = F.coalesce(F.col("q_char_distance") > max_char_distance, F.lit(False)) | F.coalesce((F.col("q_char_distance") > joint_char_distance) & (F.col("q_word_distance") > joint_word_distance), F.lit(False))
    return together(
        df, columns, n_words=F.col("q_n").cast("long"), word_chars=F.col("q_word_chars").cast("long"), n_symbols=F.col("q_symbols").cast("long"), n_dup_lines=F.col("q_dup_lines"), n_repeat_words=F.col("q_repeat_words"),
        base_failed=F.col("q_failed"), char_distance=F.col("q_char_distance"), word_distance=F.col("q_word_distance"), kept=~F.col("q_failed") & ~far,
    )


def keep(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that pass, with the input's own columns."""
    columns = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(docs.columns)]
    marked = score(docs.select("text", "lang", *columns), columns=[f"kept_{i}" for i in range(len(columns))], **parameters)
    # The row number keeps the verdict's columns from being copied into a filter below them, again and again
    marked = marked.withColumn("q_row", F.monotonically_increasing_id()).filter(F.col("kept") & (F.col("q_row") >= 0))
    return marked.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), columns=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


DISTANCE = "sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN {p}[i] > 0 THEN {p}[i] * log2({p}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END + CASE WHEN {q}[i] > 0 THEN {q}[i] * log2({q}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END)) / 2, 0))"
SQL = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
a AS (SELECT *, len(w) AS n, length(array_to_string(w, '')) AS word_chars, regexp_replace(t, '{PLAIN}', '', 'g') AS r0 FROM d),
b AS (SELECT *, regexp_replace(r0, '\\p{{Ll}}+', '', 'g') AS r1 FROM a), c AS (SELECT *, regexp_replace(r1, '\\p{{Lu}}+', '', 'g') AS r2 FROM b),
e AS (SELECT *, regexp_replace(r2, '\\p{{Nd}}+', '', 'g') AS r3 FROM c), f AS (SELECT *, regexp_replace(r3, '[.,;:''"?!()-]+', '', 'g') AS r4 FROM e),
g AS (SELECT *, CASE lang {" ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in COMMON_WORDS.items())} END AS l,
  CASE WHEN length(t) >= {MIN_CHARS} THEN list_transform([length(t) - length(r0) - (length(t) - word_chars) + length(r0) - length(r1), length(t) - word_chars, length(r1) - length(r2), length(r2) - length(r3), length(r3) - length(r4), length(r4)], lambda x: x / length(t)::DOUBLE) END AS cs FROM f),
h AS (SELECT *, list_transform(l, lambda x: len(list_filter(w, lambda y: y = x))) AS hits FROM g),
s AS (SELECT *, CASE WHEN n >= {MIN_TOKENS} THEN list_transform(list_append(hits, n - list_sum(hits)), lambda x: x / n::DOUBLE) END AS ws FROM h),
u AS (SELECT lang, i.range AS i, avg(list_concat(cs, ws)[i.range]) AS m, count(*) AS k FROM s, range(1, {len(CLASSES) + 2 + len(COMMON_WORDS["en"]) + 1 + 1}) i WHERE cs IS NOT NULL AND n >= {MIN_TOKENS} GROUP BY ALL),
r AS (SELECT lang, list(m ORDER BY i) AS m FROM u WHERE lang IS NOT NULL GROUP BY lang HAVING min(k) >= {MIN_REFERENCE}),
al AS (SELECT list(m ORDER BY i) AS am FROM (SELECT i.range AS i, avg(cs[i.range]) AS m, count(*) AS k FROM s, range(1, {len(CLASSES) + 3}) i WHERE cs IS NOT NULL AND n >= {MIN_TOKENS} GROUP BY ALL) HAVING min(k) >= {MIN_REFERENCE}),
x AS (SELECT doc_id, w, unnest(range(0, n - 2)) AS i FROM a WHERE n >= 3), y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) AS k FROM x),
z AS (SELECT doc_id, count(DISTINCT i + j.range) AS k FROM y, range(0, 3) j WHERE k > 1 GROUP BY doc_id),
o AS (SELECT s.*, coalesce(z.k, 0) AS n_repeat, list_filter(string_split(t, chr(10)), lambda v: regexp_matches(v, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(m[:{len(CLASSES) + 2}], am) AS mc, CASE WHEN l IS NOT NULL THEN m[{len(CLASSES) + 3}:] END AS mw FROM s LEFT JOIN r USING (lang) LEFT JOIN z USING (doc_id) LEFT JOIN al ON true),
q AS (SELECT *, n < {MIN_WORDS} OR 100 * n_repeat > {MAX_REPEAT_PERCENT} * n AS failed, {DISTANCE.format(p="cs", q="mc")} AS cd, {DISTANCE.format(p="ws", q="mw")} AS wd FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(length(r1) - length(regexp_replace(r1, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(n_repeat AS BIGINT) AS n_repeat_words, failed AS base_failed, NOT failed AND NOT coalesce(cd > {MAX_CHAR_DISTANCE}, false) AND NOT coalesce(cd > {JOINT_CHAR_DISTANCE} AND wd > {JOINT_WORD_DISTANCE}, false) AS kept FROM q
"""
