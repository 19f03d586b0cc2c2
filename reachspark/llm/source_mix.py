"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source documents are ranged by key, word counts are summed
along that order (sums of key ranges first, then inside each range, so a hot source is spread), and the source
is cut where its budget is spent. A budget of more than the source repeats it: whole epochs, then a cut.

Defined cases: a null or empty text has size 0 and is taken 0 times. A null source is a source of its own, last in
the order. Rows of equal doc_id and text share a key, others don't, though doc_ids are equal or null; where the cut
falls among such copies each takes an equal part, rounded down, of what is left, so the source takes less than its target by fewer words
than there are copies. An empty table gives an empty result. Result columns replace input columns
of the same name. Reruns agree, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachspark.llm.common import apart, read, stored, together, whole, words_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Documents in a key range, about; sums inside a range are one task's work.
RANGE_ROWS = 4096
#: Sources whose cuts may be broadcast; with more of them the join shuffles.
BROADCAST_SOURCES = 20_000


def keyed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with m_size and m_key, the random order within a source."""
    df = docs.withColumn("m_size", F.size(words_of(whole())).cast("long"))  # docs has no columns m_ of its own
    return df.withColumn("m_key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.md5(whole()))))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size): target words. Weights go round in the order of sources; what a source can't take is
    shared again by weight. Sources with the least room for their weight fill up first, so one pass in that order finds
    the level at which all is shared. It works on one row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("place", (F.row_number().over(order) - 1) % len(weights))
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") + 1))
    w = w.withColumn("most", (max_epochs * F.col("source_size")).cast("double")).withColumn("room", F.col("most") / F.col("weight"))
    full = Window.orderBy("room", F.col("source").asc_nulls_last())
    w = w.withColumns({"before": F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "open": F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)), "total": F.sum("source_size").over(Window.partitionBy())})
    w = w.withColumn("level", (F.col("total") - F.col("before")) / F.col("open"))
    w = w.withColumn("capped", F.col("room") <= F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct("room", "level"))).over(Window.partitionBy()).getField("level")
    w = w.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * level))
    return w.select("source", "source_size", F.round("target", 3).alias("target"))


def cuts(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """For each source: target, whole epochs, the key at which the last epoch is cut, and the words each row there gives."""
    rows = stored(keyed(docs.select("doc_id", "text", "source"), seed).groupBy("source", "m_key").agg(F.sum("m_size").alias("m_size"), F.count("*").alias("m_rows")), "mix-keys")
    per = rows.groupBy("source").agg(F.sum("m_size").alias("source_size"), F.count("*").alias("m_n"))
    plan = targets(per.select("source", "source_size"), weights, max_epochs).join(per.withColumnRenamed("source", "p_source").select("p_source", "m_n"), F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    budget = F.floor(F.col("target") + 0.5)
    plan = plan.withColumns({"m_epochs": F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"), "m_ranges": F.ceil(F.col("m_n") / range_rows).cast("long")})
    plan = stored(plan.withColumn("m_left", (budget - F.col("m_epochs") * F.col("source_size")).cast("long")), "mix-plan")
    # The range of a key needs its source's number of ranges; one row for each source, so Spark may broadcast it
    n = F.conv(F.substring("m_key", 1, 8), 16, 10).cast("long")
    small = plan.select(F.col("source").alias("p_source"), "m_ranges", "m_left").hint("broadcast" if plan.count() <= BROADCAST_SOURCES else "shuffle_hash")
    ranged = rows.join(small, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    ranged = ranged.withColumn("m_range", F.floor(n * F.col("m_ranges") / F.lit(4294967296)))
    sums = ranged.groupBy("source", "m_range").agg(F.sum("m_size").alias("m_sum"), F.first("m_left").alias("m_left"))
    along = Window.partitionBy("source").orderBy("m_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("m_before", F.coalesce(F.sum("m_sum").over(along), F.lit(0)))
    # The cut lies in the one range where the sum passes what is left; only that range is summed row by row
    at = sums.filter((F.col("m_before") <= F.col("m_left")) & (F.col("m_left") < F.col("m_before") + F.col("m_sum"))).select(F.col("source").alias("c_source"), F.col("m_range").alias("c_range"), "m_before")
    inside = ranged.join(at, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("m_range") == F.col("c_range")))
    step = Window.partitionBy("source", "m_range").orderBy("m_key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("m_run", F.col("m_before") + F.coalesce(F.sum("m_size").over(step), F.lit(0)))
    cut = inside.filter((F.col("m_run") <= F.col("m_left")) & (F.col("m_left") < F.col("m_run") + F.col("m_size")))
    cut = cut.select(F.col("source").alias("c_source"), F.col("m_key").alias("m_cut"), F.floor((F.col("m_left") - F.col("m_run")) / F.col("m_rows")).alias("m_part"))
    out = plan.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left")
    return stored(out.select(F.col("source").alias("c_source"), F.col("source_size").alias("m_source_size"), F.col("target").alias("m_target"), "m_epochs", "m_cut", "m_part"), "mix-cuts")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs with size, source_size, target, taken (words the mix takes), epochs (whole repeats) and part (words of a last, shorter one)."""
    table = cuts(docs, weights, max_epochs, seed, range_rows)
    table = table.hint("broadcast" if table.count() <= BROADCAST_SOURCES else "shuffle_hash")
    df = keyed(apart(docs, "doc_id", "text", "source"), seed).join(table, F.col("source").eqNullSafe(F.col("c_source")), "left")
    last = F.when(F.col("m_cut").isNull(), 0).when(F.col("m_key") < F.col("m_cut"), F.col("m_size")).when(F.col("m_key") == F.col("m_cut"), F.least("m_part", "m_size")).otherwise(0).cast("long")
    taken = F.col("m_epochs") * F.col("m_size") + last
    return together(df, docs.columns, size=F.col("m_size"), source_size=F.col("m_source_size"), target=F.col("m_target"), taken=taken, epochs=F.col("m_epochs"), part=last)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS hash FROM documents),
k AS (SELECT *, md5(concat_ws(':', 'mix-1', CAST(doc_id AS VARCHAR), hash)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS most FROM s),
r AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (total - before) / rest AS level, most / weight <= (total - before) / rest AS capped FROM r),
t AS (SELECT source, source_size, round(CASE WHEN capped THEN most ELSE weight * (SELECT arg_min(level, most / weight) FROM l WHERE NOT capped) END, 3) AS target FROM l),
g AS (SELECT source, key, sum(size) AS size, count(*) AS n FROM k GROUP BY source, key),
c AS (SELECT source, key, size, n, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
e AS (SELECT *, floor(target + 0.5) AS budget, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size) ELSE 0 END AS epochs FROM t)
SELECT k.doc_id, k.size, e.source_size, e.target,
  CAST(e.epochs * k.size + CASE WHEN c.before + c.size <= e.budget - e.epochs * e.source_size THEN k.size
    WHEN c.before >= e.budget - e.epochs * e.source_size THEN 0
    ELSE least(k.size, floor((e.budget - e.epochs * e.source_size - c.before) / c.n)) END AS BIGINT) AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.key = c.key
"""
