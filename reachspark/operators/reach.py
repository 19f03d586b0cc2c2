"""Statistics of logs, prefixes by spend or impressions, and k+ reach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachspark.functions.joins import beside
from reachspark.sources.scratch import kept

K = 10


def publisher_stats(log: DataFrame) -> DataFrame:
    """dataset, publisher, pub_idx, impressions, max_spend, reach."""
    people = log.groupBy("dataset", "publisher", "pub_idx", "vid").agg(F.count("*").alias("n"), F.max("spend").alias("s"))
    return people.groupBy("dataset", "publisher", "pub_idx").agg(F.sum("n").alias("impressions"), F.max("s").alias("max_spend"), F.count("*").alias("reach"))


def dataset_stats(log: DataFrame) -> DataFrame:
    """dataset, publishers, reach, universe (twice the reach), max_publisher_reach."""
    total = log.select("dataset", "vid").distinct().groupBy("dataset").agg(F.count("*").alias("reach"))
    by = publisher_stats(log).groupBy("dataset").agg(F.count("*").alias("publishers"), F.max("reach").alias("max_publisher_reach"))
    return by.join(total, "dataset").select("dataset", "publishers", "reach", (2 * F.col("reach")).alias("universe"), "max_publisher_reach")


def frequency_moments(log: DataFrame) -> DataFrame:
    """Mean and population variance of impressions a person, by publisher."""
    f = log.groupBy("dataset", "publisher", "vid").agg(F.count("*").alias("f"))
    return f.groupBy("dataset", "publisher").agg(F.avg("f").alias("mean"), F.var_pop("f").alias("variance"))


def with_fractions(publishers: DataFrame, fractions: list[float]) -> DataFrame:
    """Gives publishers a spend fraction each, going round the list."""
    return publishers.withColumn("fraction", F.element_at(F.array(*map(F.lit, fractions)), (F.col("pub_idx") % len(fractions) + 1).cast("int")))


def campaign_spend(log: DataFrame, fractions: list[float]) -> DataFrame:
    """dataset, publisher, pub_idx, spend_limit: a fraction of each publisher's greatest spend."""
    return share_of_spend(log.groupBy("dataset", "publisher", "pub_idx").agg(F.max("spend").alias("max_spend")), fractions)


def share_of_spend(top: DataFrame, fractions: list[float]) -> DataFrame:
    """campaign_spend where the greatest spends (dataset, publisher, pub_idx, max_spend) are known."""
    return with_fractions(top, fractions).select("dataset", "publisher", "pub_idx", (F.col("fraction") * F.col("max_spend")).alias("spend_limit"))


def within(log: DataFrame, limits: DataFrame) -> DataFrame:
    """The impressions that a spend_limit for each publisher buys."""
    return beside(log, limits.select("dataset", "publisher", "spend_limit"), ["dataset", "publisher"]).filter("spend <= spend_limit").drop("spend_limit")


def within_impressions(log: DataFrame, limits: DataFrame) -> DataFrame:
    """The first impressions of each publisher, as many as its impression_limit."""
    return beside(log, limits.select("dataset", "publisher", "impression_limit"), ["dataset", "publisher"]).filter("seq <= impression_limit").drop("impression_limit")


def spend_by_impressions(log: DataFrame, points: DataFrame) -> DataFrame:
    """points (dataset, publisher, impressions) with the spend of the last of them: 0 for none, at most the whole."""
    total = log.groupBy("dataset", "publisher").agg(F.max("seq").alias("n"))
    at = points.join(total, ["dataset", "publisher"]).withColumn("seq", F.least("impressions", "n"))
    return at.join(log.select("dataset", "publisher", "seq", "spend"), ["dataset", "publisher", "seq"], "left").select("dataset", "publisher", "impressions", F.coalesce("spend", F.lit(0.0)).alias("spend"))


def impressions_by_spend(log: DataFrame, points: DataFrame) -> DataFrame:
    """points (dataset, publisher, spend) with the impressions bought; all points of a publisher in one pass over it."""
    lists = kept(points.groupBy("dataset", "publisher").agg(F.sort_array(F.collect_set("spend")).alias("at")), "spends")
    place = F.size(F.filter("at", lambda p: p < F.col("spend")))
    step = beside(log, lists, ["dataset", "publisher"]).groupBy("dataset", "publisher", place.alias("i")).agg(F.count("*").alias("n"))
    each = lists.select("dataset", "publisher", F.posexplode("at").alias("j", "spend"))
    sums = each.join(step, ["dataset", "publisher"], "left").groupBy("dataset", "publisher", "spend").agg(F.coalesce(F.sum(F.when(F.col("i") <= F.col("j"), F.col("n"))), F.lit(0)).alias("impressions"))
    return points.join(sums, ["dataset", "publisher", "spend"])


def user_counts(prefix: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Impressions f of each person of a prefix."""
    return prefix.groupBy(*keys, "vid").agg(F.count("*").alias("f"))


def kplus(counts: DataFrame, keys: tuple[str, ...] = ("dataset",), most: int = K) -> DataFrame:
    """keys, k, reach for k = 1..most from (keys, vid, f). People are counted in the tasks before anything is shuffled."""
    wide = counts.groupBy(*keys).agg(*(F.count_if(F.col("f") >= k).alias(f"k{k}") for k in range(1, most + 1)))
    return wide.select(*keys, F.posexplode(F.array(*(f"k{k}" for k in range(1, most + 1)))).alias("p", "reach")).select(*keys, (F.col("p") + 1).cast("long").alias("k"), "reach")


def histogram(counts: DataFrame, keys: tuple[str, ...] = ("dataset",), most: int = K) -> DataFrame:
    """keys, f, users for f = 1..most; the last bucket holds all from there on, empty ones are 0."""
    level = F.least(F.col("f"), F.lit(most))
    wide = counts.groupBy(*keys).agg(*(F.count_if(level == k).alias(f"k{k}") for k in range(1, most + 1)))
    return wide.select(*keys, F.posexplode(F.array(*(f"k{k}" for k in range(1, most + 1)))).alias("p", "users")).select(*keys, (F.col("p") + 1).cast("long").alias("f"), "users")


def kplus_from_histogram(h: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    up = Window.partitionBy(*keys).orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, 0)
    return h.select(*keys, F.col("f").alias("k"), F.sum("users").over(up).alias("reach"))


def histogram_from_kplus(r: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    after = F.lead("reach", 1, 0).over(Window.partitionBy(*keys).orderBy("k"))
    return r.select(*keys, F.col("k").alias("f"), (F.col("reach") - after).alias("users"))


def reach_at(kplus_array: Column, k: int) -> Column:
    """The k-th k+ value of an array; an error if there are fewer."""
    return F.when(F.size(kplus_array) >= k, F.get(kplus_array, F.lit(k - 1))).otherwise(F.raise_error(F.lit(f"no reach at frequency {k}")))


def with_unreached(h: DataFrame, universe: DataFrame) -> DataFrame:
    """A histogram (dataset, f, users) with a row f = 0 for the people of (dataset, universe) not reached; none known is an error."""
    reached = h.groupBy("dataset").agg(F.sum("users").alias("r")).join(universe, "dataset", "left")
    known = F.when(F.col("universe").isNull(), F.raise_error(F.lit("universe size unknown"))).otherwise(F.col("universe"))
    return h.select("dataset", "f", "users").union(reached.select("dataset", F.lit(0).cast("long"), known - F.col("r")))


def normalized(h: DataFrame) -> DataFrame:
    return h.select("dataset", "f", (F.col("users") / F.sum("users").over(Window.partitionBy("dataset"))).alias("share"))


def max_nonzero_frequency(r: DataFrame) -> DataFrame:
    return r.groupBy("dataset").agg(F.coalesce(F.max(F.when(F.col("reach") > 0, F.col("k"))), F.lit(0)).alias("max_frequency"))


def impressions_of(h: DataFrame) -> DataFrame:
    return h.groupBy("dataset").agg(F.sum(F.col("f") * F.col("users")).alias("impressions"))


def check_vector(publishers: DataFrame, vector: list[float]) -> None:
    """A vector needs as many values as there are publishers; they are few, so this looks at once."""
    n = publishers.count()
    if len(vector) != n:
        raise ValueError(f"{len(vector)} values for {n} publishers")


def reach_curve(log: DataFrame, points: DataFrame, most: int = K) -> DataFrame:
    """dataset, publisher, spend, k, reach at every point (dataset, publisher, spend).

    A person counts for k from the spend of their k-th impression on. So those are found once, counted between points, and
    summed up along the points: no point costs another pass."""
    lists = kept(points.groupBy("dataset", "publisher").agg(F.sort_array(F.collect_set("spend")).alias("at")), "spends")
    nth = F.row_number().over(Window.partitionBy("dataset", "publisher", "vid").orderBy("spend", "seq"))
    steps = beside(log.withColumn("k", nth.cast("long")).filter(F.col("k") <= most), lists, ["dataset", "publisher"])
    steps = steps.groupBy("dataset", "publisher", "k", F.size(F.filter("at", lambda p: p < F.col("spend"))).alias("i")).agg(F.count("*").alias("n"))
    each = lists.select("dataset", "publisher", F.posexplode("at").alias("j", "spend"), F.sequence(F.lit(1).cast("long"), F.lit(most).cast("long")).alias("ks"))
    each = each.select("dataset", "publisher", "j", "spend", F.explode("ks").alias("k"))
    both = each.join(steps, ["dataset", "publisher", "k"], "left")
    return both.groupBy("dataset", "publisher", "spend", "k").agg(F.coalesce(F.sum(F.when(F.col("i") <= F.col("j"), F.col("n"))), F.lit(0)).alias("reach"))


def signatures(log: DataFrame, lists: DataFrame, most: int = K) -> DataFrame:
    """dataset, signature, people: how many people have the same impressions as far as points can tell, from a log and
    lists (dataset, publisher, no, at): the number of a publisher and its points' spends in order.

    A signature lists (no, i, n): n impressions of a publisher between its points i - 1 and i. Beyond the last point, and from a
    publisher's `most`-th impression on, nothing changes any k+ reach, so a person that ads reach often is like others."""
    place = F.size(F.filter("at", lambda p: p < F.col("spend")))
    seen = beside(log, lists, ["dataset", "publisher"]).withColumn("i", place).filter(F.col("i") < F.size("at"))
    held = seen.groupBy("dataset", "vid", "no", "i").agg(F.count("*").alias("n")).repartition("dataset", "vid")  # counted before, so that no person is a task's work
    before = F.coalesce(F.sum("n").over(Window.partitionBy("dataset", "vid", "no").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("n", F.least(F.col("n"), F.lit(most) - before)).filter(F.col("n") > 0)
    people = held.groupBy("dataset", "vid").agg(F.sort_array(F.collect_list(F.struct("no", "i", F.col("n").cast("int").alias("n")))).alias("signature"))
    return people.groupBy("dataset", "signature").agg(F.count("*").alias("people"))


def reach_at_points(log: DataFrame, points: DataFrame, most: int = K) -> DataFrame:
    """dataset, point_id, k, reach of all publishers together at many spend vectors (dataset, point_id, publisher, spend).

    Only signatures meet points, once each: what is shuffled after that is a row for each point and task. Points of one
    publisher alone are read off its curve."""
    numbered = F.row_number().over(Window.partitionBy("dataset").orderBy("publisher"))  # a row for each publisher
    lists = points.groupBy("dataset", "publisher").agg(F.sort_array(F.collect_set("spend")).alias("at")).withColumn("no", numbered)
    lists = kept(lists.withColumn("p", F.max("no").over(Window.partitionBy("dataset"))), "spends")
    alone, together = (bool(lists.filter(c).head(1)) for c in ("p = 1", "p > 1"))
    out = []
    if alone:
        few = points.join(lists.filter("p = 1").select("dataset"), "dataset", "left_semi")
        curve = reach_curve(log, few.select("dataset", "publisher", "spend").distinct(), most)
        out.append(few.join(curve, ["dataset", "publisher", "spend"]).select("dataset", "point_id", "k", "reach"))
    if together:
        lists = lists.filter("p > 1")
        found = signatures(log, lists.select("dataset", "publisher", "no", "at"), most)
        place = F.size(F.filter("at", lambda p: p < F.col("spend")))
        at = points.join(lists, ["dataset", "publisher"]).groupBy("dataset", "point_id", "p").agg(F.map_from_entries(F.collect_list(F.struct("no", place.alias("j")))).alias("js"))
        at = kept(at.select("dataset", "point_id", F.transform(F.sequence(F.lit(1), "p"), lambda x: F.coalesce(F.element_at("js", x), F.lit(-1))).alias("js")), "points")
        f = F.aggregate("signature", F.lit(0), lambda a, e: a + F.when(e["i"] <= F.get("js", e["no"] - 1), e["n"]).otherwise(0))
        both = beside(found, at, ["dataset"]).select("dataset", "point_id", "people", f.alias("f"))
        wide = both.groupBy("dataset", "point_id").agg(*(F.sum(F.when(F.col("f") >= k, F.col("people")).otherwise(0)).alias(f"k{k}") for k in range(1, most + 1)))
        every = at.select("dataset", "point_id").join(wide, ["dataset", "point_id"], "left")
        rows = every.select("dataset", "point_id", F.posexplode(F.array(*(F.coalesce(f"k{k}", F.lit(0)) for k in range(1, most + 1)))).alias("k", "reach"))
        out.append(rows.select("dataset", "point_id", (F.col("k") + 1).cast("long").alias("k"), "reach"))
    none = points.limit(0).select("dataset", "point_id", F.lit(1).cast("long").alias("k"), F.lit(0).cast("long").alias("reach"))
    return reduce(DataFrame.unionByName, out) if out else none
