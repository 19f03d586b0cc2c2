"""Impression logs: reading and writing them, and taking other tables for logs.

A log has the columns dataset, publisher, pub_idx (0-based, by name), seq (order among ties), vid, spend (cumulative).
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachspark.functions.joins import beside
from reachspark.functions.ranking import ranked
from reachspark.sources.scratch import kept, scratch

SCHEMA = "vid BIGINT, spend DOUBLE"
#: Cost of an impression where a table has none.
COST = 0.1


def with_publisher_index(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Adds pub_idx, the place of a publisher's name among those of its data set (names are looked up in `of`, or in df)."""
    names = (df if of is None else of).select("dataset", "publisher").distinct()
    index = names.withColumn("pub_idx", (F.row_number().over(Window.partitionBy("dataset").orderBy("publisher")) - 1).cast("int"))
    return beside(df, index, ["dataset", "publisher"])


def log_from(df: DataFrame, dataset, publisher: str, vid: str, day, order: list[str]) -> DataFrame:
    """Takes the rows of a table for impressions at a fixed cost, ordered by day and then by `order`."""
    rows = df.select(F.lit(dataset).alias("dataset") if isinstance(dataset, str) else dataset.alias("dataset"), F.col(publisher).alias("publisher"), F.col(vid).cast("long").alias("vid"), day.alias("day"), *order)
    log = ranked(rows, ["dataset", "publisher"], F.col("day"), order, "seq").drop("day", *order)
    log = with_publisher_index(log.withColumn("spend", F.col("seq") * F.lit(COST)), rows)  # the names need no ranks
    return log.select("dataset", "publisher", "pub_idx", "seq", "vid", "spend")


def greatest_spends(df: DataFrame, dataset, publisher: str) -> DataFrame:
    """dataset, publisher, pub_idx, max_spend of the log that log_from makes: known from counts, without ranking a row."""
    name = F.lit(dataset) if isinstance(dataset, str) else dataset
    n = df.groupBy(name.alias("dataset"), F.col(publisher).alias("publisher")).agg(F.count("*").alias("n"))
    index = F.row_number().over(Window.partitionBy("dataset").orderBy("publisher")) - 1  # a row for each publisher
    return n.select("dataset", "publisher", index.cast("int").alias("pub_idx"), (F.col("n") * F.lit(COST)).alias("max_spend"))


def log_from_orders(spark: SparkSession, sf_dir: str, by_year: bool = False) -> DataFrame:
    """orders as a log: priorities are publishers, customers are people; one data set, or one for each year."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return log_from(orders, F.year("o_orderdate").cast("string") if by_year else "orders", "o_orderpriority", "o_custkey", F.to_date("o_orderdate"), ["o_orderdate", "o_orderkey"])


def log_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: event types are publishers, users are people."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    return log_from(events, "events", "event_type", "user_id", F.to_date("ts"), ["ts", "event_id"])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A headerless file of vid,spend; a malformed line ends the query."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").csv(path)


def read_bad_rows(spark: SparkSession, path: str) -> DataFrame:
    """The malformed lines under path: file, line (its number in the file), bad (the line).

    A line's number is its place in its split and the lines of the splits before, which are counted."""
    parsed = F.from_csv("value", SCHEMA + ", broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("bad"), parsed.alias("row"))
    df = kept(df.select("file", "split", "at", F.when(F.col("row.broken").isNotNull(), F.col("bad")).alias("bad")), "lines")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = df.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first")).select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # rows of a split have successive numbers: a split is read by one task, in order
    return df.filter("bad is not null").join(splits, ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "bad")


def publisher_of(path: Column) -> Column:
    """The publisher that a file stands for: what its folder says (publisher=name), or its name without endings."""
    folder = F.regexp_extract(path, r"/publisher=([^/]*)/", 1)
    return F.when(folder != "", F.url_decode(folder)).otherwise(F.regexp_extract(F.url_decode(path), r"([^/]*?)(\.[a-z]+)*$", 1))


def read_dataset(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Every file of a directory (or every folder publisher=name) as one publisher, named and indexed by that name. Ties in spend are ordered by vid."""
    df = spark.read.schema(SCHEMA).option("mode", "FAILFAST").option("recursiveFileLookup", True).csv(path).select(F.lit(dataset).alias("dataset"), publisher_of(F.col("_metadata.file_path")).alias("publisher"), "vid", "spend")
    top = df.groupBy("dataset", "publisher").agg(F.max("spend").alias("top"), F.count("*").alias("n"))
    # Ranges of about a thousand impressions each if spend is even; any spend there is, below 1 too, is spread
    share = F.when(F.col("top") > 0, F.floor(F.col("spend") / F.col("top") * F.ceil(F.col("n") / 1000))).otherwise(F.lit(0)).cast("long")
    df = ranked(beside(df, top, ["dataset", "publisher"]), ["dataset", "publisher"], share, ["spend", "vid"], "seq").drop("top", "n")
    return with_publisher_index(df).select("dataset", "publisher", "pub_idx", "seq", "vid", "spend")


def read_design(spark: SparkSession, path: str, datasets: list[str] | None = None) -> DataFrame:
    """All data sets of a design, or those named: other partitions aren't read."""
    df = spark.read.parquet(path)
    return df.filter(F.col("dataset").isin(datasets)) if datasets is not None else df


def dataset_names(design: DataFrame) -> DataFrame:
    return design.select("dataset").distinct().orderBy("dataset")


def write_dataset(log: DataFrame, path: str) -> None:
    """Parquet by data set and publisher, each sorted by spend, so that a prefix is found by the files' statistics.

    A publisher's rows are dealt out by spend too: a large one isn't one task's work."""
    log.repartitionByRange("dataset", "publisher", "spend", "seq").sortWithinPartitions("dataset", "publisher", "spend", "seq").write.mode("append").partitionBy("dataset", "publisher").parquet(path)


#: Where a design keeps the ranges of its files; readers of the design pass over it.
RANGES = "_ranges"


def index_design(spark: SparkSession, path: str) -> None:
    """Writes the range of spends that each of a design's files holds (dataset, publisher, file, low, high) beside it; only spends are read."""
    ranges = spark.read.parquet(path).groupBy("dataset", "publisher", F.col("_metadata.file_path").alias("file")).agg(F.min("spend").alias("low"), F.max("spend").alias("high"))
    kept(ranges, "ranges").coalesce(1).write.mode("overwrite").parquet(f"{path}/{RANGES}")  # a row for each file


def read_prefix(spark: SparkSession, path: str, limits: DataFrame) -> DataFrame:
    """What spend limits (dataset, publisher, spend_limit) buy in an indexed design. Files whose spends all lie beyond their publisher's limit aren't
    opened, and within the others the greatest limit is a literal that the scan skips row groups by. A design that has changed since
    index_design() must be indexed again."""
    limits = kept(limits.select("dataset", "publisher", "spend_limit"), "limits")
    names = {c: t for c, t in spark.read.parquet(path).dtypes}
    ranges = spark.read.parquet(f"{path}/{RANGES}")
    wanted = ranges.join(limits, ["dataset", "publisher"]).filter(F.col("low") <= F.col("spend_limit")).select("file", "spend_limit").collect()  # files, as the reader lists them anyway
    every = spark.read.parquet(path)
    if not wanted:
        return every.limit(0)
    top = max(r.spend_limit for r in wanted)
    df = spark.read.option("basePath", path).schema(every.schema).parquet(*sorted({unquote(r.file) for r in wanted})).filter(F.col("spend") <= F.lit(top))
    return beside(df, limits, ["dataset", "publisher"]).filter("spend <= spend_limit").select(*names)


def write_files(log: DataFrame, path: str) -> None:
    """A headerless file of vid,spend for each publisher, named by it, as read_dataset takes them. One task writes each file."""
    log.select("publisher", F.concat_ws(",", "vid", "spend").alias("line"), "spend").repartition("publisher").sortWithinPartitions("publisher", "spend").select("publisher", "line").write.partitionBy("publisher").text(path)


def add_dataset(spark: SparkSession, log: DataFrame, path: str) -> None:
    """Appends data sets to a design; one that is there already is an error."""
    names = log.select("dataset").distinct()
    there = spark.read.parquet(path).select("dataset").distinct()
    clash = names.join(there, "dataset", "left_semi").head()
    if clash:
        raise ValueError(f"data set {clash.dataset} is there already")
    write_dataset(log, path)


def write_results(results: DataFrame, path: str) -> None:
    """CSV with a header; missing values are NaN."""
    results.write.option("header", True).option("nullValue", "NaN").csv(path)


def resume_trials(trials: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The trials that have no result yet."""
    return trials.join(done, keys, "left_anti")
