"""Small helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java and RE2 pattern.
SPACE = r"[\x20\x09-\x0D]+"


def whole(text: str = "text") -> Column:
    """The text, or an empty string for null."""
    return F.coalesce(F.col(text), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none for an empty text."""
    return F.array_remove(F.split(text, SPACE), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset one is made here in local mode, as in
    tests; on a cluster it would be on one machine, so that is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("reachspark.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("reachspark.shared.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it: lineage ends there, lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_stored: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes what stored() wrote in this process so far. Results that read it must have been written before."""
    while _stored:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def apart(df: DataFrame, *names: str, columns: list[str] | None = None) -> DataFrame:
    """The named columns as they are, and all columns (or those in `columns`) again under names that clash with nothing; together() gives them back.

    So an operator's own temporary columns may have any name that isn't one of `names`."""
    return df.select(*(F.col(f"`{c}`").alias(c) for c in names), *(F.col(f"`{c}`").alias(f"in_{i}_{HELD}") for i, c in enumerate(df.columns if columns is None else columns)))


#: Marks held columns; an input column of such a name is held under another one.
HELD = "held"


def together(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns that apart() held, less those whose name a new one has (in any case), and the new ones."""
    names = {c.lower() for c in new}
    return df.select(*(F.col(f"in_{i}_{HELD}").alias(c) for i, c in enumerate(columns) if c.lower() not in names), *(v.alias(k) for k, v in new.items()))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the given columns; a column of the same name, in any case, gives way."""
    new = {c.lower() for c in columns}
    old = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    return df.select(*old, *(v.alias(k) for k, v in columns.items()))
