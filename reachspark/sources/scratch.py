"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset a folder is made here in local mode only: on a cluster it
    would be on one machine, so that is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("reachspark.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("reachspark.scratch", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and reads it: what follows doesn't work it out again, and lost executors don't matter."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    _kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: list[str] = []


def clear(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that kept() wrote in this process, all or those after the first `since`. Results that read them must have
    been written before."""
    while len(_kept) > since:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_kept.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, even a failing one, what kept() wrote inside; the job's results are written there too."""
    since = len(_kept)
    try:
        yield
    finally:
        clear(spark, since)
