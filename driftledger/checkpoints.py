"""A folder for tables that several results read, which are written once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """df checkpointed, which computes it twice, once to count its rows and once to write them."""
    _shared(df.sparkSession)
    return df.checkpoint()


def fresh_folder(spark: SparkSession) -> str:
    """A path that does not exist yet, in the shared folder.

    It is the one that spark.checkpoint.dir names, shared by all executors; only
    where none is set, as in tests on one machine, a temporary one is used.
    """
    return f"{_shared(spark)}/tables-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: later reads take only the columns they need, and joins know its size.

    `kept` would compute df twice.
    """
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def unsorted_parts(spark: SparkSession, most: int = 8) -> Iterator[None]:
    """While it lasts, a task that writes at most so many partitions keeps a file of each open, instead of sorting its rows by partition."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)
