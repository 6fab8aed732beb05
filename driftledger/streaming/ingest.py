"""Feeds as they arrive: incremental normalisation into one table, in which no row stands twice.

The table is a folder with the rows by batch and day; beside it, `<table>.batches`
has a manifest for each batch that is complete.  `stored` reads complete batches
only, so a batch that was lost half-way is as if it had never begun, and one that is
tried again writes its own folders again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftledger.checkpoints import unsorted_parts, written
from driftledger.schemas import OBSERVATION
from driftledger.sources.feeds import described, observations

_FILES = "path string, modificationTime timestamp, length long, content binary"
#: What makes two rows the same, whatever the name of the file that brought them: a feed's content at a time, and the row in it.
IDENTITY = ("source_name", "retrieved_at_utc", "sha256", "indicator_type", "indicator", "source_value", "reason", "provider_timestamp", "notes")
#: What makes the contents of two files the same, and so all of their rows.
_CONTENT = ("source_name", "retrieved_at_utc", "sha256")
_STORED = ", ".join([*(f"{c} string" for c in OBSERVATION.names), "d1 long", "d2 long", "batch long", "snapshot_day string"])
_MANIFEST = "n_rows long, first_at string, last_at string, batch long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def stored(spark: SparkSession, table: str) -> DataFrame:
    """The rows of all complete batches, with their digests, batch and day."""
    done = _read(spark, f"{table}.batches", _MANIFEST).select("batch")
    return _read(spark, table, _STORED).join(F.broadcast(done), "batch", "left_semi")


def merge(files: DataFrame, batch: int, table: str) -> None:
    """Add the observations of some files that the table does not hold yet.

    Files of one content (source, time and digest) give the same rows, and a batch counts
    only when it is complete, so the table holds all rows of a content or none.  Hence
    contents are told apart before they are parsed: of those that the table lacks, the
    file of the least path is parsed, and its equal rows are told where it is read.
    Rows are never shuffled, sorted or kept besides the table; files are
    moved once, to lie by day.  Of stored rows, only the days at hand are read.  A
    batch that is complete already is left alone.
    """
    spark = files.sparkSession
    if _read(spark, f"{table}.batches", _MANIFEST).where(F.col("batch") == batch).head(1):
        return
    day = F.substring("retrieved_at_utc", 1, 10)
    known = described(files).where("format IS NOT NULL AND sha256 IS NOT NULL")
    told = known.groupBy(*_CONTENT, "source_path").agg(F.count(F.lit(1)).alias("copies"))
    least = told.groupBy(*_CONTENT).agg(F.min("source_path").alias("least"))
    before = stored(spark, table)
    days = [r.day for r in told.select(day.alias("day")).distinct().limit(1000).collect()]
    if len(days) < 1000:  # else all days are read
        before = before.where(F.col("snapshot_day").isin(days))
    least = least.join(before.select(*_CONTENT).distinct(), [*_CONTENT], "left_anti")
    told = written(told.join(least.withColumnRenamed("least", "source_path").withColumn("fresh", F.lit(True)), [*_CONTENT, "source_path"], "left"))
    n = told.agg(F.count("fresh").alias("fresh"), F.count_if(F.col("fresh").isNull()).alias("rest"), F.coalesce(F.max("copies"), F.lit(0)).alias("copies")).first()
    file, taken = [*_CONTENT, "source_path"], known
    if n.rest:  # the shorter list is the one to send
        shorter = ("fresh", "left_semi") if n.fresh <= n.rest else ("fresh IS NULL", "left_anti")
        taken = known.join(told.where(shorter[0]), file, shorter[1])
    if n.copies > 1:  # a path that came twice
        taken = taken.dropDuplicates(file)
    if not n.fresh:
        taken = taken.where(F.lit(False))
    identity = [F.coalesce(c, F.lit("")) for c in IDENTITY]
    # files by day, of a size, whatever the number of tasks and the largest day
    rows = observations(taken.withColumn("snapshot_day", day).hint("rebalance", "snapshot_day"), distinct=True)
    rows = rows.withColumns({"d1": F.xxhash64(*identity), "d2": F.xxhash64(F.lit("second"), *identity), "snapshot_day": day})
    target = f"{table}/batch={batch}"
    with unsorted_parts(spark):
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("snapshot_day").parquet(target)
    here = _read(spark, target, _STORED.replace(", batch long", ""))
    manifest = here.agg(F.count(F.lit(1)).alias("n_rows"), F.min("retrieved_at_utc").alias("first_at"), F.max("retrieved_at_utc").alias("last_at"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{table}.batches/batch={batch}")


def ingest_stream(files: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of files (path, modificationTime, content), and end when all that is there is read."""
    return files.writeStream.foreachBatch(lambda part, batch: merge(part, batch, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, raw: str, table: str, checkpoint: str) -> StreamingQuery:
    """Merge the files of a folder that were not read before.  The checkpoint remembers files, the table rows."""
    return ingest_stream(spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).load(raw), table, checkpoint)
