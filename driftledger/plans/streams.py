"""Registered queries over streams: the given events replayed as files and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftledger.checkpoints import fresh_folder, unsorted_parts
from driftledger.plans import adapter, files
from driftledger.plans.files_sql import SOUND
from driftledger.plans.oracle import _q
from driftledger.plans.queries import Query
from driftledger.streaming import changes, ingest


def replayed(spark: SparkSession, rows: DataFrame, delivery: str) -> DataFrame:
    """A stream of the rows, one batch for each value of a column of small numbers, in their order."""
    path = fresh_folder(spark)
    kept = rows.drop(delivery)
    for n in sorted(r[0] for r in rows.select(delivery).distinct().collect()):
        rows.where(F.col(delivery) == n).drop(delivery).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).parquet(path)


def r1_ingested(spark, sf_dir):
    """Feed files ingested in three deliveries; a half of them comes again under another name. Stored rows by feed, kind and time."""
    found = files.feed_lines(spark, sf_dir)
    part = F.pmod(F.crc32("path"), F.lit(2)).cast("int")
    again = F.regexp_replace(F.regexp_replace("path", "/lake/", "/mirror/copy_"), "_([^_]*)$", "_again_$1")
    comes = F.array(F.struct(part.alias("delivery"), F.col("path").alias("path")), F.struct(F.when(part == 0, 2).alias("delivery"), again.alias("path")))
    told = found.select(F.explode(comes).alias("c"), "modificationTime", "content").where("c.delivery IS NOT NULL").select("c.delivery", "c.path", "modificationTime", "content")
    inbox, table, checkpoint = fresh_folder(spark), fresh_folder(spark), fresh_folder(spark)
    # all are made and written once; each delivery lies there as many files, and one run of the stream with the same checkpoint takes what is new
    with unsorted_parts(spark):
        told.write.option("compression", "zstd").partitionBy("delivery").parquet(inbox)
    for n in range(3):
        arrived = spark.readStream.schema(told.drop("delivery").schema).parquet(f"{inbox}/delivery=[0-{n}]")
        ingest.ingest_stream(arrived, table, checkpoint).awaitTermination()
    rows = ingest.stored(spark, table)
    return rows.groupBy("source_name", "indicator_type", "retrieved_at_utc").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("indicator").alias("indicators"), F.min("indicator").alias("least"))


def r2_change_log(spark, sf_dir):
    """The changes between snapshots that a stream brings late, twice and within one second."""
    rows = adapter.table(spark, sf_dir, adapter.DELIVERIES).withColumn("at", F.col("told").cast("timestamp"))
    parts = rows.groupBy("source", "at", "delivery").agg(F.collect_set(F.struct(F.col("kind").alias("indicator_type"), F.col("ip").alias("indicator"))).alias("keys"))
    # the end of the feeds: an hour that the watermark can reach, with no snapshot of a known feed
    end = rows.agg((F.max("at") + F.expr("interval 60 days")).alias("at"), (F.max("delivery") + 1).alias("delivery")).select(F.lit("end").alias("source"), "at", "delivery", F.lit(None).cast(parts.schema["keys"].dataType).alias("keys"))
    before = spark.conf.get(changes.STATE_STORE[0])
    spark.conf.set(*changes.STATE_STORE)
    try:
        log, path = changes.changes(replayed(spark, parts.unionByName(end), "delivery"), patience="40 days"), fresh_folder(spark)
        log.writeStream.format("parquet").option("path", path).option("checkpointLocation", fresh_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(changes.STATE_STORE[0], before)
    out = spark.read.schema(log.schema).parquet(path)
    return out.select("source", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSS").alias("at"), "indicator_type", "indicator", "change")


QUERIES: dict[str, Query] = {f.__name__: f for f in (r1_ingested, r2_change_log)}

_AT = "substr(stamp, 1, 4) || '-' || substr(stamp, 5, 2) || '-' || substr(stamp, 7, 5) || ':' || substr(stamp, 12, 2) || ':' || substr(stamp, 14)"
#: Where a line stands in its file, by its text; the place is part of what tells equal lines apart.
_PLACE = "row_number() OVER (PARTITION BY s, stamp, part ORDER BY line)"


def _stored(name: str, kind: str, indicator: str, line: str, same: str, feed: str = "feed") -> str:
    """What is stored of one format: rows of a time and a file's content that agree in `same` are one."""
    rows = f"SELECT *, {_PLACE} AS place, string_agg(line, ',') OVER (PARTITION BY s, stamp, part ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS content FROM (SELECT *, {line} AS line FROM {feed}) x"
    return f"SELECT '{name}' AS source_name, '{kind}' AS indicator_type, {_AT} AS retrieved_at_utc, count(DISTINCT (content, {same})) AS n, count(DISTINCT {indicator}) AS indicators, min({indicator}) AS least FROM ({rows}) GROUP BY stamp"


SQL: dict[str, str] = {
    "r1_ingested": _q(
        adapter.ctes(feed=adapter.FEED_LINES),
        " UNION ALL ".join(
            (
                _stored("FireHOL", "ip", "ip", "ip || ' # seen'", "ip, place"), _stored("blocklist.de", "ip", "ip", "ip", "ip, place"),
                _stored("Spamhaus DROP", "cidr", "cidr", "cidr || ',' || u", "cidr, u", SOUND), _stored("URLhaus", "url", "'http://H' || u || '.Example.org/a,b'", "CAST(k AS VARCHAR) || ',' || u", "u"),
            )
        ),
    ),
    "r2_change_log": _q(
        f"""{adapter.ctes(told=adapter.DELIVERIES)},
keys AS (SELECT DISTINCT source, told AS tm, kind AS indicator_type, ip AS indicator FROM told),
times AS (SELECT source, tm, lag(tm) OVER w AS prev, lead(tm) OVER w AS nxt FROM (SELECT DISTINCT source, tm FROM keys) WINDOW w AS (PARTITION BY source ORDER BY tm))""",
        "SELECT k.source, k.tm AS \"at\", k.indicator_type, k.indicator, 'added' AS change FROM keys k JOIN times t USING (source, tm) WHERE t.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM keys p WHERE p.source = k.source AND p.tm = t.prev AND p.indicator_type = k.indicator_type AND p.indicator = k.indicator) "
        "UNION ALL SELECT k.source, t.nxt, k.indicator_type, k.indicator, 'removed' FROM keys k JOIN times t USING (source, tm) WHERE t.nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM keys p WHERE p.source = k.source AND p.tm = t.nxt AND p.indicator_type = k.indicator_type AND p.indicator = k.indicator)",
    ),
}
