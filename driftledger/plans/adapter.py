"""Tables of the library's shapes from the given table `events`, by SQL that Spark and DuckDB both run.

Event types stand for feeds, users for addresses, half days for snapshots.  Every
event is read; so that unknown days occur, the log names later downloads of some
feeds and days, which block their snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE = """
SELECT event_type AS s, CAST(ts AS DATE) AS dd, CAST(CAST(ts AS DATE) AS STRING) AS d, day(ts) AS n, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS half, event_id AS k, CAST(user_id AS STRING) AS u,
  '10.' || CAST(CAST(floor(user_id / 65536) AS INT) % 256 AS STRING) || '.' || CAST(CAST(floor(user_id / 256) AS INT) % 256 AS STRING) || '.' AS net, CAST(user_id % 256 AS INT) AS c,
  CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'url' WHEN event_type = 'purchase' AND event_id % 5 = 1 THEN 'domain' WHEN event_id % 4 = 0 THEN 'cidr' ELSE 'ip' END AS kind
FROM {events}
"""

OBSERVATIONS = f"""
SELECT s || '_' || d || '_' || half AS snapshot_id, s AS source_name, d || CASE WHEN half = 'AM' THEN 'T06:00:00Z' ELSE 'T18:00:00Z' END AS retrieved_at_utc, 'data/raw/' || s || '/' || d || '_' || half || '.txt' AS source_path,
  md5(s || d || half) || md5(half || d || s) AS sha256, kind AS indicator_type,
  CASE WHEN kind = 'url' THEN 'http://H' || u || '.Example.org/x' WHEN kind = 'domain' THEN 'h' || u || '.example.org' WHEN kind = 'cidr' THEN net || CAST(c - c % 16 AS STRING) || '/28' ELSE net || CAST(c AS STRING) END AS indicator,
  '' AS source_value, CASE WHEN k % 3 = 0 THEN 'seen' ELSE '' END AS reason, '' AS provider_timestamp, 'Unknown' AS country_class, '' AS first_seen, '' AS last_seen, 'listed' AS status, '' AS notes
FROM ({_BASE}) e
"""

REGISTRY = f"""
SELECT DISTINCT dd AS day, prefix FROM (
  SELECT dd, net || CAST(c - c % 32 AS STRING) || '/27' AS prefix FROM ({_BASE}) e WHERE CAST((c - c % 32) / 32 AS INT) % 2 = n % 2 AND n % 10 <> 9
  UNION ALL SELECT dd, net || CAST(c - c % 8 AS STRING) || '/29' AS prefix FROM ({_BASE}) e WHERE (c - c % 8) % 48 = 0 AND n % 10 <> 9
  UNION ALL SELECT dd, net || CAST(c - c % 4 AS STRING) || '/30' AS prefix FROM ({_BASE}) e WHERE c % 20 = 0 AND n % 10 <> 9
) r
"""

EVIDENCE = f"""
SELECT DISTINCT net || CAST(c AS STRING) AS indicator, CASE WHEN k % 3 = 0 THEN 'rdns' WHEN k % 3 = 1 THEN 'asn' ELSE '' END AS signal,
  CASE WHEN k % 5 = 0 THEN 'DK' WHEN k % 5 = 1 THEN ' dk ' WHEN k % 5 = 2 THEN 'SE' WHEN k % 5 = 3 THEN '' ELSE 'unknown' END AS country, 'src' || CAST(k % 2 AS STRING) AS evidence_source, d AS retrieved_at_utc, '' AS notes
FROM ({_BASE}) e WHERE k % 17 = 0
"""

PREFIXES = f"""
SELECT DISTINCT net || CAST(c - c % 32 AS STRING) || '/27' AS prefix, CASE WHEN k % 2 = 0 THEN 'register' ELSE '' END AS evidence_source, '' AS access_date, '' AS notes FROM ({_BASE}) e WHERE k % 13 = 0 AND c < 96
"""

COLLECTION_LOG = f"""
SELECT DISTINCT d || CASE WHEN half = 'AM' THEN 'T06:00:00Z' ELSE 'T18:00:00Z' END AS retrieved_at_utc, s AS source, '' AS url, '200' AS http_status, '1' AS bytes, md5(s || d || half) || md5(half || d || s) AS sha256,
  'data/raw/' || s || '/' || d || '_' || half || '.txt' AS path, 'ok' AS status, '' AS notes FROM ({_BASE}) e
UNION ALL SELECT DISTINCT d || 'T23:00:00Z', s, '', '200', '1', md5(d), 'data/raw/late_' || d, 'OK', '' FROM ({_BASE}) e WHERE (s = 'error' AND n % 11 = 3) OR (s = 'signup' AND n % 7 = 0) OR n = 17
UNION ALL SELECT DISTINCT d || 'T01:00:00Z', s, '', '503', '0', '', '', 'failed', 'timeout' FROM ({_BASE}) e WHERE s = 'view' AND n % 6 = 0
"""

#: Raw files of the snapshots: some have another digest, size or path than their rows and the log say.
RAW_FILES = f"""
SELECT DISTINCT 'data/raw/' || CASE WHEN n % 6 = 1 THEN 'moved/' ELSE '' END || s || '/' || d || '_' || half || '.txt' AS path, CASE WHEN n % 4 = 0 THEN 2 ELSE 1 END AS bytes,
  md5(s || d || half) || CASE WHEN n % 5 = 0 THEN md5(s) ELSE md5(half || d || s) END AS sha256 FROM ({_BASE}) e
"""

#: Two runs a day with the number of their rows, and the files that each lists as its outputs.
RUNS = f"""
SELECT replace(d, '-', '') || CASE WHEN half = 'AM' THEN 'T060000Z' ELSE 'T180000Z' END || '_run_' || lower(half) AS run_id, CASE WHEN n % 9 = 4 THEN 'broken' WHEN half = 'AM' THEN 'completed' ELSE 'completed_with_warnings' END AS status,
  d || CASE WHEN half = 'AM' THEN 'T07:00:00Z' ELSE 'T19:00:00Z' END AS generated_at_utc, CASE WHEN n > 1 THEN CAST(CAST(dd - INTERVAL 1 DAY AS DATE) AS STRING) ELSE '' END AS previous_day, d AS current_day, n % 4 AS missing,
  CASE WHEN n % 3 = 0 THEN 'succeeded' WHEN n % 3 = 1 THEN 'skipped' WHEN n % 7 = 2 THEN 'failed' ELSE '' END AS collection_status, CASE WHEN n % 8 = 2 THEN 'elsewhere' ELSE replace(d, '-', '') || CASE WHEN half = 'AM' THEN 'T060000Z' ELSE 'T180000Z' END || '_run_' || lower(half) END AS folder,
  COUNT(*) AS n_rows FROM ({_BASE}) e GROUP BY dd, d, n, half
"""
OUTPUTS = f"""
SELECT DISTINCT replace(d, '-', '') || CASE WHEN half = 'AM' THEN 'T060000Z' ELSE 'T180000Z' END || '_run_' || lower(half) AS run_id, 'data/raw/' || s || '/' || d || '_' || half || '.txt' AS path, md5(s || d || half) || md5(half || d || s) AS sha256
FROM ({_BASE}) e
"""

#: Lines of feed files of at most 4096 events each, one file for each format.
FEED_LINES = f"""
SELECT s, replace(d, '-', '') || CASE WHEN half = 'AM' THEN 'T060000Z' ELSE 'T180000Z' END AS stamp, CAST(CAST(floor(k / 4096) AS INT) AS STRING) AS part, k, n, net || CAST(c AS STRING) AS ip, net || CAST(c - c % 16 AS STRING) || '/28' AS cidr, u
FROM ({_BASE}) e
"""


#: Snapshots as a stream delivers them: which of three deliveries brings a part, some twice, some later than others of their feed.
DELIVERIES = f"""
SELECT s AS source, ts AS told, kind, ip, CAST(lag AS INT) AS delivery FROM (
  SELECT DISTINCT s, d || CASE WHEN half = 'AM' THEN ' 06:00:00.0000' ELSE ' 06:00:00.0005' END AS ts, kind, net || CAST(c AS STRING) AS ip, CASE WHEN n % 10 < 5 THEN 0 WHEN n % 10 < 9 THEN 1 ELSE 2 END AS lag, n, half FROM ({_BASE}) e
  UNION ALL SELECT DISTINCT s, d || ' 06:00:00.0005', kind, net || CAST(c AS STRING), 2, n, half FROM ({_BASE}) e WHERE half = 'PM' AND n % 3 = 0
) p
"""


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def of_half_days(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A table that tells feeds and half days apart only, whatever their events: every event is read, one of each half day goes through the SQL."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = events.groupBy("event_type", F.to_date("ts").alias("day"), (F.hour("ts") < 12).alias("am")).agg(F.min("ts").alias("ts"), F.min("event_id").alias("event_id"), F.min("user_id").alias("user_id"))
    return spark.sql(sql, events=one)


def ctes(**named: str) -> str:
    """The same tables as common table expressions for DuckDB."""
    return ", ".join(f"{name} AS ({sql.replace('{events}', 'events')})" for name, sql in named.items())
