"""Changes between streamed snapshots and exactly-once ingestion, against plain sets."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from driftledger.plans.streams import replayed
from driftledger.streaming import changes, ingest

T0 = datetime.datetime(2024, 5, 1, 6, 0, 0)


def _log(spark, tmp_path, deliveries, patience):
    """deliveries: (delivery, source, time, keys) parts of snapshots."""
    keys = "array<struct<indicator_type:string,indicator:string>>"
    rows = spark.createDataFrame([(n, s, t, None if k is None else [("ip", x) for x in k]) for n, s, t, k in deliveries], f"delivery int, source string, at timestamp, keys {keys}")
    before = spark.conf.get(changes.STATE_STORE[0])
    spark.conf.set(*changes.STATE_STORE)
    try:
        log = changes.changes(replayed(spark, rows, "delivery"), parts=3, patience=patience)
        log.writeStream.format("parquet").option("path", str(tmp_path / "log")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.source, r.at, r.indicator, r.change) for r in spark.read.schema(log.schema).parquet(str(tmp_path / "log")).collect())
    finally:
        spark.conf.set(changes.STATE_STORE[0], before)


def _wanted(deliveries):
    snaps = {}
    for _, s, t, k in deliveries:
        snaps.setdefault((s, t), set()).update(k or ())
    out = []
    for (s, t), (r, u) in zip(sorted(snaps), sorted(snaps)[1:], strict=False):
        if s == r:
            out += [(s, u, k, "added") for k in snaps[s, u] - snaps[s, t]] + [(s, u, k, "removed") for k in snaps[s, t] - snaps[s, u]]
    return sorted(out)


def test_changes_of_late_repeated_and_close_snapshots(spark, tmp_path):
    rng = random.Random(31)
    minute, micro = datetime.timedelta(minutes=1), datetime.timedelta(microseconds=1)
    deliveries = []
    for s in "ab":
        for k in range(8):
            keys = rng.sample([f"k{i}" for i in range(30)], rng.randint(0, 20))
            at = T0 + (k // 2) * minute + (k % 2) * micro  # two within a second, a microsecond apart
            deliveries += [(rng.randint(0, 2), s, at, keys[:7]), (rng.randint(0, 2), s, at, keys[7:])]
    deliveries += [(2, *d[1:]) for d in rng.sample(deliveries, 6)]  # repeated parts
    end = (3, "end", T0 + datetime.timedelta(days=3), None)
    got = _log(spark, tmp_path, [*deliveries, end], "1 day")
    assert got == _wanted(deliveries) and {c for *_, c in got} == {"added", "removed"}


def test_a_snapshot_beyond_the_patience_is_left_out(spark, tmp_path):
    hour = datetime.timedelta(hours=1)
    kept = [(0, "a", T0, ["x", "y"]), (1, "a", T0 + 10 * hour, ["y"]), (2, "a", T0 + 20 * hour, ["y", "z"])]
    late = [(3, "a", T0 + 5 * hour, ["never"])]
    assert _log(spark, tmp_path, [*kept, *late, (4, "end", T0 + 90 * hour, None)], "2 hours") == _wanted(kept)


def _file(name, *lines):
    return (f"/raw/{name}", datetime.datetime(2024, 5, 1), ("\n".join(lines) + "\n").encode())


FILES = [
    _file("firehol_20240501T060000Z_a.netset", "192.0.2.1", "192.0.2.1", "198.51.100.0/24"),
    _file("mirror_firehol_20240501T060000Z_again.netset", "192.0.2.1", "192.0.2.1", "198.51.100.0/24"),  # the first one under another name
    _file("firehol_20240502T060000Z_a.netset", "192.0.2.1", "192.0.2.1", "198.51.100.0/24"),  # the same list a day later
    _file("firehol_20240501T060000Z_other.netset", "192.0.2.1"),  # another list of that time
    _file("blocklist_20240501T060000Z_all.txt", "192.0.2.1", "203.0.113.9"),
]
KEY = ("source_name", "retrieved_at_utc", "indicator_type", "indicator", "notes", "sha256")


def _frame(spark, files):
    return spark.createDataFrame(files, "path string, modificationTime timestamp, content binary")


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4), (4, 3, 2, 1, 0), (1, 0, 3, 2, 4)])
def test_three_orders_give_one_table(spark, tmp_path, order):
    table = str(tmp_path / "table")
    for batch, k in enumerate(order):
        ingest.merge(_frame(spark, [FILES[k]]), batch, table)
    rows = sorted(tuple(r) for r in ingest.stored(spark, table).select(*KEY).collect())
    assert len(rows) == 3 + 3 + 1 + 2 and len(set(rows)) == len(rows)
    lists = [["192.0.2.1", "192.0.2.1", "198.51.100.0/24"], ["192.0.2.1"], ["192.0.2.1", "203.0.113.9"]]
    told = [("FireHOL", "01", 0), ("FireHOL", "02", 0), ("FireHOL", "01", 1), ("blocklist.de", "01", 2)]
    assert sorted((r[0], r[1][8:10], r[3], r[4]) for r in rows) == sorted((s, d, v, f"line {n}") for s, d, k in told for n, v in enumerate(lists[k], 1))


def test_a_batch_that_was_lost_or_tried_again(spark, tmp_path):
    table = str(tmp_path / "table")
    ingest.merge(_frame(spark, FILES[:1]), 0, table)
    # data without a manifest: a batch that was lost before its end
    spark.read.parquet(f"{table}/batch=0").withColumn("d1", F.col("d1") + 1).write.partitionBy("snapshot_day").parquet(f"{table}/batch=1")
    assert ingest.stored(spark, table).count() == 3
    ingest.merge(_frame(spark, FILES[2:]), 1, table)
    ingest.merge(_frame(spark, FILES[:1]), 1, table)  # complete already
    assert ingest.stored(spark, table).count() == 9
    ingest.merge(_frame(spark, FILES), 2, table)
    assert ingest.stored(spark, table).count() == 9 and spark.read.parquet(f"{table}.batches").where("batch = 2").first().n_rows == 0
