"""Runs that are complete or not, tables in order, digests that no order changes, manifests of many versions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from driftledger.operators import ordering, sketches, summary
from driftledger.sources import sinks, tables


def _table(spark, n=400, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(rng.choice("abc"), rng.randint(0, 9), f"k{rng.randint(0, 10**6)}") for _ in range(n)], "source string, n int, key string").repartition(7)


def test_numbers_follow_the_order(spark):
    rows = _table(spark).distinct()
    for order, key in (([F.col("source"), F.col("n").desc(), F.col("key")], lambda r: (r.source, -r.n, r.key)), ([F.col("key").desc(), F.col("source"), F.col("n")], None)):
        got = sorted(ordering.numbered(rows, order).collect(), key=lambda r: r.place)
        assert [r.place for r in got] == list(range(1, rows.count() + 1))
        if key:
            assert [key(r) for r in got] == sorted(map(key, got))
        else:
            assert [r.key for r in got] == sorted((r.key for r in got), reverse=True)
    assert ordering.numbered(rows.where("false"), [F.col("key")]).collect() == []


def test_one_hot_value_fills_many_ranges(spark):
    rows = spark.range(3000).select(F.lit("same").alias("a"), F.col("id").alias("b"))
    got = ordering.numbered(rows, [F.col("a"), F.col("b")])
    assert got.where("place <> b + 1").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ordering.in_ranges(rows, [F.col("a"), F.col("b")]).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 2500


def _digest(df):
    return df.agg(*summary.digest_sums(df.columns)).select("bytes", summary.digest_text().alias("d")).first()


def test_digest_of_rows_in_any_order(spark):
    rows = _table(spark).unionByName(spark.createDataFrame([(None, None, None), ("a", 1, "x"), ("a", 1, "x")], "source string, n int, key string"))
    texts = ["\x1f".join("\\N" if v is None else str(v) for v in r) for r in rows.collect()]
    total = sum(int(hashlib.md5(t.encode()).hexdigest(), 16) for t in texts) % (1 << 128)
    assert tuple(_digest(rows)) == (sum(len(t.encode()) for t in texts), f"{total:032x}")
    assert _digest(rows) == _digest(rows.orderBy("key").coalesce(1)) == _digest(rows.repartition(11))
    assert _digest(rows) != _digest(rows.distinct()) and tuple(_digest(rows.where("false"))) == (0, "0" * 32)
    # parts add up
    parts = [rows.where("n < 5"), rows.where("n >= 5 or n is null")]
    sums = [df.agg(*summary.digest_sums(df.columns)) for df in parts]
    whole = sums[0].unionByName(sums[1]).agg(*(F.sum(c).cast(sums[0].schema[c].dataType).alias(c) for c in sums[0].columns))
    assert tuple(whole.select("bytes", summary.digest_text().alias("d")).first()) == tuple(_digest(rows))


def test_a_run_counts_when_its_index_is_there(spark, tmp_path):
    folder = str(tmp_path / "run")
    rows = _table(spark)
    # an attempt that was lost after its first table
    rows.limit(3).write.parquet(f"{folder}/rows")
    assert sinks.run_index(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        sinks.read_run(spark, folder, "rows")
    index = sinks.commit_run({"rows": rows, "counts": rows.groupBy("source").count()}, folder, {"rows": ["source"]})
    assert {r.table for r in index.collect()} == {"rows", "counts"} and sinks.read_run(spark, folder, "rows").count() == rows.count()
    with pytest.raises(FileExistsError):
        sinks.commit_run({"rows": rows}, folder)
    assert sinks.changed_files(spark, folder).count() == 0
    files = sorted((tmp_path / "run" / "rows").rglob("*.parquet"))
    for r in index.where("`table` = 'rows'").collect():
        raw = (tmp_path / "run" / "rows" / r.path).read_bytes()
        assert (r.bytes, r.sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
    files[0].unlink()
    (files[-1].parent / "extra.parquet").write_bytes(files[-1].read_bytes())
    assert sorted(r.problem for r in sinks.changed_files(spark, folder).collect()) == ["missing", "not in the index"]


def test_matched_rows_are_a_part_of_all(spark, tmp_path):
    rows = spark.range(100).select(F.lit("2024-01-01").alias("day"), F.col("id").alias("key"), F.when(F.col("id") % 3 > 0, F.col("id") % 3 - 1).alias("matched"))
    path = str(tmp_path / "classified")
    sinks.write_classified(rows, path)
    matched = sinks.classified(spark, path, matched_only=True)
    assert sinks.classified(spark, path).count() == 100 and matched.count() == rows.where("matched > 0").count()
    assert "PartitionFilters: [isnotnull(in_scope" in matched._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="already exists"):
        sinks.write_classified(rows, path)


def test_manifests_of_many_versions(spark, tmp_path):
    now = {"run_id": "r1", "status": "completed", "generated_at_utc": "t", "previous_day": "", "current_day": "2024-01-02", "normalized": {"distinct_snapshot_days": ["2024-01-01", "2024-01-02"], "rows": 7}, "outputs": [{"path": "a", "sha256": "1", "more": 3}]}
    cases = {
        "now": json.dumps(now, indent=2), "old": json.dumps(now | {"run_id": "r2", "normalized": {"distinct_snapshot_days": "2024-01-01", "rows": "9"}, "outputs": {"a": "1", "b": "2"}}), "cut": json.dumps(now)[:50],
        "list": json.dumps([now]), "nameless": json.dumps({"status": "x"}), "empty": "", "drifted": json.dumps(now | {"run_id": "r3", "normalized": {"rows": "many"}, "outputs": 5}),
    }
    for name, text in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
    got = {r.path.split("/")[-2]: r for r in tables.manifest_fields(tables.manifest_texts(spark, str(tmp_path))).collect()}
    assert {k: r.error for k, r in got.items() if r.error} == {"cut": "not JSON", "list": "not an object", "nameless": "no run_id", **({"empty": "not JSON"} if "empty" in got else {})}
    assert (got["now"].n_rows, got["now"].days, [tuple(o) for o in got["now"].outputs]) == (7, ["2024-01-01", "2024-01-02"], [("a", "1")])
    assert (got["old"].n_rows, got["old"].days, sorted(tuple(o) for o in got["old"].outputs)) == (9, ["2024-01-01"], [("a", "1"), ("b", "2")])
    assert (got["drifted"].run_id, got["drifted"].n_rows, got["drifted"].outputs) == ("r3", None, None)


def test_sketches_keep_their_bounds(spark):
    """Windows and overlaps from daily sketches of 4,096 entries: exact for few keys, within four standard errors for 60,000."""
    rows = spark.range(60_000).select(F.col("id"), F.explode(F.array(F.lit("2024-01-01"), F.lit("2024-01-02"), F.lit("2024-01-09"))).alias("day"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("few"))).alias("source_name"))
    listed = (F.col("source_name") == "a") & (F.col("id") < 40_000) | (F.col("source_name") == "b") & (F.col("id") >= 20_000) | (F.col("source_name") == "few") & (F.col("id") < 1000)
    obs = rows.where(listed & ((F.col("day") != "2024-01-09") | (F.col("id") % 2 == 0))).select("source_name", F.concat("day", F.lit("T06:00:00Z")).alias("retrieved_at_utc"), F.lit("domain").alias("indicator_type"), F.col("id").cast("string").alias("indicator"))
    days = sketches.daily(obs).cache()
    got = {r.source: r["keys"] for r in sketches.counts(days, "2024-01-01", "2024-01-02").collect()}
    assert got["few"] == 1000 and all(abs(got[s] - 40_000) < 4 * 40_000 / 64 for s in "ab")
    assert abs({r.source: r["keys"] for r in sketches.counts(days, "2024-01-09", "2024-01-09").collect()}["a"] - 20_000) < 4 * 20_000 / 64
    both = {(r.source_a, r.source_b): (r.intersection, r.union) for r in sketches.overlap(days, "2024-01-01", "2024-01-09").collect()}
    common, joint = both["a", "b"]
    assert abs(joint - 60_000) < 4 * 60_000 / 64 and abs(common - 20_000) < 4 * 60_000 / 64
