"""The feed folder as a data source: pruning, faults as rows, parsing."""

import os

import pytest

from driftledger.sources import feeds
from driftledger.sources.folder import FeedFolder, FeedReader, _described

FILES = {
    "a/firehol_20240501T060000Z_a.netset": "192.0.2.1\n192.0.2.0/28 # note\n",
    "a/firehol_20240502T060000Z_a.netset": "192.0.2.2\n",
    "b/spamhaus_20240501T060000Z_drop.json": '{"cidr": "192.0.2.0/24"}\n{"cidr": "198.51.100.0/24"\n',
    "b/spamhaus_20240502T060000Z_drop.json": '{"cidr": "192.0.2.0/24"}\n{"cidr": "198.51.100.0/24"}\n',
    "b/unknown_20240502T060000Z.txt": "192.0.2.3\n",
    "firehol_20240503T060000Z_gone.netset": None,
}


@pytest.fixture
def folder(spark, tmp_path):
    for name, text in FILES.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text) if text is not None else os.symlink(tmp_path / "nowhere", path)
    return str(tmp_path)


@pytest.fixture(autouse=True)
def registered(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedFolder)
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_faults_are_rows_and_do_not_end_the_job(spark, folder):
    files = spark.read.format("feed_folder").load(folder)
    assert files.count() == len(FILES) == files.rdd.getNumPartitions()
    found = feeds.described(files)
    rows = feeds.observations(found)
    assert sorted((r.source_name, r.retrieved_at_utc[:10], r.indicator) for r in rows.collect()) == [
        ("FireHOL", "2024-05-01", "192.0.2.0/28"), ("FireHOL", "2024-05-01", "192.0.2.1"), ("FireHOL", "2024-05-02", "192.0.2.2"), ("Spamhaus DROP", "2024-05-02", "192.0.2.0/24"), ("Spamhaus DROP", "2024-05-02", "198.51.100.0/24"),
    ]
    notes = {os.path.basename(r.path): r.error for r in feeds.parse_notes(found, rows).collect()}
    assert notes == {
        "spamhaus_20240501T060000Z_drop.json": "a line is not JSON", "unknown_20240502T060000Z.txt": "no parser for this file name", "firehol_20240503T060000Z_gone.netset": "FileNotFoundError: No such file or directory",
    }


def test_filters_reach_the_listing(spark, folder):
    files = spark.read.format("feed_folder").load(folder)
    one = files.where("source_name = 'FireHOL' and day in ('2024-05-01', '2024-05-03')")
    assert one.rdd.getNumPartitions() == 2 and sorted(r.day for r in one.select("day").collect()) == ["2024-05-01", "2024-05-03"]
    assert files.where("source_name = 'none'").count() == 0 and files.where("day = '2024-05-02'").count() == 3


def test_an_empty_folder(spark, tmp_path):
    assert spark.read.format("feed_folder").load(str(tmp_path)).count() == 0
    assert [f.path for f in FeedReader(str(tmp_path)).partitions()] == [""] and _described("/x/URLhaus_20240501T060000Z_r.csv").source == "URLhaus"
