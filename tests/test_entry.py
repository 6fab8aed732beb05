"""The registered queries and their SQL twins."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["a1_daily_summary", "a3_source_overlap", "a5_two_day_summary", "a8_study_daily", "d3_scoped_comparison"])
def test_twins_agree(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    ours = entry.queries()[name](spark, DIR)
    theirs = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    text = lambda v: "" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    assert sorted(tuple(map(text, r)) for r in ours.select(*names).collect()) == sorted(tuple(map(text, r)) for r in theirs.fetchall())
