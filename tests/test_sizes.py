"""Work that must not grow faster than its input: what rows carry, and what is computed once."""

import tracemalloc

from pyspark.sql import functions as F

from driftledger.llm import wordhash
from driftledger.operators import intervals
from driftledger.operators.study import Study
from driftledger.plans import adapter, files
from driftledger.sources import feeds
from test_entry import DIR


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _csv(spark, n):
    text = "id,url,url_status,threat\n" + "\n".join(f'{i},"http://h{i}.example.org/a,b",online,x' for i in range(n))
    return feeds.described(spark.createDataFrame([("/lake/urlhaus_20240101T000000Z.csv", text.encode())], "path string, content binary").selectExpr("path", "timestamp'2024-01-01' AS modificationTime", "content"))


def test_lines_of_a_csv_feed_do_not_carry_their_file(spark):
    rows = feeds.url_rows(_csv(spark, 50))
    above = _plan(rows).split("Generate explode(rest")
    assert len(above) > 1 and "lines#" not in above[0] and "content#" not in above[0]
    assert rows.count() == 50 and rows.where("indicator = 'http://h7.example.org/a,b' AND reason = 'x'").count() == 1


def test_feed_files_are_made_once(spark):
    found = files.feed_files(spark, DIR)
    assert "Aggregate" not in _plan(found) and found.where("path like '%unrouted%'").count() * 5 == found.count()


def test_least_networks_join_across_all_parts(spark):
    nets = [f"{10 << 24 | i << 10:032b}"[:22] for i in range(1 << 8)] + [f"{11 << 24 | i << 16:032b}"[:16] for i in range(256)] + [f"{12 << 24 | i:032b}" for i in range(5)]
    got = intervals.least(spark.createDataFrame([("a", 4, b) for b in nets], "k string, version int, bits string"), ["k"], width=32).collect()
    # 10.0.0.0/14, 11.0.0.0/8 and 12.0.0.0/30 with one address more
    assert sorted(r.bits for r in got) == sorted([f"{10:08b}000000", f"{11:08b}", f"{12:08b}" + "0" * 22, f"{12 << 24 | 4:032b}"])


def test_words_are_hashed_in_blocks():
    text = b" ".join(b"w%d" % i for i in range(400_000)) + b" " + b"x" * 3_000_000 + b" last"
    tracemalloc.start()
    words = wordhash.Words([text, b"w7 last"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words.hash[7] == words.hash[-2] and words.hash[-3] == words.hash[-1] and len(set(words.hash.tolist())) == 400_002
    assert peak < 28 * len(text)


def test_half_day_tables_equal_the_sql_over_all_events(spark):
    for sql in (adapter.COLLECTION_LOG, adapter.RAW_FILES, adapter.OUTPUTS):
        every, told_apart = adapter.table(spark, DIR, sql), adapter.of_half_days(spark, DIR, sql)
        assert sorted(map(tuple, told_apart.collect())) == sorted(map(tuple, every.collect()))


def test_keys_with_bits_are_not_parsed_again(spark):
    day = F.to_date(F.lit("2024-01-01")).alias("day")
    keys = spark.createDataFrame([("a", "ip", "10.0.0.1", 4, f"{0x0A000001:032b}"), ("a", "url", "http://x", None, None)], "source string, indicator_type string, indicator string, version int, bits string").select(day, "*")
    registry = spark.createDataFrame([(4, f"{0x0A:08b}")], "version int, bits string").select(day, "*")
    days = spark.range(1).select(day)
    source = keys.select("day", "source").distinct()

    def refused(_):
        raise AssertionError("parsed again")

    s = Study.of(keys, source, registry, days, source.select("source"), refused)
    assert {(r.label, r.n) for r in s.label_counts().collect()} == {("DK_FULL", 1), ("NOT_IP_IN_SCOPE", 1)}


def test_nested_networks_go_at_every_depth(spark):
    texts = ["0", "01", "0110", "10", "1011", "110", "111"]
    rows = spark.createDataFrame([(k, 4, b) for k in ("a", "b") for b in texts if k == "a" or len(b) > 1], "k string, version int, bits string")
    left = {k: sorted(r.bits for r in intervals.disjoint(rows, ["k"]).collect() if r.k == k) for k in ("a", "b")}
    assert left == {"a": ["0", "10", "110", "111"], "b": ["01", "10", "110", "111"]}


def test_files_are_told_apart_before_they_are_parsed(spark, tmp_path, monkeypatch):
    from driftledger.checkpoints import written
    from driftledger.streaming import ingest

    text = "id,url,url_status,threat\n" + "\n".join(f'{i},"http://h{i % 7}.example.org/a,b",online,x' for i in range(50))
    shape = "path string, modificationTime timestamp, content binary"
    frame = lambda *names: spark.createDataFrame([(f"/lake/{n}", None, text.encode()) for n in names], shape)
    parsed, kept = [], []

    def observations(files, **how):
        parsed.append(files.count())
        return feeds.observations(files, **how)

    def noted(df):
        kept.append(df.columns)
        return written(df)

    monkeypatch.setattr(ingest, "observations", observations)
    monkeypatch.setattr(ingest, "written", noted)
    table = str(tmp_path / "table")
    first, second = "urlhaus_20240101T000000Z.csv", "urlhaus_b_20240101T000000Z.csv"
    ingest.merge(frame(second, first, first), 0, table)  # a path twice, and its content under another name
    ingest.merge(frame("copy_" + first), 1, table)
    ingest.merge(frame("copy_" + first, "urlhaus_20240102T000000Z.csv"), 2, table)
    assert parsed == [1, 0, 1] and not any("indicator" in c or "text" in c for c in kept)
    rows = ingest.stored(spark, table).select("source_path", "indicator").collect()
    assert len(rows) == len(set(rows)) == 14 and {r.source_path for r in rows} == {f"/lake/{first}", "/lake/urlhaus_20240102T000000Z.csv"}


def test_equal_rows_of_a_file_are_told_where_it_is_read(spark):
    # texts that only their lengths tell apart, escapes, and items that differ in what is not read
    items = ['{"ip": "10.0.0.1", "sblid": "a,b", "x": 1}', '{"ip": "10.0.0.1", "sblid": "a,b", "x": 2}', '{"ip": "10.0.0.1", "sblid": "a", "date": ",b"}', '{"\\u0069p": "10.0.0.1", "sblid": "a\\nb"}', '"10.0.0.2"', '"10.0.0.2"']
    files = feeds.described(spark.createDataFrame([("/lake/spamhaus_20240101T000000Z.json", None, "\n".join(items).encode()), ("/lake/urlhaus_20240101T000000Z.csv", None, b"id,host,url\n1,A.org,\n2,A.org,\n3,,\n4,A.org,http://A.org")], "path string, modificationTime timestamp, content binary"))
    read = lambda **how: sorted((r.indicator_type, r.indicator, r.source_value, r.reason, r.provider_timestamp) for r in feeds.observations(files, **how).collect())
    one = [("domain", "a.org", "A.org", "", ""), ("ip", "10.0.0.1", "10.0.0.1", "a", ",b"), ("ip", "10.0.0.1", "10.0.0.1", "a\nb", ""), ("ip", "10.0.0.1", "10.0.0.1", "a,b", ""), ("ip", "10.0.0.2", "10.0.0.2", "", ""), ("url", "http://A.org", "http://A.org", "", "")]
    assert read(distinct=True) == one and sorted(set(read())) == one and len(read()) == 9
    assert "Exchange" not in feeds.observations(files, distinct=True)._jdf.queryExecution().executedPlan().toString()
