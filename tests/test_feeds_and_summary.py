"""Raw files to observations to summaries, on feeds that are drawn at random from private addresses."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from driftledger.operators import compare, snapshots, summary
from driftledger.sources import feeds, sinks, tables
from driftledger.streaming import ingest

RNG = random.Random(44)
D1, D2 = "2022-11-05", "2022-11-06"


def _address():
    return f"10.{RNG.randint(0, 3)}.{RNG.randint(0, 3)}.{RNG.randint(1, 9)}"


def _network():
    return f"10.{RNG.randint(0, 3)}.{RNG.randint(0, 2)}.0/24"


def _drawn(n, draw):
    return [draw() for _ in range(n)]


def _file(source, day, rest):
    return f"{source}_{day.replace('-', '')}T141500Z_{rest}"


def _feeds():
    """File name -> text, and the rows (snapshot, kind, indicator, value, reason, notes) that it holds."""
    files, rows = {}, set()
    for day, n in ((D1, 9), (D2, 7)):
        name = _file("firehol", day, "webscan.netset")
        lines = []
        for k, value in enumerate(_drawn(n, lambda: RNG.choice((_address, _network))())):
            lines.append(RNG.choice(("#", "; skip me", "", "   ")) if k % 3 == 0 else RNG.choice(("# note", "#")))
            lines.append(value + RNG.choice(("", "  ", " # seen by a sensor")))
            rows.add((name[: -len(".netset")], "cidr" if "/" in value else "ip", value, value, "", f"line {len(lines)}"))
        files[name] = "\r\n".join(lines)
    name = _file("blocklist_de", D1, "ssh.txt")
    values = [*_drawn(6, _address), "no address here", "10.0.0.300"]
    files[name] = "\n".join(values) + "\n"
    rows |= {(name[:-4], "ip", v, v, "", f"line {k}") for k, v in enumerate(values[:6], 1)}
    name = _file("spamhaus", D1, "edrop.json")
    items = [{"cidr": v, "sblid": f"SBL{900 + k}"} for k, v in enumerate(sorted(set(_drawn(7, _network))))]
    files[name] = json.dumps({"data": items, "meta": {"type": "x"}})
    rows |= {(name[:-5], "cidr", i["cidr"], i["cidr"], i["sblid"], "") for i in items}
    name = _file("urlhaus", D1, "online.csv")
    table = [(f"http://h{k}.test/p,{k}", RNG.choice(("online", "offline")), RNG.choice(("botnet", "phish"))) for k in range(5)]
    files[name] = "# made for a test\nid,dateadded,url,url_status,threat,host\n" + "".join(f'{k},2022-11-04 10:00:00,"{u}",{st},{th},h{k}.test\n' for k, (u, st, th) in enumerate(table))
    rows |= {(name[:-4], "url", u, u, th, st) for u, st, th in table}
    return files, rows


FILES, ROWS = _feeds()
SOURCES = {"firehol": "FireHOL", "blocklist": "blocklist.de", "spamhaus": "Spamhaus DROP", "urlhaus": "URLhaus"}


def _keys():
    """(source, day) -> its keys."""
    out = {}
    for snapshot, kind, indicator, *_ in ROWS:
        day = D1 if D1.replace("-", "") in snapshot else D2
        out.setdefault((SOURCES[snapshot.split("_")[0]], day), set()).add((kind, indicator))
    return out


KEYS = _keys()


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (folder / name).write_text(text)
    (folder / "other.txt").write_text("x")
    return folder


@pytest.fixture(scope="module")
def observed(spark, raw):
    return feeds.observations(feeds.scan(spark, str(raw))).cache()


def test_parsers(observed):
    assert {(r.snapshot_id, r.indicator_type, r.indicator, r.source_value, r.reason, r.notes) for r in observed.collect()} == ROWS


def test_notes_name_files_without_rows(spark, raw, observed):
    notes = feeds.parse_notes(feeds.scan(spark, str(raw)), observed).collect()
    assert [n.path.rpartition("/")[2] for n in notes] == ["other.txt"]


def test_json_shapes(spark):
    shapes = {
        "list": ('["10.0.0.1", {"ip_address": "10.0.0.2"}, {"name": "none"}]', ["10.0.0.1", "10.0.0.2"]),
        "lines": ('# head\n{"network": "10.3.0.0/16", "as": "7"}\n\n{"range": "10.4.0.0/16"}', ["10.3.0.0/16", "10.4.0.0/16"]),
        "mapped": ('{"blocklist": {"x": {"ip": "FD00:0:0:0::A"}, "y": {"cidr": "10.5.0.0/16"}}}', ["fd00::a", "10.5.0.0/16"]),
        "cut": ('{"data": [', []),
    }
    files = spark.createDataFrame([(k, t) for k, (t, _) in shapes.items()], "source_path string, text string")
    files = files.select("*", F.lit("json").alias("format"), *(F.lit("x").alias(c) for c in ("snapshot_id", "source_name", "retrieved_at_utc", "sha256")))
    got = {(r.source_path, r.indicator) for r in feeds.json_items(files).collect()}
    assert got == {(k, v) for k, (_, values) in shapes.items() for v in values}


def test_daily_summary_equals_brute_force(observed):
    rows = {(r.source, r.snapshot_day): (r.unique_indicators, r.unique_ips_cidrs, r.unique_domains_urls, r.additions, r.removals) for r in summary.daily_summary(observed).collect()}
    want = {}
    for (source, day), keys in KEYS.items():
        before = KEYS.get((source, D1)) if day == D2 else None
        nets = sum(kind in ("ip", "cidr") for kind, _ in keys)
        want[source, day] = (len(keys), nets, len(keys) - nets, None if before is None else len(keys - before), None if before is None else len(before - keys))
    assert rows == want
    assert sum(r.raw_rows for r in summary.daily_summary(observed).collect()) == len(ROWS)


def test_persistence_and_overlap_equal_brute_force(observed):
    kept = {(r.source, r.indicator): (r.persistence_ratio, r.right_censored) for r in summary.persistence(observed).collect()}
    days = {s: sorted(d for t, d in KEYS if t == s) for s, _ in KEYS}
    want = {}
    for (source, _), keys in KEYS.items():
        for k in keys:
            seen = [d for d in days[source] if k in KEYS[source, d]]
            want[source, k[1]] = (len(seen) / len(days[source]), "yes" if seen[-1] == days[source][-1] else "no")
    firehol = {k: v for k, v in kept.items() if k[0] == "FireHOL"}
    assert set(kept) == set(want) and firehol == {k: v for k, v in want.items() if k[0] == "FireHOL"} and len({r for r, _ in firehol.values()}) == 2
    whole = {s: set().union(*(KEYS[s, d] for d in ds)) for s, ds in days.items()}
    shared = {(r.source_a, r.source_b, r.indicator_type): (r["intersection"], r["union"], r.jaccard) for r in summary.overlap(observed).collect()}
    pairs = {}
    for a, b in itertools.combinations(sorted(whole), 2):
        for kind in {k for k, _ in whole[a]} & {k for k, _ in whole[b]}:
            x, y = ({v for k, v in whole[s] if k == kind} for s in (a, b))
            pairs[a, b, kind] = (len(x & y), len(x | y), pytest.approx(len(x & y) / len(x | y), abs=1e-6))
    assert shared == pairs and any(v[0] for v in pairs.values())


def test_comparison_equals_brute_force(observed):
    assert compare.status(observed)[:3] == ("ready", D1, D2)
    assert compare.status(observed, "2022-01-01", D2)[0] == "error"
    rows = {(r.source, r.indicator_type): (r.previous_count, r.current_count, r.removed_count, r.comparison_status) for r in compare.summary(observed, D1, D2).collect()}
    for kind in ("ip", "cidr", "url"):
        old, new = ({v for k, v in KEYS["FireHOL", d] if k == kind} for d in (D1, D2))
        assert rows["FireHOL", kind] == (len(old), len(new), len(old - new), "compared")
    assert rows["Spamhaus DROP", "cidr"] == (len(KEYS["Spamhaus DROP", D1]), None, None, "missing_current_snapshot")
    old, new = KEYS["FireHOL", D1], KEYS["FireHOL", D2]
    got = {(r.source, r.indicator_type, r.indicator, r.change) for r in compare.changes(observed, D1, D2).collect()}
    assert got == {("FireHOL", *k, "removed") for k in old - new} | {("FireHOL", *k, "added") for k in new - old}


def test_latest_keeps_the_later_snapshot(spark, observed):
    first = observed.where(F.col("snapshot_id").startswith("firehol_" + D1.replace("-", "")) & (F.col("indicator_type") == "ip"))
    later = first.withColumn("retrieved_at_utc", F.lit(f"{D1}T22:00:00Z")).withColumn("snapshot_id", F.lit("evening"))
    got = snapshots.latest_index(observed.unionByName(later)).where(f"source_name = 'FireHOL' and day = '{D1}'").collect()
    assert [(r.snapshot, r.indicator_count) for r in got] == [("evening", sum(k == "ip" for k, _ in KEYS["FireHOL", D1]))]


def test_sinks_and_tables(spark, observed, tmp_path):
    day = summary.daily_summary(observed)
    sinks.write_csv(day, str(tmp_path / "day"), order=["source"])
    assert "NA" in next((tmp_path / "day").glob("part*")).read_text()
    with pytest.raises(Exception, match="already exists"):
        sinks.write_csv(day, str(tmp_path / "day"))
    sinks.write_by_source(day, str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").glob("source_slug=*")} == {"source_slug=firehol", "source_slug=spamhaus_drop", "source_slug=urlhaus", "source_slug=blocklist_de"}
    back = tables.read_csv(spark, str(tmp_path / "day"), day.schema)
    assert back.count() == 5 and tables.read_csv(spark, str(tmp_path / "none"), day.schema).count() == 0
    (tmp_path / "bom.csv").write_bytes("﻿source,snapshot_day\na,2022-01-01\n".encode())
    assert tables.read_csv(spark, str(tmp_path / "bom.csv"), day.select("source", "snapshot_day").schema).collect()[0].source == "a"


def test_ingest_reads_new_files_once(spark, raw, tmp_path):
    for _ in range(2):
        ingest.ingest(spark, str(raw), str(tmp_path / "obs"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "obs")).count() == len(ROWS)
