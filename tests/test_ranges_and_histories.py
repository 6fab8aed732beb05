"""Ranges as networks, all pairs of days from histories, and registry evidence read from files."""

import datetime
import hashlib
import ipaddress
import json
import random

from pyspark.sql import functions as F

from driftledger.functions.addresses import network_text, range_networks
from driftledger.operators import intervals
from driftledger.operators.study import Study
from driftledger.sources import registry


def _networks(spark, ranges):
    """(id, version, low, after) with numbers as bounds, to the texts of their networks."""
    width = {4: 32, 6: 128}
    rows = [(k, v, f"{a:0{width[v]}b}", "2" if b >> width[v] else f"{b:0{width[v]}b}") for k, (v, a, b) in enumerate(ranges)]
    nets = spark.createDataFrame(rows, "k int, version int, low string, after string").withColumn("bits", range_networks(F.col("version"), F.col("low"), F.col("after")))
    out = nets.select("k", F.transform("bits", lambda b: network_text(F.col("version"), b)).alias("n")).collect()
    return {r.k: r.n for r in out}


def test_ranges_equal_the_standard_library(spark):
    rng = random.Random(17)
    ranges = [(4, 0, 1 << 32), (4, 0, 1), (4, (1 << 32) - 1, 1 << 32), (4, 5, 5), (4, 9, 4), (6, 0, 1 << 128), (6, 1, 1 << 128), (6, 0, (1 << 128) - 1), (4, 1, (1 << 32) - 1), (4, 256, 512), (4, 255, 513)]
    for _ in range(150):
        v = rng.choice([4, 6])
        bits = rng.choice([4, 9, 20, 32] if v == 4 else [4, 20, 64, 127])
        a = rng.getrandbits(32 if v == 4 else 128) >> rng.randint(0, 30)
        ranges.append((v, a, min(a + rng.getrandbits(bits) + 1, 1 << (32 if v == 4 else 128))))
    got = _networks(spark, ranges)
    for k, (v, a, b) in enumerate(ranges):
        kind = ipaddress.IPv4Address if v == 4 else ipaddress.IPv6Address
        want = [str(n) for n in ipaddress.summarize_address_range(kind(a), kind(b - 1))] if a < b else []
        assert got[k] == want, (v, a, b)


def test_merged_ranges_become_networks(spark):
    rng = random.Random(3)
    nets = [ipaddress.ip_network((0x0A000000 + (rng.getrandbits(12) << 4), rng.randint(24, 30)), strict=False) for _ in range(80)]
    nets += [ipaddress.ip_network((0x20010DB8 << 96 | rng.getrandbits(6) << 70, rng.randint(54, 60)), strict=False) for _ in range(30)]
    rows = [(n.version, bin(int(n.network_address) | 1 << n.max_prefixlen)[3 : 3 + n.prefixlen]) for n in nets]
    spans = intervals.merged(spark.createDataFrame(rows, "version int, bits string"), [])
    got = spans.select("version", F.explode(range_networks(F.col("version"), F.col("low"), F.col("next"))).alias("b")).select(network_text(F.col("version"), F.col("b")).alias("n")).collect()
    want = [*ipaddress.collapse_addresses(n for n in nets if n.version == 4), *ipaddress.collapse_addresses(n for n in nets if n.version == 6)]
    assert sorted(r.n for r in got) == sorted(map(str, want))


def _history_study(spark, days, sources, listed, unknown):
    """A study of given keys: listed[(source, key)] is a dict of day to label."""
    calendar = spark.createDataFrame([(d,) for d in days], "day date")
    usable = [(d, s, (s, d) not in unknown) for s in sources for d in days if (s, d, "lost") not in unknown]
    members = [(d, s, "ip", k, 4, "1", label, None, []) for (s, k), at in listed.items() for d, label in at.items()]
    schema = "day date, source string, indicator_type string, indicator string, version int, bits string, label string, matched decimal(38,0), hits array<string>"
    empty = spark.createDataFrame([], "day date, source string, indicator_type string, indicator string")
    return Study(calendar, spark.createDataFrame([(s,) for s in sources], "source string"), spark.createDataFrame(usable, "day date, source string, evidence boolean"), spark.createDataFrame(members, schema), empty)


def _expected(days, listed, unknown, source, x, y):
    """The counts of two days by sets."""
    seen = [(source, d, "lost") not in unknown for d in (x, y)]
    known = [(source, d) not in unknown for d in (x, y)]
    sides = [{k: at[d] for (s, k), at in listed.items() if s == source and d in at} for d in (x, y)]
    for scope, labels in (("GLOBAL_IP_CIDR", None), ("DK_FULL", {"DK_FULL"}), ("DK_ANY_MATCH", {"DK_FULL", "DK_PARTIAL"})):
        if not all(seen) or labels and not all(known):
            yield scope, "unknown_missing_input", None, None, None, None, None
            continue
        a, b = ({k for k, v in side.items() if labels is None or v in labels} for side in sides)
        yield scope, "compared", len(b - a), len(a - b), len(a & b), len({k for k in b - a if k in sides[0]}), len({k for k in a - b if k in sides[1]})


def test_all_pairs_equal_sets(spark):
    rng = random.Random(23)
    days = [datetime.date(2024, 2, 1) + datetime.timedelta(k) for k in range(12)]
    sources, listed, unknown = ["a", "b", "never"], {}, {("a", days[3]), ("b", days[4], "lost"), ("b", days[4]), ("a", days[7], "lost")}
    unknown |= {("never", d, "lost") for d in days}
    for source in "ab":
        for k in range(60):
            shape = rng.choice(["all", "none", "some", "some"])
            at = {d: rng.choice(["DK_FULL", "DK_PARTIAL", "NO_DK_MATCH"]) if rng.random() < 0.4 else "DK_FULL" for d in days if shape == "all" or shape == "some" and rng.random() < 0.5}
            listed[source, f"k{k}"] = {d: v for d, v in at.items() if (source, d, "lost") not in unknown}
    got = _history_study(spark, days, sources, listed, unknown).compare(adjacent=False).collect()
    assert len(got) == 3 * 3 * 66
    for r in got:
        want = {w[0]: w[1:] for w in _expected(days, listed, unknown, r.source, r.previous_date, r.current_date)}[r.scope]
        assert (r.status, r.added_count, r.removed_count, r.unchanged_count, r.registry_scope_entered, r.registry_scope_left) == want


def test_all_pairs_of_ten_years(spark):
    """A window of 3,660 days: 6.7 million pairs, of keys that stay for years and of some that come and go."""
    rng = random.Random(6)
    days = [datetime.date(2015, 1, 1) + datetime.timedelta(k) for k in range(3660)]
    present = {}
    for k in range(40):
        at, on, spans = 0, rng.random() < 0.5, []
        while at < len(days):
            upto = min(len(days), at + rng.randint(1, 1500))
            spans += [(at, upto)] if on else []
            at, on = upto, not on
        present[k] = spans
    rows = spark.createDataFrame([(k, a, b - 1) for k, spans in present.items() for a, b in spans], "k int, a int, b int")
    members = rows.select(F.explode(F.sequence("a", "b")).alias("n"), F.lit("feed").alias("source"), F.lit("ip").alias("indicator_type"), F.col("k").cast("string").alias("indicator"))
    members = members.select(F.date_add(F.lit("2015-01-01").cast("date"), F.col("n")).alias("day"), "source", "indicator_type", "indicator", F.when(F.col("n") % 2 == 0, "DK_FULL").otherwise("DK_PARTIAL").alias("label"))
    calendar = spark.createDataFrame([(d,) for d in days], "day date")
    study = Study(calendar, spark.createDataFrame([("feed",)], "source string"), calendar.select("day", F.lit("feed").alias("source"), F.lit(True).alias("evidence")), members, members.where("false"))
    picked = [tuple(sorted(rng.sample(range(3660), 2))) for _ in range(200)]
    wanted = spark.createDataFrame([(days[a], days[b]) for a, b in picked], "previous_date date, current_date date").distinct()
    all_rows = study._common_of_all_pairs()
    got = {(r.previous_date, r.current_date): (r.c_all, r.c_any) for r in all_rows.join(F.broadcast(wanted), ["previous_date", "current_date"]).collect()}
    for a, b in picked:
        both = sum(any(x <= a < y for x, y in spans) and any(x <= b < y for x, y in spans) for spans in present.values())
        assert got[days[a], days[b]] == (both, both)


def _response(day, v4, v6, **other):
    data = {"query_time": f"{day}T00:00:00", "resource": "dk", "resources": {"ipv4": v4, "ipv6": v6}} | other
    return json.dumps({"status": other.pop("status", "ok"), "data": data})


def test_registry_files_with_a_bad_network_are_refused_whole(spark, tmp_path):
    cases = {
        "2024-03-01": (["192.0.2.0/24", "198.51.100.0/24"], ["2001:db8::/32"], ""),
        "2024-03-02": (["192.0.2.1/24"], ["2001:db8::/32"], "a network is not valid"),
        "2024-03-03": (["192.0.2.0"], ["2001:db8::/32"], "a network is not valid"),
        "2024-03-04": (["192.0.2.0/24"], ["2001:db8::/129"], "a network is not valid"),
        "2024-03-05": (["192.0.2.0/24"], [], "both address families need networks"),
        "2024-03-06": (["192.0.2.0/24", None], ["2001:db8::/32"], "a network is not valid"),
        "2024-03-07": (["192.0.2.0/24"], ["2001:db8::/32"], "metadata of another country"),
        "2024-03-08": (["192.0.2.0/24"], ["2001:db8::/32"], "response digest differs"),
    }
    for day, (v4, v6, problem) in cases.items():
        text = _response(day, v4, v6)
        (tmp_path / f"{day}.response.json").write_text(text)
        digest = "0" * 64 if "digest" in problem else hashlib.sha256(text.encode()).hexdigest()
        meta = {"country": "SE" if "metadata" in problem else "DK", "requested_date": day, "query_time": day, "retrieved_at_utc": day, "url": "", "response_file": f"elsewhere/{day}.response.json", "sha256": digest, "ipv4_prefixes": len(v4), "ipv6_prefixes": len(v6)}
        (tmp_path / f"{day}_a.metadata.json").write_text(json.dumps(meta | {"sha256": "older"}))
        (tmp_path / f"{day}_b.metadata.json").write_text(json.dumps(meta, indent=1))
    found = registry.checked(registry.evidence_files(spark, f"{tmp_path}/*.metadata.json", f"{tmp_path}/*.response.json"))
    assert {r.requested_date: r.problem or "" for r in found.collect()} == {day: problem for day, (_, _, problem) in cases.items()}
    assert {str(r.day) for r in registry.networks(found).collect()} == {"2024-03-01"} == {r.requested_date for r in registry.evidence_index(found).collect()}
    assert registry.networks(found).count() == 3
