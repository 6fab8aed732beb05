"""Addresses against the standard library, and the study on a small scenario."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from driftledger.functions.addresses import minimal, n_addresses, network_text, parsed
from driftledger.operators import evidence, intervals, quality, snapshots, summary
from driftledger.operators.study import Study
from driftledger.sources.tables import described_log


def _plain(v):
    try:
        if "/" in v.strip():
            return "cidr", str(ipaddress.ip_network(v.strip(), strict=False))
        return "ip", str(ipaddress.ip_address(v.strip()))
    except ValueError:
        return None


def test_parsed_equals_the_standard_library(spark):
    rng = random.Random(5)
    values = ["01.2.3.4", "1.2.3.4/255.255.255.0", "1.2.3.4/0.0.0.255", "1.2.3.4/33", "::", "2001:DB8:0:0:1:0:0:1", "1::2::3", "1:2:3:4:5:6:7::", "::/0", "0.0.0.0/0", "", "x", "::ffff:1.2.3.4", " 10.0.0.1 ", "1.2.3.4/1/2"]
    for _ in range(120):
        if rng.random() < 0.5:
            values.append(str(ipaddress.IPv4Address(rng.getrandbits(32))) + rng.choice(["", f"/{rng.randint(0, 32)}"]))
        else:
            x = rng.getrandbits(128)
            for k in range(8):
                x &= ~(0xFFFF << 16 * k) if rng.random() < 0.5 else -1
            values.append(str(ipaddress.IPv6Address(x)) + rng.choice(["", f"/{rng.randint(2, 128)}"]))
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("p", parsed(F.col("v")))
    for r in df.select("v", "p.kind", "p.text", n_addresses(F.col("p.version"), F.col("p.bits")).alias("n")).collect():
        assert ((r.kind, r.text) if r.kind else None) == _plain(r.v), r.v
        if r.n is not None:
            assert int(r.n) == ipaddress.ip_network(r.text).num_addresses


def test_minimal_networks(spark):
    rng = random.Random(2)
    nets = {ipaddress.IPv4Network((rng.getrandbits(6) << 26, 6)) for _ in range(40)}
    bits = [format(int(n.network_address), "032b")[:6] for n in nets]
    row = spark.createDataFrame([(bits,)], "b array<string>").select(F.transform(minimal(F.col("b")), lambda b: network_text(F.lit(4), b)).alias("n")).first()
    assert row.n == [str(n) for n in ipaddress.collapse_addresses(nets)]


def test_merged_and_disjoint_cover_the_same(spark):
    rows = [(1, p) for p in ("10.0.0.0/25", "10.0.0.128/25", "10.0.0.0/24", "10.0.2.0/24", "2001:db8::/32")]
    blocks = spark.createDataFrame(rows, "k int, p string").withColumn("x", parsed(F.col("p"))).select("k", "x.version", "x.bits")
    assert {(r.version, int(r.addresses)) for r in intervals.addresses(intervals.disjoint(blocks, ["k"]), ["k"]).collect()} == {(4, 512), (6, 2**96)}
    spans = intervals.merged(blocks, ["k"])
    assert {int(r.n) for r in spans.select(intervals.span_size(F.col("version"), F.col("low"), F.col("next")).alias("n")).collect()} == {256, 2**96}


#: Days of a made-up spring; the registry speaks on the first three, and a source may be silent on a day.
DAYS = [f"2021-03-0{k}" for k in range(1, 6)]
HEARD = {"alpha": (0, 1, 2, 4), "beta": (0, 1, 3)}


def _network(rng, low, high):
    return ipaddress.ip_network((int(ipaddress.ip_address("10.20.0.0")) + rng.randrange(256), rng.randint(low, high)), strict=False)


def _scenario():
    """(source, day) -> keys, and day -> registry networks, drawn at random; neighbouring days share most of both."""
    rng = random.Random(20)
    keys, registry = {}, {}
    for source, days in HEARD.items():
        now = {_network(rng, 26, 32) for _ in range(14)}
        for d in days:
            now = {n for n in now if rng.random() < 0.8} | {_network(rng, 26, 32) for _ in range(4)}
            keys[source, DAYS[d]] = now
    now = {_network(rng, 27, 30) for _ in range(7)}
    for day in DAYS[:3]:
        now = {n for n in now if rng.random() < 0.7} | {_network(rng, 27, 30) for _ in range(2)}
        registry[day] = now
    keys["beta", DAYS[0]] |= set(list(keys["alpha", DAYS[0]])[:5])
    keys["beta", DAYS[1]] |= set(list(keys["alpha", DAYS[1]])[:5])
    return keys, registry


KEYS, REGISTRY = _scenario()


def _text(n):
    return str(n.network_address) if n.prefixlen == 32 else str(n)


def _hosts(networks):
    return {int(n.network_address) + k for n in networks for k in range(n.num_addresses)}


def _held(source, day):
    """Key -> the addresses of it that the registry holds on the day."""
    held = _hosts(REGISTRY[day])
    return {k: _hosts([k]) & held for k in KEYS[source, day]}


def _observations(spark, snaps):
    rows = [(f"{s}_{t}", s, t, f"data/raw/{s}/{t}", "d" * 64, "cidr" if "/" in i else "ip", i, "listed") for s, t, items in snaps for i in items]
    return spark.createDataFrame(rows, "snapshot_id string, source_name string, retrieved_at_utc string, source_path string, sha256 string, indicator_type string, indicator string, status string")


@pytest.fixture(scope="module")
def study(spark):
    # an earlier snapshot of a day does not count
    snaps = [(s, f"{d}T09:30:00Z", [_text(k) for k in keys]) for (s, d), keys in KEYS.items()] + [("alpha", f"{DAYS[0]}T01:00:00Z", ["10.99.0.1"])]
    rows = snapshots.checked_rows(_observations(spark, snaps))
    chosen = snapshots.selected(snapshots.index(rows))
    good = chosen.where("blocked is null").select("source_name", "day", "snapshot_id")
    keys = rows.join(good, ["source_name", "day", "snapshot_id"], "left_semi").select("day", F.col("source_name").alias("source"), "indicator_type", "indicator").distinct()
    told = [(d, str(n)) for d, nets in REGISTRY.items() for n in nets] + [(d, "fd12:3456::/32") for d in REGISTRY]
    registry = spark.createDataFrame(told, "d string, p string").select(F.to_date("d").alias("day"), parsed(F.col("p")).alias("x")).select("day", "x.version", "x.bits")
    sources = spark.createDataFrame([(s,) for s in HEARD], "source string")
    return Study.of(keys, good.select("day", F.col("source_name").alias("source")), registry, summary.calendar(spark, DAYS[0], DAYS[-1]), sources, parsed), registry


def test_study_daily_equals_brute_force(study):
    rows = {(r.source, str(r.day)): r for r in study[0].daily().collect()}
    assert set(rows) == {(s, d) for s in HEARD for d in DAYS}
    for (s, d), r in rows.items():
        if (s, d) not in KEYS:
            assert r.full is None and r.status == "missing_or_blocked"
        elif d not in REGISTRY:
            assert r.unknown == len(KEYS[s, d])
        else:
            held = _held(s, d)
            full = sum(len(h) == k.num_addresses for k, h in held.items())
            assert (r.full, r.partial, int(r.ipv4_addresses)) == (full, sum(map(bool, held.values())) - full, len(set().union(*held.values())))


def test_study_comparisons_equal_brute_force(study):
    rows = {(r.source, str(r.previous_date), r.scope): r for r in study[0].compare().collect()}
    seen = 0
    for s in HEARD:
        for a, b in zip(DAYS, DAYS[1:]):
            every, matched = rows[s, a, "GLOBAL_IP_CIDR"], rows[s, a, "DK_ANY_MATCH"]
            if (s, a) not in KEYS or (s, b) not in KEYS:
                assert every.removed_count is None and matched.removed_count is None
                continue
            old, new = KEYS[s, a], KEYS[s, b]
            assert (every.feed_added, every.feed_removed) == (len(new - old), len(old - new))
            if a in REGISTRY and b in REGISTRY:
                was, now = ({k for k, h in _held(s, d).items() if h} for d in (a, b))
                assert (matched.feed_added, matched.feed_removed, matched.registry_scope_left) == (len(now - old), len(was - new), len((was - now) & new))
                seen += matched.registry_scope_left
    assert seen  # the scenario has what it should show
    gaps = {(r.source, r.calendar_gap_days) for r in study[0].compare(adjacent=False).collect()}
    assert ("alpha", 2) in gaps and ("beta", 3) in gaps
    assert quality.identities(study[0].compare(), study[0].daily()).count() == 0
    assert study[0].complete_days().count() == sum(all((s, d) in KEYS for s in HEARD) and d in REGISTRY for d in DAYS)
    for r in study[0].changes().where("source = 'alpha'").collect():
        assert r.cause in ("feed_membership_changed", "registry_scope_changed")


def test_study_overlap_and_space_equal_brute_force(study):
    over = {str(r.day): r for r in study[0].overlap().collect()}
    alone = {(str(r.day), r.source): r for r in study[0].exclusive().collect()}
    for d in DAYS:
        if d in REGISTRY and all((s, d) in KEYS for s in HEARD):
            keys, space = {}, {}
            for s in HEARD:
                keys[s] = {k for k, h in _held(s, d).items() if h}
                space[s] = set().union(*_held(s, d).values())
            assert over[d].key_overlap == len(keys["alpha"] & keys["beta"]) and int(over[d].overlapping_ipv4_addresses) == len(space["alpha"] & space["beta"])
            for s, t in (("alpha", "beta"), ("beta", "alpha")):
                assert alone[d, s].exclusive_keys == len(keys[s] - keys[t]) and int(alone[d, s].exclusive_ipv4_addresses) == len(space[s] - space[t])
        else:
            assert over[d].key_overlap is None
    moved = {(str(r.previous_date), r.source, r.ip_version): r for r in study[0].address_changes().collect()}
    before, after = (set().union(*_held("alpha", d).values()) for d in DAYS[:2])
    assert (int(moved[DAYS[0], "alpha", 4].added_addresses), int(moved[DAYS[0], "alpha", 4].removed_addresses)) == (len(after - before), len(before - after))


def test_study_persistence_equals_brute_force(study):
    rows = {(r.source, r.indicator): r for r in study[0].persistence().where("scope = 'GLOBAL_IP_CIDR'").collect()}
    assert set(rows) == {(s, _text(k)) for (s, _), keys in KEYS.items() for k in keys}
    for (s, text), r in rows.items():
        here = [s_d in KEYS and text in map(_text, KEYS[s_d]) for s_d in ((s, d) for d in DAYS)]
        longest = max(len(run) for run in "".join("x" if h else " " for h in here).split())
        assert (r.present_sampled_days, r.eligible_sampled_days, r.longest_consecutive_calendar_presence) == (sum(here), len(HEARD[s]), longest)


def test_blocked_snapshots(spark):
    twice = [("a", "2021-05-02T06:00:00Z", ["10.1.1.1"]), ("b", "2021-05-02T06:00:00Z", ["10.1.1.999"]), ("c", "2021-05-02T06:00:00Z", ["10.1.1.1/24"])]
    late = spark.createDataFrame([("2021-05-02T08:00:00Z", "a", "", "200", "1", "e" * 64, "p", "ok", "")], "retrieved_at_utc string, source string, url string, http_status string, bytes string, sha256 string, path string, status string, notes string")
    found = snapshots.index(snapshots.checked_rows(_observations(spark, twice)))
    got = {r.source_name: r.blocked for r in snapshots.selected(found, described_log(late)).collect()}
    assert got == {"a": "newer_download_not_normalized", "b": "invalid_or_conflicting_rows", "c": "invalid_or_conflicting_rows"}
    bad = _observations(spark, [("a", "2021-05-02T06:00:00", ["10.1.1.1"])])
    with pytest.raises(Exception, match="zoned time"):
        snapshots.checked_rows(bad).select("at").collect()


def test_evidence_rule(spark):
    rows = _observations(spark, [("a", "2021-05-02T06:00:00Z", ["10.7.7.1", "10.7.7.2", "10.7.7.3", "10.8.8.9"])])
    told = spark.createDataFrame([("10.7.7.1", "rdns", "DK", "x", "", ""), ("10.7.7.1", "asn", "dk", "y", "", ""), ("10.7.7.2", "asn", "SE", "y", "", ""), ("10.7.7.3", "", "N/A", "", "", "")], "indicator string, signal string, country string, evidence_source string, retrieved_at_utc string, notes string")
    nets = spark.createDataFrame([("10.7.7.2/31", "reg", "", ""), ("10.7.7.0/30", "reg", "", "")], "prefix string, evidence_source string, access_date string, notes string")
    got = {r.indicator: (r.country_class, r.danish_signal_count, r.non_danish_signal_count) for r in evidence.classify(rows, told, nets).collect()}
    assert got == {"10.7.7.1": ("DK-supported", 3, 0), "10.7.7.2": ("Conflicting", 1, 1), "10.7.7.3": ("DK-weak", 1, 0), "10.8.8.9": ("Unknown", 0, 0)}
