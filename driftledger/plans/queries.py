"""Registered queries of the library's own operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftledger.checkpoints import written
from driftledger.functions import scalars
from driftledger.functions.addresses import n_addresses, network_text, parsed, range_networks
from driftledger.operators import compare, evidence, intervals, quality, sketches, snapshots, summary
from driftledger.operators.study import Study, classify, large_changes
from driftledger.plans import adapter
from driftledger.sources.feeds import network_lines
from driftledger.sources.tables import described_log

Query = Callable[[SparkSession, str], DataFrame]
#: The two days that the comparison queries look at, and the window of the study.
PREVIOUS, CURRENT = "2024-01-13", "2024-01-14"
START, END = "2024-01-01", "2024-01-30"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.table(spark, sf_dir, adapter.OBSERVATIONS)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.table(spark, sf_dir, adapter.REGISTRY).withColumn("p", parsed(F.col("prefix")))
    return written(rows.select("day", "p")).select("day", "p.version", "p.bits")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(described_log(adapter.of_half_days(spark, sf_dir, adapter.COLLECTION_LOG)))


def selection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(what is needed of checked rows, snapshots, selected snapshots)."""
    rows = written(snapshots.checked_rows(observations(spark, sf_dir)).select("source_name", "day", "snapshot_id", "at", "source_path", "sha256", "indicator_type", "indicator", "invalid", "net.version", "net.bits"))
    found = written(snapshots.index(rows))
    return rows, found, written(snapshots.selected(found, log(spark, sf_dir)))


def study(spark: SparkSession, sf_dir: str) -> Study:
    return study_of(spark, sf_dir, *selection(spark, sf_dir))


def study_of(spark: SparkSession, sf_dir: str, rows: DataFrame, _: DataFrame, chosen: DataFrame) -> Study:
    good = chosen.where("blocked is null").select("source_name", "day", "snapshot_id")
    keys = rows.where("not invalid").join(good, ["source_name", "day", "snapshot_id"], "left_semi").select("day", F.col("source_name").alias("source"), "indicator_type", "indicator", "version", "bits").distinct()
    sources = rows.select(F.col("source_name").alias("source")).distinct()
    return Study.of(keys, good.select("day", F.col("source_name").alias("source")), registry(spark, sf_dir), summary.calendar(spark, START, END), sources, parsed)


def a1_daily_summary(spark, sf_dir):
    return summary.daily_summary(observations(spark, sf_dir))


def a2_persistence(spark, sf_dir):
    return summary.persistence(observations(spark, sf_dir))


def a3_source_overlap(spark, sf_dir):
    return summary.overlap(observations(spark, sf_dir))


def a4_snapshot_index(spark, sf_dir):
    _, found, _ = selection(spark, sf_dir)
    return found.select("source_name", F.col("day").cast("string").alias("day"), "snapshot_id", "input_rows", "unique_indicators", "duplicate_rows", "invalid_rows", "conflicts")


def w3_selected_snapshots(spark, sf_dir):
    _, _, chosen = selection(spark, sf_dir)
    return chosen.select("source_name", F.col("day").cast("string").alias("day"), "snapshot_id", F.coalesce("blocked", F.lit("")).alias("blocked"))


def w2_latest_snapshot(spark, sf_dir):
    return snapshots.latest_index(observations(spark, sf_dir)).select("source_name", F.col("day").cast("string").alias("day"), F.col("snapshot").alias("snapshot_id"), "retrieved_at_utc", "sha256", "indicator_count")


def a3_sketched_overlap(spark, sf_dir):
    """The overlap of sources over the study's window from daily sketches; with 2^20 entries it is exact for up to a million keys."""
    days = written(sketches.daily(observations(spark, sf_dir), 20))
    return sketches.overlap(days, START, END, 20)


def a5_two_day_summary(spark, sf_dir):
    return compare.summary(observations(spark, sf_dir), PREVIOUS, CURRENT)


def j5_two_day_changes(spark, sf_dir):
    return compare.changes(observations(spark, sf_dir), PREVIOUS, CURRENT)


def d2_comparison_index(spark, sf_dir):
    return compare.snapshot_index(observations(spark, sf_dir), PREVIOUS, CURRENT)


def a14_changes_by_source(spark, sf_dir):
    return compare.changes_by_source(compare.summary(observations(spark, sf_dir), PREVIOUS, CURRENT))


def a6_evidence_classes(spark, sf_dir):
    return evidence.classify(observations(spark, sf_dir), adapter.table(spark, sf_dir, adapter.EVIDENCE), adapter.table(spark, sf_dir, adapter.PREFIXES))


def m3_labels_by_source(spark, sf_dir):
    return evidence.labels_by_source(a6_evidence_classes(spark, sf_dir))


def m6_candidates(spark, sf_dir):
    return evidence.candidates(a6_evidence_classes(spark, sf_dir))


def d5_registry_classes(spark, sf_dir):
    s = study(spark, sf_dir)
    return s.members.select(F.col("day").cast("string").alias("day"), "source", "indicator_type", "indicator", "label", F.col("matched").cast("long").alias("matched"))


def c20_matched_networks(spark, sf_dir):
    """The least list of networks that the registry shares with each listed network."""
    keys = observations(spark, sf_dir).where("indicator_type = 'cidr'").select(F.to_date(F.substring("retrieved_at_utc", 1, 10)).alias("day"), "indicator").distinct()
    nets = keys.withColumn("p", parsed(F.col("indicator"))).select("day", "indicator", "p.version", "p.bits")
    found = classify(nets, registry(spark, sf_dir), with_text=True).where(F.size("hits") > 0)
    return found.select(F.col("day").cast("string").alias("day"), "indicator", F.array_join(F.transform("hits", lambda b: network_text(F.lit(4), b)), ";").alias("networks"), F.col("matched").cast("long").alias("matched"))


def a7_label_counts(spark, sf_dir):
    return study(spark, sf_dir).label_counts().select(F.col("day").cast("string").alias("day"), "source", "label", "n")


def a8_study_daily(spark, sf_dir):
    return _longs(study(spark, sf_dir).daily(), "day", "ipv4_addresses", "ipv6_addresses")


def d3_scoped_comparison(spark, sf_dir):
    return _dates(study(spark, sf_dir).compare(), "previous_date", "current_date")


def j13_all_pairs(spark, sf_dir):
    return _dates(study(spark, sf_dir).compare(adjacent=False), "previous_date", "current_date")


def f8_large_changes(spark, sf_dir):
    return _dates(large_changes(study(spark, sf_dir).compare()), "previous_date", "current_date").select("source", "previous_date", "current_date", "percent_change")


def f9_first_and_last(spark, sf_dir):
    return _dates(study(spark, sf_dir).first_and_last(), "previous_date", "current_date")


def d4_scope_changes(spark, sf_dir):
    return _dates(study(spark, sf_dir).changes(), "previous_date", "current_date")


def w4_study_persistence(spark, sf_dir):
    return _dates(study(spark, sf_dir).persistence(), "first_observed_date", "last_observed_date")


def j8_same_day_overlap(spark, sf_dir):
    return _longs(study(spark, sf_dir).overlap(), "day", "overlapping_ipv4_addresses", "overlapping_ipv6_addresses")


def a9_exclusive(spark, sf_dir):
    return _longs(study(spark, sf_dir).exclusive(), "day", "exclusive_ipv4_addresses", "exclusive_ipv6_addresses")


def a18_address_changes(spark, sf_dir):
    out = study(spark, sf_dir).address_changes()
    return _dates(out, "previous_date", "current_date").select("previous_date", "current_date", "source", "ip_version", "status", *(F.col(c).cast("long").alias(c) for c in out.columns[5:]))


def d6_fixed_registry(spark, sf_dir):
    return _dates(study(spark, sf_dir).fixed_registry(registry(spark, sf_dir)), "day", "fixed_registry_date")


def a15_complete_days(spark, sf_dir):
    return _dates(study(spark, sf_dir).complete_days(), "day")


def d8_coverage(spark, sf_dir):
    rows, found, chosen = selection(spark, sf_dir)
    s = study_of(spark, sf_dir, rows, found, chosen)
    return _dates(s.coverage(chosen), "day")


def q9_identities(spark, sf_dir):
    s = study(spark, sf_dir)
    broken = quality.identities(s.compare(), s.daily())
    return broken.groupBy().agg(F.count(F.lit(1)).alias("broken"))


def w5_merged_ranges(spark, sf_dir):
    out = intervals.merged(registry(spark, sf_dir), ["day"])
    size = intervals.span_size(F.col("version"), F.col("low"), F.col("next"))
    return out.select(F.col("day").cast("string").alias("day"), F.conv("low", 2, 10).cast("long").alias("low"), size.cast("long").alias("addresses"))


def w6_registry_space(spark, sf_dir):
    out = intervals.addresses(intervals.disjoint(registry(spark, sf_dir), ["day"]), ["day"])
    return out.select(F.col("day").cast("string").alias("day"), "version", F.col("addresses").cast("long").alias("addresses"))


def w7_missing_days(spark, sf_dir):
    """Days between the first and the last day of the registry that it says nothing about."""
    return _dates(summary.missing_days(registry(spark, sf_dir).select("day").distinct()), "day")


def a10_source_statistics(spark, sf_dir):
    return summary.source_statistics(summary.daily_summary(observations(spark, sf_dir)))


def a11_frequencies(spark, sf_dir):
    return summary.frequencies(observations(spark, sf_dir), ["indicator_type", "source_name"])


def a13_dataset_profile(spark, sf_dir):
    return summary.dataset_profile(observations(spark, sf_dir))


def d9_chart_series(spark, sf_dir):
    return summary.chart_series(summary.daily_summary(observations(spark, sf_dir)))


def q2_observation_checks(spark, sf_dir):
    return quality.observations(observations(spark, sf_dir)).drop("message")


def q6_study_report(spark, sf_dir):
    obs = observations(spark, sf_dir)
    s = compare.summary(obs, PREVIOUS, CURRENT).select("previous_day", "current_day").distinct()
    notes = obs.where("indicator = ''")
    return quality.report(obs, notes, a6_evidence_classes(spark, sf_dir), s)


def q7_readiness(spark, sf_dir):
    return quality.readiness(observations(spark, sf_dir).select(scalars.valid_day(F.col("retrieved_at_utc")).alias("day")))


def q11_summary_guard(spark, sf_dir):
    twice = a1_daily_summary(spark, sf_dir).select("source", "snapshot_day")
    return quality.summary_guard(twice.unionByName(twice.where("source = 'view' and snapshot_day like '%-05'")).unionByName(twice.where("source = 'click' and snapshot_day like '%-06'").withColumn("snapshot_day", F.lit("2024-1-6"))))


def m1_planned_and_done(spark, sf_dir):
    return quality.planned_and_done(log(spark, sf_dir), summary.calendar(spark, START, END))


def m2_median_counts(spark, sf_dir):
    return summary.counts_by_source(summary.daily_summary(observations(spark, sf_dir)))


def m4_persistence_summary(spark, sf_dir):
    return summary.persistence_summary(summary.persistence(observations(spark, sf_dir)))


def m5_in_many_sources(spark, sf_dir):
    return summary.in_many_sources(observations(spark, sf_dir))


def m7_metadata_completeness(spark, sf_dir):
    fields = ["snapshot_id", "retrieved_at_utc", "source_path", "sha256", "reason", "provider_timestamp", "notes"]
    return summary.completeness(observations(spark, sf_dir), fields, "source_name")


def m8_enrichment_completeness(spark, sf_dir):
    return summary.completeness(adapter.table(spark, sf_dir, adapter.EVIDENCE), ["signal", "country", "evidence_source"], "evidence_source")


def o3_top_keys(spark, sf_dir):
    """The twenty keys seen on most days: a top-k report."""
    keys = summary.persistence(observations(spark, sf_dir)).groupBy("indicator_type", "indicator").agg(F.sum("snapshots_present").alias("days"))
    return keys.orderBy(F.col("days").desc(), "indicator_type", "indicator").limit(20)


def c4_domains(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", scalars.domain_of(F.col("url")).alias("domain"))


def c7_digests(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


def c8_json_keys(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(scalars.first_filled(F.col("props"), ("missing", "k")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def s3_network_lines(spark, sf_dir):
    """Feed files made of the observations of each snapshot, one a line with remarks, read back by the line parser."""
    obs = observations(spark, sf_dir).where("indicator_type in ('ip', 'cidr')")
    lines = obs.groupBy("snapshot_id", "source_name", "retrieved_at_utc", "source_path", "sha256").agg(F.array_join(F.array_sort(F.collect_list(F.concat("indicator", F.lit(" # remark")))), "\n").alias("text"))
    files = lines.withColumn("text", F.concat(F.lit("# head\n"), "text")).withColumn("format", F.lit("netset"))
    return network_lines(files).groupBy("snapshot_id", "indicator_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("indicator").alias("kinds"), F.min(F.substring("notes", 6, 9).cast("int")).alias("first_line"))


def c1_canonical(spark, sf_dir):
    """Addresses with host bits, masks and prefix lengths in canonical form."""
    obs = observations(spark, sf_dir).where("indicator_type = 'ip'").select("indicator").distinct()
    kinds = F.array(F.col("indicator"), F.concat("indicator", F.lit("/20")), F.concat("indicator", F.lit("/255.255.255.240")), F.concat("indicator", F.lit("/33")), F.concat("indicator", F.lit("x")))
    rows = obs.select("indicator", F.explode(kinds).alias("given")).withColumn("p", parsed(F.col("given")))
    return rows.select("given", F.coalesce("p.kind", F.lit("")).alias("kind"), F.coalesce("p.text", F.lit("")).alias("canonical"), F.coalesce(n_addresses(F.col("p.version"), F.col("p.bits")).cast("long"), F.lit(0)).alias("addresses"))


def c20_minimal(spark, sf_dir):
    """All listed networks of a day as the least list of networks, with its number and addresses."""
    rows = registry(spark, sf_dir)
    least = intervals.least(intervals.disjoint(rows, ["day"]), ["day"], width=32)
    return least.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("networks"), F.sum(n_addresses(F.lit(4), F.col("bits"))).cast("long").alias("addresses"))


def c20_range_networks(spark, sf_dir):
    """The merged ranges of a day's registry, each cut into its least list of networks."""
    out = intervals.merged(registry(spark, sf_dir), ["day"])
    nets = out.select("day", "version", F.explode(range_networks(F.col("version"), F.col("low"), F.col("next"))).alias("bits"))
    return nets.select(F.col("day").cast("string").alias("day"), network_text(F.col("version"), F.col("bits")).alias("network"))


def c20_feed_spans(spark, sf_dir):
    """The span from a feed's least to its greatest address of a day as networks: any range, not one made of networks."""
    rows = observations(spark, sf_dir).where("indicator_type = 'ip'").select("source_name", F.substring("retrieved_at_utc", 1, 10).alias("day"), parsed(F.col("indicator")).alias("p"))
    spans = rows.groupBy("source_name", "day", "p.version").agg(F.min("p.bits").alias("low"), F.max("p.bits").alias("high"))
    nets = spans.select("source_name", "day", "version", F.explode(range_networks(F.col("version"), F.col("low"), intervals.bound_next(F.col("version"), F.col("high")))).alias("bits"))
    return nets.select("source_name", "day", network_text(F.col("version"), F.col("bits")).alias("network"))


def _dates(df: DataFrame, *names: str) -> DataFrame:
    """Dates as text, so that results compare across engines."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def _longs(df: DataFrame, day: str, *names: str) -> DataFrame:
    return _dates(df, day).withColumns({n: F.col(n).cast("long") for n in names})


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        a1_daily_summary, a2_persistence, a3_sketched_overlap, a3_source_overlap, a4_snapshot_index, a5_two_day_summary, a6_evidence_classes, a7_label_counts, a8_study_daily, a9_exclusive, a10_source_statistics, a11_frequencies, a13_dataset_profile,
        a14_changes_by_source, a15_complete_days, a18_address_changes, c1_canonical, c4_domains, c7_digests, c8_json_keys, c20_feed_spans, c20_matched_networks, c20_minimal, c20_range_networks, d2_comparison_index, d3_scoped_comparison, d4_scope_changes,
        d5_registry_classes, d6_fixed_registry, d8_coverage, d9_chart_series, f8_large_changes, f9_first_and_last, j5_two_day_changes, j8_same_day_overlap, j13_all_pairs, m1_planned_and_done, m2_median_counts, m3_labels_by_source,
        m4_persistence_summary, m5_in_many_sources, m6_candidates, m7_metadata_completeness, m8_enrichment_completeness, o3_top_keys, q2_observation_checks, q6_study_report, q7_readiness, q9_identities, q11_summary_guard,
        s3_network_lines, w2_latest_snapshot, w3_selected_snapshots, w4_study_persistence, w5_merged_ranges, w6_registry_space, w7_missing_days,
    )
}
