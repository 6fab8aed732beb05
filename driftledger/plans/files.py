"""Registered queries over files: feeds, raw files, registry evidence, runs, checks and written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftledger.checkpoints import fresh_folder, written
from driftledger.functions import scalars
from driftledger.functions.addresses import parsed
from driftledger.operators import catalog, ordering, quality, snapshots, summary
from driftledger.operators.study import Study
from driftledger.plans import adapter
from driftledger.plans.queries import CURRENT, Query, a1_daily_summary, log, observations, selection, study, study_of
from driftledger.schemas import DAILY_SUMMARY
from driftledger.sources import feeds, sinks, tables
from driftledger.sources import registry as dated_registry
from driftledger.sources.tables import MANIFEST, read_csv

#: A source that a study expects and that never delivered.
EXPECTED = "expected_feed"


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.of_half_days(spark, sf_dir, adapter.RAW_FILES)


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run manifests in the shape of saved ones. A run lists one output for each source."""
    runs = adapter.table(spark, sf_dir, adapter.RUNS)
    listed = adapter.of_half_days(spark, sf_dir, adapter.OUTPUTS).groupBy("run_id").agg(F.collect_list(F.struct("path", "sha256")).alias("outputs"))
    out = runs.join(listed, "run_id", "left")
    out = out.withColumns(
        {
            "missing_source_snapshots": F.array_repeat(F.lit("x"), F.col("missing").cast("int")),
            "normalized": F.struct(F.array("current_day").alias("distinct_snapshot_days"), F.col("n_rows").alias("rows")),
            "manifest_path": F.concat(F.lit("data/runs/"), "folder", F.lit("/manifest.json")),
        }
    )
    return out.select(*(c for c in MANIFEST.names if c != "_corrupt"), "manifest_path")


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, modificationTime, content): each half day of a feed in four formats and in one that no parser knows.

    A file holds at most 4,096 events; each ends in a remark with a byte that is no UTF-8.
    Events come together as what they have in common in all formats, and become lines there.
    """
    rows = adapter.table(spark, sf_dir, adapter.FEED_LINES)
    lines = rows.groupBy("s", "stamp", "part", "n").agg(F.collect_list(F.struct("k", "ip", "cidr", "u")).alias("events"))
    key = F.when(F.col("n") % 2 == 0, "cidr").otherwise("network")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    broken = lambda e: (F.col("n") % 9 == 4) & (e["k"] % 7 == 0)  # noqa: E731  (a file with such a line is refused)
    seen = lambda e: F.concat(e["ip"], F.lit(" # seen"))
    item = lambda e: F.concat(F.lit("{"), quoted(key), F.lit(": "), quoted(e["cidr"]), F.lit(', "sblid": "S'), e["u"], F.when(broken(e), '"').otherwise('"}'))
    url = lambda e: F.concat(e["k"].cast("string"), F.lit(',"http://H'), e["u"], F.lit('.Example.org/a,b",online,"say ""x"""'))
    shapes = (
        ("firehol", "netset", seen, "; head"), ("blocklist", "txt", lambda e: e["ip"], "# head"), ("spamhaus", "json", item, "# head"),
        ("urlhaus", "csv", url, "id,url,url_status,threat"), ("unrouted", "txt", lambda e: e["ip"], "# head"),
    )
    shaped = [F.struct(F.lit(n).alias("feed"), F.lit(x).alias("ending"), F.array_join(F.sort_array(F.transform("events", v)), "\r\n").alias("body"), F.lit(h).alias("head")) for n, x, v, h in shapes]
    files = lines.select("s", "stamp", "part", F.explode(F.array(*shaped)).alias("f")).select("s", "stamp", "part", "f.*")
    name = F.concat("feed", F.lit("_"), "s", F.lit("_"), "part", F.lit("_"), "stamp", F.lit("."), "ending")
    body = F.concat(F.encode(F.concat("head", F.lit("\r\n"), "body", F.lit("\n# ")), "UTF-8"), F.unhex(F.lit("FF")))
    return files.select(F.concat(F.lit("/lake/data/raw/"), "s", F.lit("/"), name).alias("path"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("modificationTime"), body.alias("content"))


def feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once, since each parser reads them."""
    return written(feed_lines(spark, sf_dir))


def s4_feed_formats(spark, sf_dir):
    """Files of four formats through names, tolerant decoding and parsers, counted by feed, kind and time."""
    rows = feeds.observations(feeds.described(feed_files(spark, sf_dir)))
    return rows.groupBy("source_name", "indicator_type", "retrieved_at_utc").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("indicator").alias("indicators"), F.count_distinct("snapshot_id").alias("snapshots"), F.min("indicator").alias("least"), F.max("reason").alias("reason"), F.max(F.length("sha256")).alias("digest_length")
    )


def s7_parse_notes(spark, sf_dir):
    """Files without rows, with the reason: no parser for their name, or a parser that refused them."""
    files = feeds.described(feed_files(spark, sf_dir))
    return feeds.parse_notes(files, feeds.observations(files))


def j11_raw_files(spark, sf_dir):
    """Selected snapshots against their raw files, with both ways to find a logged download."""
    _, found, _ = selection(spark, sf_dir)
    parts = [snapshots.selected(found, log(spark, sf_dir), raw_files(spark, sf_dir), log_match=m).withColumn("log_match", F.lit(m)) for m in ("exact", "digest")]
    return quality.union(parts).select("log_match", "source_name", F.col("day").cast("string").alias("day"), "snapshot_id", "raw_status", F.coalesce("blocked", F.lit("")).alias("blocked"))


def j12_logged_files(spark, sf_dir):
    return quality.collection_log(adapter.of_half_days(spark, sf_dir, adapter.COLLECTION_LOG), raw_files(spark, sf_dir))


def q3_outputs(spark, sf_dir):
    return quality.outputs(manifests(spark, sf_dir), raw_files(spark, sf_dir))


def q4_runs(spark, sf_dir):
    return quality.runs(manifests(spark, sf_dir))


def q5_overall(spark, sf_dir):
    return quality.overall(quality.union([j12_logged_files(spark, sf_dir), q3_outputs(spark, sf_dir), q4_runs(spark, sf_dir)]))


def q10_changed_inputs(spark, sf_dir):
    """Raw files that differ between what runs listed and what lies there."""
    before = adapter.of_half_days(spark, sf_dir, adapter.OUTPUTS).select("path", "sha256")
    return quality.changed_inputs(before, raw_files(spark, sf_dir))


def a17_comparison_coverage(spark, sf_dir):
    return catalog.comparison_coverage(manifests(spark, sf_dir))


def a19_status_counts(spark, sf_dir):
    return catalog.status_counts(observations(spark, sf_dir), manifests(spark, sf_dir))


def c21_run_kinds(spark, sf_dir):
    return catalog.run_kinds(manifests(spark, sf_dir)).withColumn("run_day", F.col("run_day").cast("string"))


def w10_newest_runs(spark, sf_dir):
    return catalog.newest_first(manifests(spark, sf_dir)).select("place", "run_id", "generated_at_utc")


def f10_runs_of_day(spark, sf_dir):
    return catalog.runs_of_day(manifests(spark, sf_dir), CURRENT).select("run_id", "status", F.col("normalized.rows").alias("n_rows"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry responses, one file a day, with metadata that some of them contradict. A day has two versions of its metadata."""
    rows = written(adapter.table(spark, sf_dir, adapter.REGISTRY).groupBy("day").agg(F.array_sort(F.collect_set("prefix")).alias("ipv4")))
    n, day = F.dayofmonth("day"), F.col("day").cast("string")
    v6 = F.when(n % 7 == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("2001:db8::/32")))
    v4 = F.when(n % 11 == 4, F.concat("ipv4", F.array(F.lit("10.0.0.1/8")))).otherwise(F.col("ipv4"))
    body = F.to_json(
        F.struct(
            F.when(n % 6 == 2, "error").otherwise("ok").alias("status"),
            F.struct(F.when(n % 8 == 5, "2023-12-31T00:00:00").otherwise(F.concat(day, F.lit("T00:00:00"))).alias("query_time"), F.when(n % 10 == 6, "se").otherwise("dk").alias("resource"), F.struct(v4.alias("ipv4"), v6.alias("ipv6")).alias("resources")).alias("data"),
        )
    )
    files = rows.select("day", F.concat(F.lit("/lake/registry/"), day, F.lit(".json")).alias("path"), F.encode(body, "UTF-8").alias("content"), n.alias("n"))
    digest = F.when((F.col("version") == 1) | (F.col("n") % 9 == 7), F.lit("0")).otherwise(F.sha2("content", 256))
    text = lambda c: F.col(c).cast("string")
    meta = files.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.when(F.col("n") % 13 == 11, "SE").otherwise("DK").alias("country"), text("day").alias("requested_date"), text("day").alias("query_time"), text("day").alias("retrieved_at_utc"), F.lit("").alias("url"),
        F.when(F.col("n") % 12 == 10, "lost.json").otherwise(F.concat(text("day"), F.lit(".json"))).alias("response_file"), digest.alias("sha256"), F.lit(1).alias("ipv4_prefixes"), F.lit(1).alias("ipv6_prefixes"),
        F.concat(F.lit("/lake/registry/"), text("day"), F.lit("_v"), text("version"), F.lit(".meta.json")).alias("metadata_path"),
    )
    return dated_registry.checked(dated_registry.dated(meta, files.select("path", "content")))


def s12_registry_checks(spark, sf_dir):
    return evidence(spark, sf_dir).select("requested_date", "metadata_path", F.coalesce("problem", F.lit("")).alias("problem"))


def s11_registry_networks(spark, sf_dir):
    """Networks of usable evidence by day and version. A response with a network that has host bits is refused as a whole."""
    nets = dated_registry.networks(evidence(spark, sf_dir))
    return nets.groupBy(F.col("day").cast("string").alias("day"), "version").agg(F.count(F.lit(1)).alias("networks"))


def d10_evidence_index(spark, sf_dir):
    return dated_registry.evidence_index(evidence(spark, sf_dir)).select("country", "requested_date", "response_file", "metadata_path", "response_path")


def x6_expected_sources(spark, sf_dir):
    """Coverage and complete days with a feed that is expected and never came."""
    s = study(spark, sf_dir)
    wanted = s.sources.unionByName(spark.range(1).select(F.lit(EXPECTED).alias("source"))).distinct()
    full = Study(s.calendar, wanted, s.usable, s.members, s.named, s.country)
    days = full.complete_days().agg(F.count(F.lit(1)).alias("complete_days"))
    return full.daily().groupBy("source").agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("status") == "usable").alias("usable_days"), F.sum("global_ip_cidr").alias("keys")).join(days)


def f11_study_window(spark, sf_dir):
    """The window that the observations themselves give, and one with a fixed start."""
    days = observations(spark, sf_dir).select(scalars.valid_day(F.col("retrieved_at_utc")).alias("day"))
    parts = [summary.study_window(days).withColumn("window", F.lit("default")), summary.study_window(days, start=CURRENT).withColumn("window", F.lit("from a day"))]
    return quality.union(parts).select("window", F.col("day").cast("string").alias("day"))


def c19_portable_paths(spark, sf_dir):
    """Paths of all snapshots as other machines wrote them."""
    paths = observations(spark, sf_dir).select("source_path").distinct()
    kinds = F.array(F.col("source_path"), F.concat(F.lit("C:\\work\\"), F.translate("source_path", "/", "\\")), F.concat(F.lit("/lake/"), "source_path"), F.concat(F.lit("my"), "source_path"), F.replace("source_path", F.lit("data/raw/"), F.lit("data/raw/../")))
    return paths.select(F.explode(kinds).alias("given")).select("given", F.coalesce(scalars.portable_path(F.col("given")), F.lit("")).alias("portable"))


def c5_snapshot_ids(spark, sf_dir):
    """Ids, times, slugs and aliases of file names with and without a stamp."""
    rows = observations(spark, sf_dir).select("source_name", "source_path", F.to_timestamp("retrieved_at_utc").alias("modified")).distinct()
    name = F.explode(F.array(scalars.file_name(F.col("source_path")), F.concat("source_name", F.lit("_20240229T010203Z.csv"))))
    rows = rows.withColumn("name", name)
    at = scalars.retrieved_at(F.col("name"), F.col("modified"))
    return rows.select("name", "source_name", at.alias("at"), scalars.snapshot_id(F.col("name"), at).alias("snapshot_id"), scalars.slug(F.concat(F.lit(" .Feed "), "source_name", F.lit("!"))).alias("slug")).distinct()


def k1_written_table(spark, sf_dir):
    """Observations written by source, read back and counted."""
    path = fresh_folder(spark)
    sinks.write_parquet(observations(spark, sf_dir), path, by=["source_name"])
    return spark.read.parquet(path).groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("snapshot_id").alias("snapshots"), F.count_distinct("indicator_type", "indicator").alias("indicators"))


def k2_split_tables(spark, sf_dir):
    """Classified keys and those in scope, written in one pass and read back."""
    path = fresh_folder(spark)
    sinks.write_classified(study(spark, sf_dir).members.select("day", "source", "indicator_type", "indicator", "label", "matched"), path)
    parts = [sinks.classified(spark, path, only).groupBy("source", F.lit(t).alias("table")).agg(F.count(F.lit(1)).alias("n"), F.sum("matched").cast("long").alias("addresses")) for t, only in (("all", False), ("matched", True))]
    return quality.union(parts)


def k6_run_index(spark, sf_dir):
    """A run of two tables: rows of each, its files against the index that was written last, and a second run that is refused."""
    folder = fresh_folder(spark)
    tables = {"observations": observations(spark, sf_dir), "daily_summary": a1_daily_summary(spark, sf_dir)}
    sinks.commit_run(tables, folder, {"observations": ["source_name"]})
    try:
        sinks.commit_run(tables, folder)
        again = "written"
    except FileExistsError:
        again = "refused"
    changed = sinks.changed_files(spark, folder).groupBy("table").agg(F.count(F.lit(1)).alias("c"))
    files = sinks.run_index(spark, folder).groupBy("table").agg(F.count_if((F.col("bytes") < 1) | (F.length("sha256") != 64)).alias("bad_entries")).join(changed, "table", "left")
    rows = quality.union([sinks.read_run(spark, folder, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), "n") for t in tables])
    return rows.join(files, "table").select("table", "n", "bad_entries", F.coalesce("c", F.lit(0)).alias("changed_files"), F.lit(again).alias("second_run"))


def o1_ordered_files(spark, sf_dir):
    """Keys written in order: how many of their files overlap the next one's range, and the rows read back."""
    path = fresh_folder(spark)
    order = ["source", "indicator_type", "indicator"]
    keys = observations(spark, sf_dir).select(F.col("source_name").alias("source"), "indicator_type", "indicator").distinct()
    ordering.in_ranges(keys, [F.col(c) for c in order]).write.parquet(path)
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(F.struct(*order)).alias("a"), F.max(F.struct(*order)).alias("b"), F.count(F.lit(1)).alias("n"))
    # one row a file
    steps = files.withColumn("next", F.lead("a").over(Window.orderBy("file")))
    return steps.agg(F.count_if(F.col("next") <= F.col("b")).alias("overlapping"), F.sum("n").alias("n"))


def o2_numbered_keys(spark, sf_dir):
    """Every key with its place in the order of source, kind and text."""
    keys = observations(spark, sf_dir).select(F.col("source_name").alias("source"), "indicator_type", "indicator").distinct()
    return ordering.numbered(keys, [F.col("source"), F.col("indicator_type"), F.col("indicator")])


def s13_manifest_files(spark, sf_dir):
    """Manifests as files of three versions, some cut short and one a list, read back field by field."""
    runs = manifests(spark, sf_dir)
    n = F.dayofmonth(F.to_date("current_day"))
    old = F.struct(
        "run_id", "status", "generated_at_utc", "previous_day", "current_day", F.struct(F.col("current_day").alias("distinct_snapshot_days"), F.col("normalized.rows").cast("string").alias("rows")).alias("normalized"),
        F.map_from_entries(F.transform(F.array_distinct(F.transform("outputs", lambda o: o["path"])), lambda p: F.struct(p, F.lit("x")))).alias("outputs"),
    )
    now = F.struct("run_id", "status", "generated_at_utc", "previous_day", "current_day", "normalized", "outputs")
    text = F.when(n % 5 == 1, F.to_json(old)).when(n % 5 == 2, F.substring(F.to_json(now), 1, 40)).when(n % 5 == 3, F.concat(F.lit("["), F.to_json(now), F.lit("]"))).when(n % 7 == 4, F.to_json(F.struct("status"))).otherwise(F.to_json(now))
    path = fresh_folder(spark)
    runs.select("run_id", text.alias("value")).write.partitionBy("run_id").text(path)
    texts = spark.read.text(path, wholetext=True).select(F.col("run_id").alias("folder"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    found = tables.manifest_fields(texts).join(texts.select("folder", "path"), "path")
    return found.select("folder", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("run_id", F.lit("")).alias("run_id"), F.coalesce("status", F.lit("")).alias("status"), "n_rows", F.array_join("days", ",").alias("days"), F.size("outputs").cast("long").alias("outputs"))


def k3_sources_apart(spark, sf_dir):
    """The daily summary in one folder for each source, read back by folder."""
    path = fresh_folder(spark)
    sinks.write_by_source(a1_daily_summary(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("source_slug").agg(F.count(F.lit(1)).alias("n"), F.sum("unique_indicators").alias("unique_indicators"))


def k4_exported_summary(spark, sf_dir):
    """The daily summary as CSV with NA for unknown numbers, read back as text by its header."""
    path = fresh_folder(spark)
    sinks.write_csv(a1_daily_summary(spark, sf_dir), path, columns=DAILY_SUMMARY.names, order=["snapshot_day", "source"])
    return read_csv(spark, path, DAILY_SUMMARY, strict=True)


def k4_empty_table(spark, sf_dir):
    """A summary of which no row is left still has its header: its columns, and its number of rows."""
    path = fresh_folder(spark)
    sinks.write_csv(a1_daily_summary(spark, sf_dir).where("raw_rows < 0"), path, columns=DAILY_SUMMARY.names)
    names = F.array(*(F.lit(c) for c in spark.read.option("header", True).csv(path).columns))
    return read_csv(spark, path, DAILY_SUMMARY).agg(F.count(F.lit(1)).alias("n")).select(F.array_join(names, ",").alias("header"), "n")


def k7_one_day(spark, sf_dir):
    """One day of the saved summary, exported."""
    path = fresh_folder(spark)
    sinks.export_day(a1_daily_summary(spark, sf_dir), CURRENT, path)
    return read_csv(spark, path, DAILY_SUMMARY).select("source", "snapshot_day", "unique_indicators", "raw_rows")


def _study_issues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Study]:
    rows, found, chosen = selection(spark, sf_dir)
    s = study_of(spark, sf_dir, rows, found, chosen)
    return quality.issues(chosen, found, log(spark, sf_dir), s.daily(), s.compare(), evidence(spark, sf_dir)), s


def q8_issues(spark, sf_dir):
    """The issue log of the study, with evidence that had to be refused."""
    return _study_issues(spark, sf_dir)[0].groupBy("severity", "code", "date", "source").agg(F.count(F.lit(1)).alias("n"))


def a16_study_status(spark, sf_dir):
    found, s = _study_issues(spark, sf_dir)
    return quality.study_status(found, s.complete_days())


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        a16_study_status, a17_comparison_coverage, a19_status_counts, c5_snapshot_ids, c19_portable_paths, c21_run_kinds, d10_evidence_index, f10_runs_of_day, f11_study_window, j11_raw_files, j12_logged_files, k1_written_table, k2_split_tables,
        k3_sources_apart, k4_empty_table, k4_exported_summary, k6_run_index, k7_one_day, o1_ordered_files, o2_numbered_keys, s13_manifest_files, q3_outputs, q4_runs, q5_overall, q8_issues, q10_changed_inputs, s4_feed_formats, s7_parse_notes, s11_registry_networks, s12_registry_checks, w10_newest_runs, x6_expected_sources,
    )
}
