"""Checks of inputs and results as rows: name, status (PASS, WARN, FAIL), value, message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftledger.functions.scalars import portable_path, valid_day
from driftledger.schemas import COLLECTION_LOG, OBSERVATION

#: Distinct days that a month-scale study needs.
MONTH_DAYS = 30
#: States of a logged download.
LOG_STATES = ("ok", "failed", "skipped")


def _check(found: DataFrame, name: str, bad: str = "FAIL", examples: str | None = None) -> DataFrame:
    """One row from the rows at fault: PASS if there are none; up to four examples in order."""
    n = F.count(F.lit(1))
    out = found.agg(F.lit(name).alias("name"), F.when(n == 0, "PASS").otherwise(bad).alias("status"), n.alias("value"))
    if not examples:
        return out.withColumn("message", F.lit(""))
    first = found.select(F.col(examples).cast("string").alias("x")).where("x is not null").distinct().orderBy("x").limit(4)
    # two rows of one: a count and at most four values
    return out.join(first.agg(F.array_join(F.array_sort(F.collect_list("x")), ", ").alias("message")))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def collection_log(log: DataFrame, files: DataFrame) -> DataFrame:
    """Log columns and states, and whether logged files exist with the logged size and digest.

    files: (path, bytes, sha256) with portable paths.
    """
    if list(log.columns[: len(COLLECTION_LOG.names)]) != COLLECTION_LOG.names:
        return log.sparkSession.createDataFrame([("log columns", "FAIL", 1, ", ".join(log.columns))], "name string, status string, value long, message string")
    have = files.select(F.col("path").alias("_p"), F.col("bytes").alias("_b"), F.col("sha256").alias("_d"))
    kept = log.where("lower(status) = 'ok'").withColumn("portable", portable_path(F.col("path"))).join(have, F.col("portable") == F.col("_p"), "left")
    return union(
        [
            _check(log.where(~F.lower("status").isin(*LOG_STATES)), "log states", examples="status"),
            _check(kept.where("_p is null"), "logged files exist", examples="path"),
            _check(kept.where(F.col("_p").isNotNull() & ~F.col("_b").eqNullSafe(F.col("bytes").try_cast("bigint"))), "logged sizes", examples="path"),
            _check(kept.where(F.col("_p").isNotNull() & ~F.col("_d").eqNullSafe(F.lower("sha256"))), "logged digests", examples="path"),
        ]
    )


def observations(rows: DataFrame) -> DataFrame:
    """Identity fields, days, digests and day coverage of normalized rows, in one pass over them."""
    if missing := [c for c in OBSERVATION.names if c not in rows.columns]:
        return rows.sparkSession.createDataFrame([("observation columns", "FAIL", len(missing), ", ".join(missing))], "name string, status string, value long, message string")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    faults = {
        "identity fields": blank("snapshot_id") | blank("source_name") | blank("indicator_type") | blank("indicator"),
        "observation days": valid_day(F.col("retrieved_at_utc")).isNull(),
        "digests": ~F.coalesce(F.col("sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)),
    }
    counted = rows.agg(*(F.count_if(c).alias(n) for n, c in faults.items()), F.count(F.lit(1)).alias("rows"), F.count_distinct(valid_day(F.col("retrieved_at_utc"))).alias("days"))
    state = lambda name, ok, bad, n: F.struct(F.lit(name).alias("name"), F.when(ok, "PASS").otherwise(bad).alias("status"), n.cast("long").alias("value"), F.lit("").alias("message"))
    out = [state("rows", F.col("rows") > 0, "FAIL", F.col("rows"))]
    out += [state(n, F.col(n) == 0, "FAIL", F.col(n)) for n in faults]
    out.append(state("day coverage", F.col("days") >= MONTH_DAYS, "WARN", F.col("days")))
    return counted.select(F.explode(F.array(*out)).alias("c")).select("c.*")


def outputs(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Whether the outputs that manifests list exist with the listed digests. files: (path, sha256)."""
    listed = manifests.select("run_id", F.explode("outputs").alias("o")).select("run_id", "o.path", "o.sha256")
    joined = listed.join(files.select("path", F.col("sha256").alias("found")), "path", "left")
    return union([_check(joined.where("found is null"), "outputs exist", examples="path"), _check(joined.where("found is not null and found <> sha256"), "output digests", examples="path")])


def runs(manifests: DataFrame) -> DataFrame:
    """Run records: known states, and ids that are their folder's names."""
    folder = F.element_at(F.split("manifest_path", "/"), -2)
    return union(
        [
            _check(manifests.where(~F.coalesce("status", F.lit("")).isin("running", "completed", "completed_with_warnings", "failed", "not_ready", "ready")), "run states", examples="run_id"),
            _check(manifests.where(~F.col("run_id").eqNullSafe(folder)), "run folders", "WARN", examples="run_id"),
        ]
    )


def overall(checks: DataFrame) -> DataFrame:
    """failed if any check failed, else passed_with_warnings or passed."""
    state = F.when(F.count_if(F.col("status") == "FAIL") > 0, "failed").when(F.count_if(F.col("status") == "WARN") > 0, "passed_with_warnings").otherwise("passed")
    return checks.agg(state.alias("status"), F.count(F.lit(1)).alias("checks"))


def report(rows: DataFrame, notes: DataFrame, classified: DataFrame, comparisons: DataFrame) -> DataFrame:
    """The six checks of a study: day coverage, calendar gaps, parser notes, classification, domains, comparisons."""
    day = valid_day(F.col("retrieved_at_utc"))
    facts = rows.agg(
        F.count_distinct(day).alias("days"), (F.datediff(F.max(day), F.min(day)) + 1 - F.count_distinct(day)).alias("gaps"), F.count_if(F.col("indicator_type") == "domain").alias("domains")
    )
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    # four rows of one number each
    facts = facts.join(one(notes, "notes")).join(one(classified, "classified")).join(one(comparisons, "comparisons"))
    c = F.col
    checks = [
        ("30-day coverage", c("days") >= MONTH_DAYS, c("days")), ("calendar gaps", F.coalesce(c("gaps"), F.lit(0)) == 0, F.coalesce(c("gaps"), F.lit(0))), ("parser notes", c("notes") == 0, c("notes")),
        ("Danish classification", c("classified") > 0, c("classified")), ("domain observations", c("domains") > 0, c("domains")), ("comparison coverage", c("comparisons") >= F.greatest(c("days") - 1, F.lit(0)), c("comparisons")),
    ]
    out = F.array(*(F.struct(F.lit(n).alias("check"), F.when(ok, "PASS").otherwise("WARN").alias("status"), v.cast("long").alias("value")) for n, ok, v in checks))
    return facts.select(F.explode(out).alias("x")).select("x.*")


def readiness(days: DataFrame, least: int = MONTH_DAYS) -> DataFrame:
    """Whether so many distinct days are there: final results, else a preview only."""
    n = F.count_distinct("day")
    return days.agg(n.alias("days"), F.when(n >= least, "ready").otherwise("preview_only").alias("readiness"))


def _issue(df: DataFrame, severity: str, code: Column | str, detail: Column | str, source: str = "source_name", day: str = "day") -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(F.lit(severity).alias("severity"), text(code).alias("code"), F.coalesce(F.col(day).cast("string"), F.lit("")).alias("date"), F.coalesce(F.col(source), F.lit("")).alias("source"), text(detail).alias("detail"))


def issues(selected: DataFrame, snapshots: DataFrame, log: DataFrame | None, daily: DataFrame, compared: DataFrame, bad_evidence: DataFrame | None = None) -> DataFrame:
    """The issue log of a study, each rule a table with the same columns."""
    detail = F.concat(F.lit("Snapshot "), "snapshot_id", F.lit("; invalid="), F.col("invalid_rows").cast("string"), F.lit("; conflicts="), F.col("conflicts").cast("string"))
    parts = [
        _issue(selected.where("blocked is not null"), "ERROR", F.when(F.col("blocked") == "newer_download_not_normalized", "source_day_blocked").otherwise(F.col("blocked")), detail),
        _issue(selected.where("raw_status = 'raw_file_not_found'"), "WARN", "raw_file_not_found", F.col("source_path")),
        _issue(daily.where("status <> 'usable'"), "WARN", "source_day_unavailable", F.col("status"), "source"),
        _issue(
            compared.where((F.col("scope") == "GLOBAL_IP_CIDR") & (F.abs("percent_change") >= 40)), "WARN", "large_count_change_review",
            F.concat(F.col("percent_change").cast("string"), F.lit("% from "), F.col("previous_date").cast("string")), "source", "current_date",
        ),
    ]
    if log is not None:
        have = snapshots.select(F.col("source_name").alias("source"), "at", "sha256").distinct()
        parts += [
            _issue(log.where("at is null"), "WARN", "invalid_collection_log_time", F.col("retrieved_at_utc"), "source"),
            _issue(log.where("succeeded and at is not null").join(have, ["source", "at", "sha256"], "left_anti"), "WARN", "download_not_in_normalized_input", F.col("path"), "source"),
            _issue(log.where("not succeeded and at is not null"), "WARN", "collection_attempt_not_successful", F.coalesce(F.nullif("notes", F.lit("")), F.col("status")), "source"),
        ]
    if bad_evidence is not None:
        parts.append(_issue(bad_evidence.where("problem is not null").withColumn("none", F.lit("")), "WARN", "invalid_evidence_cache", F.col("problem"), "none", "requested_date"))
    return union(parts)


def study_status(found: DataFrame, complete: DataFrame, least: int = MONTH_DAYS) -> DataFrame:
    """Errors, warnings, complete days and what the study may be used for."""
    tally = found.agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARN").alias("warnings"))
    days = complete.agg(F.count_distinct("day").alias("complete_days"))
    state = F.when(F.col("errors") > 0, "blocked").when(F.col("complete_days") < least, "interim").otherwise("month_scale")
    return tally.join(days).withColumn("readiness", state)


def identities(compared: DataFrame, daily: DataFrame) -> DataFrame:
    """Rows that break a sum: parts of a count that do not add up to it."""
    a = compared.where("status = 'compared' and (added_count + unchanged_count <> current_count or removed_count + unchanged_count <> previous_count)").select(F.lit("comparison").alias("of"), "source", F.col("current_date").alias("day"))
    b = daily.where("full is not null and full + partial + no_match <> global_ip_cidr").select(F.lit("daily").alias("of"), "source", "day")
    return a.unionByName(b)


def summary_guard(summary: DataFrame) -> DataFrame:
    """Rows of a saved summary at fault: no strict date, a blank source, or a source twice on a day."""
    day = valid_day(F.col("snapshot_day"))
    exact = F.coalesce(F.length("snapshot_day") == 10, F.lit(False)) & day.isNotNull()
    bad = summary.where(~exact | (F.coalesce(F.trim("source"), F.lit("")) == "")).select("snapshot_day", "source", F.lit("invalid").alias("problem"))
    twice = summary.groupBy("snapshot_day", "source").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("snapshot_day", "source", F.lit("repeated").alias("problem"))
    return bad.unionByName(twice)


def changed_inputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (path, sha256) that differ between the start and the end of a run."""
    b = after.select("path", F.col("sha256").alias("later"))
    return before.join(b, "path", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("later"))).select("path")


def planned_and_done(log: DataFrame, calendar: DataFrame) -> DataFrame:
    """Planned, successful and failed days of each source over a calendar."""
    per_day = log.where("at is not null").groupBy("source", "day").agg(F.max("succeeded").alias("ok"))
    inside = per_day.join(F.broadcast(calendar), "day", "left_semi").groupBy("source").agg(F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"))
    return inside.join(calendar.agg(F.count_distinct("day").alias("planned"))).select("source", "planned", "successful", "failed")
