"""Comparison of two days, by the latest snapshot of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftledger.functions.scalars import percent_change, valid_day
from driftledger.operators import snapshots


def status(observations: DataFrame, previous: str | None = None, current: str | None = None) -> tuple[str, str | None, str | None, list[str]]:
    """(ready, not_ready or error, previous day, current day, days there are): by default the last two days.

    The distinct days, at most one per calendar day, come to the driver.
    """
    if previous and current and previous > current:
        raise ValueError("the previous day is after the current day")
    found = observations.select(valid_day(F.col("retrieved_at_utc")).alias("d")).where("d is not null").distinct()
    days = sorted(str(r.d) for r in found.collect())
    if len(days) < 2 and not (previous and current):
        return "not_ready", previous, current, days
    current = current or days[-1]
    previous = previous or max((d for d in days if d < current), default=None)
    if not previous or previous == current:
        return "not_ready", previous, current, days
    return ("ready" if {previous, current} <= set(days) else "error"), previous, current, days


def _two_days(observations: DataFrame, previous: str, current: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all sources with both snapshots' heads, keys with sides, types): both days are read in one pass."""
    sources = observations.select(F.col("source_name").alias("source")).where("source <> ''").distinct()
    day = valid_day(F.col("retrieved_at_utc"))
    rows = observations.where(day.isin(F.lit(previous).cast("date"), F.lit(current).cast("date")))
    side = F.when(F.col("day") == F.lit(previous).cast("date"), "p").otherwise("c")
    heads = snapshots.latest_index(rows).select(F.col("source_name").alias("source"), side.alias("side"), F.struct(F.col("snapshot").alias("snapshot_id"), "retrieved_at_utc", "source_path", "sha256", "indicator_count").alias("head"))
    both = heads.groupBy("source").agg(F.max(F.when(F.col("side") == "p", F.col("head"))).alias("p"), F.max(F.when(F.col("side") == "c", F.col("head"))).alias("c"))
    keys = snapshots.keys_of(snapshots.latest(rows)).select(F.col("source_name").alias("source"), side.alias("side"), "indicator_type", "indicator", F.struct("retrieved_at_utc", "source_path", "sha256").alias("row"))
    sided = keys.groupBy("source", "indicator_type", "indicator").agg(F.max(F.when(F.col("side") == "p", F.col("row"))).alias("p_row"), F.max(F.when(F.col("side") == "c", F.col("row"))).alias("c_row"))
    return sources.join(both, "source", "left"), sided, keys.select("indicator_type").distinct()


def summary(observations: DataFrame, previous: str, current: str) -> DataFrame:
    """One row per source and type of key: counts of both days and what came, went and stayed.

    A source without a snapshot on a side keeps the other side's count and null
    for the rest: missing is not empty.
    """
    sources, sided, types = _two_days(observations, previous, current)
    counts = sided.groupBy("source", "indicator_type").agg(
        F.count("p_row").alias("n_p"), F.count("c_row").alias("n_c"), F.count_if(F.col("p_row").isNotNull() & F.col("c_row").isNotNull()).alias("n_b")
    )
    # the kinds of keys (four in valid input) go to every source as one array
    frame = sources.join(types.groupBy().agg(F.collect_set("indicator_type").alias("types"))).select("*", F.explode("types").alias("indicator_type")).drop("types")
    rows = frame.join(counts, ["source", "indicator_type"], "left").fillna(0, ["n_p", "n_c", "n_b"])
    has_p, has_c = F.col("p").isNotNull(), F.col("c").isNotNull()
    both = lambda c: F.when(has_p & has_c, c)
    n_p, n_c, n_b = F.col("n_p"), F.col("n_c"), F.col("n_b")
    gap = F.datediff(F.lit(current).cast("date"), F.lit(previous).cast("date"))
    text = lambda c: F.coalesce(c, F.lit(""))
    found = lambda c: F.when(c, "selected").otherwise("missing")
    return rows.select(
        "source", "indicator_type", F.lit(previous).alias("previous_day"), F.lit(current).alias("current_day"), text("p.snapshot_id").alias("previous_snapshot_id"), text("c.snapshot_id").alias("current_snapshot_id"),
        found(has_p).alias("previous_snapshot_status"), found(has_c).alias("current_snapshot_status"), text("p.retrieved_at_utc").alias("previous_retrieved_at_utc"), text("c.retrieved_at_utc").alias("current_retrieved_at_utc"),
        F.when(has_p, n_p).alias("previous_count"), F.when(has_c, n_c).alias("current_count"), both(n_c - n_b).alias("added_count"), both(n_p - n_b).alias("removed_count"), both(n_b).alias("unchanged_count"),
        both(n_c - n_p).alias("net_change"), both(percent_change(n_p, n_c)).alias("percent_change"), gap.alias("calendar_gap_days"), F.when(gap == 1, "yes").otherwise("no").alias("consecutive_calendar_days"),
        F.when(~has_p, "missing_previous_snapshot").when(~has_c, "missing_current_snapshot").otherwise("compared").alias("comparison_status"),
    )


def changes(observations: DataFrame, previous: str, current: str) -> DataFrame:
    """One row per key that came or went, of sources with a snapshot on both days."""
    sources, sided, _ = _two_days(observations, previous, current)
    rows = sided.where("p_row is null or c_row is null").join(sources.where("p is not null and c is not null"), "source")
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "source", "indicator_type", "indicator", F.when(F.col("p_row").isNull(), "added").otherwise("removed").alias("change"), F.lit(previous).alias("previous_day"), F.lit(current).alias("current_day"),
        F.col("p.snapshot_id").alias("previous_snapshot_id"), F.col("c.snapshot_id").alias("current_snapshot_id"), text("p_row.retrieved_at_utc").alias("previous_retrieved_at_utc"), text("c_row.retrieved_at_utc").alias("current_retrieved_at_utc"),
        text("p_row.source_path").alias("previous_source_path"), text("c_row.source_path").alias("current_source_path"), text("p_row.sha256").alias("previous_sha256"), text("c_row.sha256").alias("current_sha256"),
    )


def snapshot_index(observations: DataFrame, previous: str, current: str) -> DataFrame:
    """Which snapshot stood for each source on either side."""
    sources, _, _ = _two_days(observations, previous, current)
    sides = F.array(F.struct(F.lit("previous").alias("role"), F.lit(previous).alias("day"), F.col("p").alias("h")), F.struct(F.lit("current").alias("role"), F.lit(current).alias("day"), F.col("c").alias("h")))
    text = lambda c: F.coalesce(c, F.lit(""))
    return sources.select("source", F.explode(sides).alias("s")).select(
        "s.role", "source", F.col("s.day").alias("snapshot_day"), F.when(F.col("s.h").isNull(), "missing").otherwise("selected").alias("status"), text("s.h.snapshot_id").alias("snapshot_id"),
        text("s.h.retrieved_at_utc").alias("retrieved_at_utc"), text("s.h.source_path").alias("source_path"), text("s.h.sha256").alias("sha256"), F.coalesce("s.h.indicator_count", F.lit(0)).cast("long").alias("indicator_count"),
    )


def changes_by_source(summarised: DataFrame) -> DataFrame:
    """Added and removed keys of each compared source, for a chart."""
    return summarised.where("added_count is not null and removed_count is not null").groupBy("source").agg(F.sum("added_count").alias("added"), F.sum("removed_count").alias("removed"))
