"""What is known of past runs and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftledger.operators.ordering import numbered


def comparison_coverage(manifests: DataFrame) -> DataFrame:
    """The latest comparison of each two days, with its number of missing snapshots."""
    ready = manifests.where("previous_day is not null and current_day is not null and previous_day <> '' and current_day <> ''")
    last = ready.groupBy("previous_day", "current_day").agg(F.max_by(F.struct("run_id", "status", "missing_source_snapshots"), F.struct("generated_at_utc", "run_id")).alias("m"), F.max("generated_at_utc").alias("generated_at_utc"), F.count(F.lit(1)).alias("versions"))
    return last.select("previous_day", "current_day", "generated_at_utc", "m.run_id", "m.status", F.coalesce(F.size("m.missing_source_snapshots"), F.lit(0)).alias("missing_sources"), "versions")


def run_kinds(manifests: DataFrame) -> DataFrame:
    """What each run was, and its date and time from its id."""
    kind = F.when(F.col("collection_status") == "succeeded", "daily collection").when(F.col("collection_status") == "skipped", "replay").when(F.col("collection_status") == "failed", "collection failed").otherwise("pipeline run")
    stamp = F.try_to_timestamp(F.element_at(F.split("run_id", "_run_"), 1), F.lit("yyyyMMdd'T'HHmmssX"))
    return manifests.select("run_id", kind.alias("kind"), F.to_date(stamp).alias("run_day"), F.date_format(stamp, "HH:mm:ss").alias("run_time"), "status")


def newest_first(table: DataFrame, by: str = "generated_at_utc", name: str = "run_id") -> DataFrame:
    """Catalogue rows numbered from the newest."""
    return numbered(table, [F.col(by).desc(), F.col(name).desc()])


def runs_of_day(manifests: DataFrame, day: str) -> DataFrame:
    """Runs whose data cover a day."""
    return manifests.where(F.array_contains("normalized.distinct_snapshot_days", day))


def status_counts(observations: DataFrame, manifests: DataFrame) -> DataFrame:
    """Rows, days, runs and compared pairs of days."""
    rows = observations.agg(F.count(F.lit(1)).alias("observation_rows"), F.count_distinct(F.substring("retrieved_at_utc", 1, 10)).alias("days"))
    pair = F.when((F.col("previous_day") != "") & (F.col("current_day") != ""), F.struct("previous_day", "current_day"))
    return rows.join(manifests.agg(F.count_distinct("run_id").alias("runs"), F.count_distinct(pair).alias("comparisons")))


def preview(table: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The first n rows in an order: a top-k report."""
    return table.orderBy(*order).limit(n)
