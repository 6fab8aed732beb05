"""Which snapshot stands for a source on a day.

Three rules exist and are kept apart: all snapshots of the day together (the
daily summary), the latest (the two-day comparison), and the latest that nothing
speaks against (the study).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftledger.functions.addresses import parsed
from driftledger.functions.scalars import portable_path, valid_day, zoned_time
from driftledger.schemas import KINDS


def latest(observations: DataFrame) -> DataFrame:
    """Rows of the latest snapshot of each source and day, by text time and then id; with day and snapshot.

    A snapshot without an id goes by its path, and by 'unknown' without one.
    """
    ident = F.coalesce(F.nullif("snapshot_id", F.lit("")), F.nullif("source_path", F.lit("")), F.lit("unknown"))
    rows = observations.withColumn("day", valid_day(F.col("retrieved_at_utc"))).where("day is not null and source_name <> ''").withColumn("snapshot", ident)
    best = rows.groupBy("source_name", "day").agg(F.max(F.struct("retrieved_at_utc", "snapshot")).alias("best")).select("source_name", "day", F.col("best.snapshot").alias("snapshot"))
    # the latest time of a snapshot is that of its latest row, so the greatest row names the snapshot
    return rows.join(best, ["source_name", "day", "snapshot"], "left_semi")


def latest_index(observations: DataFrame) -> DataFrame:
    """One row for each source and day: the latest snapshot, its newest row's provenance and its number of keys."""
    rows = latest(observations)
    newest = F.max_by(F.struct("retrieved_at_utc", "source_path", "sha256"), F.struct("retrieved_at_utc", "source_path"))
    head = rows.groupBy("source_name", "day", "snapshot").agg(newest.alias("p")).select("source_name", "day", "snapshot", "p.*")
    return head.join(keys_of(rows).groupBy("source_name", "day").agg(F.count(F.lit(1)).alias("indicator_count")), ["source_name", "day"], "left").withColumn("indicator_count", F.coalesce("indicator_count", F.lit(0)).cast("long"))


def keys_of(rows: DataFrame) -> DataFrame:
    """One row per key of a snapshot, the newest entry's provenance; keys with a blank part are left out."""
    kind, value = F.trim("indicator_type"), F.trim("indicator")
    newest = F.max_by(F.struct("retrieved_at_utc", "source_path", "sha256"), F.struct("retrieved_at_utc", "source_path"))
    return rows.select("source_name", "day", "snapshot", kind.alias("indicator_type"), value.alias("indicator"), "retrieved_at_utc", "source_path", "sha256").where("indicator_type <> '' and indicator <> ''").groupBy("source_name", "day", "snapshot", "indicator_type", "indicator").agg(newest.alias("p")).select("source_name", "day", "snapshot", "indicator_type", "indicator", "p.*")


def checked_rows(observations: DataFrame) -> DataFrame:
    """Rows with time, day, canonical key and whether they are invalid.

    Raises on a row without a zoned time, a source or a snapshot id: a row
    without provenance must not be dropped in silence.
    """
    at = zoned_time(F.col("retrieved_at_utc"))
    kind, value = F.lower(F.trim("indicator_type")), F.trim("indicator")
    rows = observations.withColumn("source_name", F.trim("source_name")).withColumn("snapshot_id", F.trim("snapshot_id")).withColumn("at", at)
    sound = F.col("at").isNotNull() & (F.col("source_name") != "") & (F.col("snapshot_id") != "")
    rows = rows.withColumn("at", F.when(F.coalesce(sound, F.lit(False)), F.col("at")).otherwise(F.raise_error(F.lit("a row has no zoned time, source or snapshot id")).cast("timestamp")))
    rows = rows.withColumn("kind", kind).withColumn("value", value).withColumn("net", F.when(kind.isin("ip", "cidr"), parsed(value)))
    status = F.coalesce("status", F.lit("listed")) if "status" in observations.columns else F.lit("listed")
    address = F.col("kind").isin("ip", "cidr")
    good_net = F.coalesce((F.col("net.kind") == F.col("kind")) & ~F.col("net.host_bits"), F.lit(False)) | F.coalesce((F.col("kind") == "cidr") & (F.col("net.kind") == "ip"), F.lit(False))
    valid = F.coalesce(F.col("kind").isin(*KINDS) & (F.col("value") != "") & status.isin("", "listed"), F.lit(False)) & (~address | good_net)
    text = F.when((F.col("kind") == "cidr") & (F.col("net.kind") == "ip"), F.concat("net.text", F.lit("/"), F.length("net.bits").cast("string"))).otherwise(F.coalesce("net.text", "value"))
    return rows.withColumn("invalid", ~valid).withColumn("indicator", F.when(address, text).otherwise(F.col("value"))).withColumn("indicator_type", F.col("kind")).withColumn("day", F.to_date("at"))


def index(rows: DataFrame, order: str = "source_path") -> DataFrame:
    """One row per snapshot of checked rows: rows, unique keys, duplicates, invalid rows and conflicts.

    A conflict is a row whose time, path or digest differs from that of the
    snapshot's first row in the order of `order`, then of time, path and digest.
    Rows are counted by these before a snapshot's groups meet, so none is sorted.
    """
    snap, here = ["source_name", "day", "snapshot_id"], ["at", "source_path", "sha256"]
    groups = rows.withColumn("_o", F.col(order)).groupBy(*snap, "_o", *here).agg(F.count(F.lit(1)).alias("n"), F.count_if("invalid").alias("bad"))
    alike = groups.groupBy(*snap, *here).agg(F.min("_o").alias("_o"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    heads = alike.groupBy(*snap).agg(F.min(F.struct("_o", *here, "n")).alias("head"), F.sum("n").alias("input_rows"), F.sum("bad").alias("invalid_rows"))
    keys = rows.where("not invalid").groupBy(*snap).agg(F.count_distinct("indicator_type", "indicator").alias("u"))
    on = [F.col(f"h.{c}").eqNullSafe(F.col(f"k.{c}")) for c in snap]
    out = heads.alias("h").join(keys.alias("k"), on, "left").select("h.*", F.coalesce("u", F.lit(0)).alias("unique_indicators")).withColumn("conflicts", F.col("input_rows") - F.col("head.n")).withColumn("head", F.struct(*(F.col(f"head.{c}") for c in here)))
    return out.select("source_name", "day", "snapshot_id", "head.*", "input_rows", "unique_indicators", (F.col("input_rows") - F.col("unique_indicators") - F.col("invalid_rows")).alias("duplicate_rows"), "invalid_rows", "conflicts")


def selected(snapshots: DataFrame, log: DataFrame | None = None, raw_files: DataFrame | None = None, today: str | None = None, log_match: str = "exact") -> DataFrame:
    """The snapshot that stands for each source and day, with `blocked`, the reason why it must not be used, or null.

    log: a described collection log; raw_files: (path, sha256) of raw files by
    portable path.  log_match: 'exact' wants a logged download's time and digest
    among the snapshots, 'digest' the digest alone.
    """
    group = Window.partitionBy("source_name", "day")
    ranked = snapshots.withColumn("r", F.row_number().over(group.orderBy(F.col("at").desc(), F.col("snapshot_id").desc())))
    ties = snapshots.groupBy("source_name", "day", "at").agg(F.count(F.lit(1)).alias("ties"))
    top = ranked.where("r = 1").drop("r").join(ties, ["source_name", "day", "at"])
    if raw_files is not None:
        files = raw_files.select(F.col("path").alias("_p"), F.col("sha256").alias("_found"))
        top = top.join(files, portable_path(F.col("source_path")) == F.col("_p"), "left")
        raw = F.when(F.col("_p").isNull(), "raw_file_not_found").when(F.col("_found") == F.col("sha256"), "hash_verified").otherwise("hash_mismatch")
    else:
        raw = F.lit("raw_file_not_found")
    top = top.withColumn("raw_status", raw)
    newer = F.lit(False)
    if log is not None:
        have = snapshots.select(F.col("source_name").alias("source"), *([F.col("at")] if log_match == "exact" else []), F.col("sha256")).distinct()
        lost = log.where("succeeded and at is not null").join(have, have.columns, "left_anti").groupBy(F.col("source").alias("source_name"), "day").agg(F.max("at").alias("lost_at"))
        top = top.join(lost, ["source_name", "day"], "left")
        newer = F.coalesce(F.col("lost_at") >= F.col("at"), F.lit(False))
    day = F.lit(today).cast("date") if today else F.current_date()
    blocked = (
        F.when(newer, "newer_download_not_normalized")
        .when(F.col("raw_status") == "hash_mismatch", "raw_hash_mismatch")
        .when(F.col("day") > day, "future_observation_date")
        .when((F.col("invalid_rows") > 0) | (F.col("conflicts") > 0), "invalid_or_conflicting_rows")
        .when(F.col("ties") > 1, "ambiguous_latest_timestamp")
    )
    return top.withColumn("blocked", blocked).select(*snapshots.columns, "raw_status", "blocked")
