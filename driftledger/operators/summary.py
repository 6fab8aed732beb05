"""Daily counts, persistence and overlap over all snapshots of a day together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftledger.functions.scalars import jaccard, raw_day, safe_integer


def _keys(observations: DataFrame) -> DataFrame:
    """(source, day, indicator_type, indicator) once each; blanks count as a key like any other."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return observations.select(text("source_name").alias("source"), raw_day(F.col("retrieved_at_utc")).alias("snapshot_day"), text("indicator_type").alias("indicator_type"), text("indicator").alias("indicator"))


def daily_summary(observations: DataFrame) -> DataFrame:
    """Counts by source and day, with additions and removals against the source's day before; null on its first day.

    A key is new if its own last day is not the source's last day, and gone if
    its own next day is not the source's next day: two window columns over the
    distinct keys, no sets.
    """
    rows = _keys(observations)
    keys = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("raw"))
    by_source = Window.partitionBy("source").orderBy("snapshot_day")
    days = keys.groupBy("source", "snapshot_day").agg(
        F.count(F.lit(1)).alias("unique_indicators"), F.count_if(F.col("indicator_type").isin("ip", "cidr")).alias("unique_ips_cidrs"),
        F.count_if(F.col("indicator_type").isin("domain", "url")).alias("unique_domains_urls"), F.sum("raw").alias("raw_rows"),
    )
    days = days.withColumn("before", F.lag("snapshot_day").over(by_source)).withColumn("after", F.lead("snapshot_day").over(by_source))
    by_key = Window.partitionBy("source", "indicator_type", "indicator").orderBy("snapshot_day")
    moves = keys.select("source", "snapshot_day", F.lag("snapshot_day").over(by_key).alias("key_before"), F.lead("snapshot_day").over(by_key).alias("key_after"))
    moves = moves.groupBy("source", "snapshot_day", "key_before", "key_after").agg(F.count(F.lit(1)).alias("n")).join(days.select("source", "snapshot_day", "before", "after"), ["source", "snapshot_day"])
    added = moves.where(F.col("before").isNotNull() & ~F.col("key_before").eqNullSafe(F.col("before"))).groupBy("source", "snapshot_day").agg(F.sum("n").alias("additions"))
    gone = moves.where(F.col("after").isNotNull() & ~F.col("key_after").eqNullSafe(F.col("after"))).groupBy("source", F.col("after").alias("snapshot_day")).agg(F.sum("n").alias("removals"))
    known = lambda c: F.when(F.col("before").isNotNull(), F.coalesce(c, F.lit(0)))
    return (
        days.join(added, ["source", "snapshot_day"], "left")
        .join(gone, ["source", "snapshot_day"], "left")
        .select("source", "snapshot_day", "unique_indicators", "unique_ips_cidrs", "unique_domains_urls", known("additions").alias("additions"), known("removals").alias("removals"), "raw_rows")
    )


def persistence(observations: DataFrame) -> DataFrame:
    """First and last day, number of days and their share of the source's days, for each key."""
    rows = _keys(observations).distinct()
    days = rows.groupBy("source").agg(F.count_distinct("snapshot_day").alias("successful_snapshots"), F.max("snapshot_day").alias("source_last"))
    keys = rows.groupBy("source", "indicator_type", "indicator").agg(F.min("snapshot_day").alias("first_seen"), F.max("snapshot_day").alias("last_seen"), F.count(F.lit(1)).alias("snapshots_present"))
    return keys.join(days, "source").select(
        "source", "indicator_type", "indicator", "first_seen", "last_seen", "snapshots_present", "successful_snapshots",
        F.bround(F.col("snapshots_present") / F.col("successful_snapshots"), 6).alias("persistence_ratio"), F.when(F.col("last_seen") == F.col("source_last"), "yes").otherwise("no").alias("right_censored"),
    )


def overlap(observations: DataFrame) -> DataFrame:
    """Common and joint keys of each two sources by type, over the full window; pairs without a common key stay.

    Each key gives the pairs of its own sources, a handful; no two keys are ever paired.
    """
    keys = _keys(observations).select("source", "indicator_type", "indicator").distinct()
    sizes = keys.groupBy("source", "indicator_type").agg(F.count(F.lit(1)).alias("n"))
    of_key = keys.groupBy("indicator_type", "indicator").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("source_a"), b.alias("source_b")))))
    common = of_key.select("indicator_type", F.explode(pairs).alias("p")).groupBy("indicator_type", "p.source_a", "p.source_b").agg(F.count(F.lit(1)).alias("c"))
    a = sizes.select(F.col("source").alias("source_a"), "indicator_type", F.col("n").alias("n_a"))
    b = sizes.select(F.col("source").alias("source_b"), "indicator_type", F.col("n").alias("n_b"))
    c = F.coalesce("c", F.lit(0))
    return (
        a.join(b, "indicator_type")
        .where("source_a < source_b")
        .join(common, ["indicator_type", "source_a", "source_b"], "left")
        .select(
            "source_a", "source_b", "indicator_type", c.alias("intersection"), (F.col("n_a") + F.col("n_b") - c).alias("union"), jaccard(c, F.col("n_a") + F.col("n_b") - c).alias("jaccard"),
        )
    )


def source_statistics(daily: DataFrame) -> DataFrame:
    """Range and mean of daily counts of each source; unknown numbers are skipped, a total of none is 0."""
    n, add, rem = (safe_integer(F.col(c)) for c in ("unique_indicators", "additions", "removals"))
    mean = lambda c: F.bround(F.avg(c), 4)
    return daily.groupBy("source").agg(
        F.count_distinct("snapshot_day").alias("observed_days"), F.min("snapshot_day").alias("first_day"), F.max("snapshot_day").alias("last_day"), F.min(n).alias("minimum_indicators"),
        F.max(n).alias("maximum_indicators"), mean(n).alias("mean_indicators"), F.coalesce(F.sum(add), F.lit(0)).alias("total_additions"), F.coalesce(F.sum(rem), F.lit(0)).alias("total_removals"),
        mean(add).alias("mean_daily_additions"), mean(rem).alias("mean_daily_removals"),
    )


def frequencies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) for each column: one pass with grouping sets."""
    tagged = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns))).alias("x"))
    return tagged.groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def missing_days(days: DataFrame, day: str = "day") -> DataFrame:
    """Calendar days between the first and the last without a row."""
    ends = days.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias(day)).join(days.select(day).distinct(), day, "left_anti")


def calendar(spark, start: str, end: str, most: int = 3660) -> DataFrame:
    """Each day of a study window; raises if it is empty or longer than `most` days."""
    ends = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
    ok = (F.col("b") >= F.col("a")) & (F.datediff("b", "a") <= most)
    day = F.when(ok, F.sequence("a", "b")).otherwise(F.raise_error(F.lit("the study window is empty or too long")).cast("array<date>"))
    return ends.select(F.explode(day).alias("day"))


def study_window(days: DataFrame, start: str | None = None, end: str | None = None, today: str | None = None, most: int = 3660) -> DataFrame:
    """Each day from start to end, which default to the first and the last of `days` (day).

    Raises if the window is empty, longer than `most` days, or ends after today.
    """
    a = F.lit(start).cast("date") if start else F.min("day")
    b = F.lit(end).cast("date") if end else F.max("day")
    ends = days.agg(a.alias("a"), b.alias("b"))
    now = F.lit(today).cast("date") if today else F.current_date()
    stop = lambda text: F.raise_error(F.lit(text)).cast("array<date>")
    fits = (F.col("b") >= F.col("a")) & (F.datediff("b", "a") <= most)
    day = F.when(~F.coalesce(fits, F.lit(False)), stop("the study window is empty or too long")).when(F.col("b") > now, stop("the study window ends in the future")).otherwise(F.sequence("a", "b"))
    return ends.select(F.explode(day).alias("day"))


#: Between the cells of a row's text, and for a null.
_CELL, _NULL = "\x1f", "\\N"


def digest_sums(columns: list[str]) -> list[Column]:
    """Aggregates `bytes` and `limb0` to `limb3` of rows as text; sums of parts of a table add up to those of the whole.

    A row counts as the 128 bits of its MD5, as often as it stands there, so the
    sums do not depend on order or partitions.
    """
    text = F.concat_ws(_CELL, *(F.coalesce(F.col(c).cast("string"), F.lit(_NULL)) for c in columns))
    limb = lambda k: F.conv(F.substring(F.md5(text), 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")
    return [F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"), *(F.coalesce(F.sum(limb(k)), F.lit(0)).cast("decimal(38,0)").alias(f"limb{k}") for k in range(4))]


def digest_text() -> Column:
    """The limbs' sum modulo 2^128 as 32 hexadecimal digits."""
    base = F.lit(1 << 32).cast("decimal(20,0)")
    digits, carry = [], F.lit(0).cast("decimal(38,0)")
    for k in (3, 2, 1, 0):
        total = (F.col(f"limb{k}") + carry).cast("decimal(38,0)")
        rest = F.pmod(total, base)
        digits.insert(0, F.lpad(F.lower(F.hex(rest.cast("long"))), 8, "0"))
        carry = ((total - rest) / base).cast("decimal(38,0)")
    return F.concat(*digits)


def dataset_profile(observations: DataFrame) -> DataFrame:
    """Rows, snapshots, sources, keys and days of a table of observations, its bytes as text and a digest that no order changes."""
    day = F.nullif(raw_day(F.col("retrieved_at_utc")), F.lit("unknown"))
    key = F.struct(*(F.coalesce(c, F.lit("")) for c in ("indicator_type", "indicator")))
    counts = observations.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("snapshot_id").alias("snapshots"), F.count_distinct("source_name").alias("sources"), F.count_distinct(key).alias("keys"),
        F.count_distinct(day).alias("days"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
    )
    sums = observations.agg(*digest_sums(observations.columns)).select("bytes", digest_text().alias("digest"))
    return counts.join(sums)  # one row each


def in_many_sources(observations: DataFrame, least: int = 2) -> DataFrame:
    """Keys that several sources list, with their number."""
    keys = _keys(observations).select("source", "indicator_type", "indicator").distinct()
    return keys.groupBy("indicator_type", "indicator").agg(F.count(F.lit(1)).alias("sources")).where(F.col("sources") >= least)


def persistence_summary(persistent: DataFrame) -> DataFrame:
    """Median and upper quartile of days present, keys on the first and last day, and censored keys, by source."""
    ends = persistent.groupBy("source").agg(F.min("first_seen").alias("a"), F.max("last_seen").alias("b"))
    return persistent.join(ends, "source").groupBy("source").agg(
        F.percentile("snapshots_present", 0.5).alias("median_days"), F.percentile("snapshots_present", 0.75).alias("upper_quartile_days"), F.count_if(F.col("first_seen") == F.col("a")).alias("on_first_day"),
        F.count_if(F.col("last_seen") == F.col("b")).alias("on_last_day"), F.count_if(F.col("right_censored") == "yes").alias("right_censored"),
    )


def completeness(rows: DataFrame, fields: list[str], by: str) -> DataFrame:
    """Share of filled cells among the expected fields, by a column."""
    filled = sum((F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int") for c in fields)
    return rows.groupBy(by).agg(F.bround(F.avg(filled / F.lit(float(len(fields)))), 6).alias("completeness"), F.count(F.lit(1)).alias("n_rows"))


def counts_by_source(daily: DataFrame) -> DataFrame:
    """Median unique keys of each source."""
    return daily.groupBy("source").agg(F.percentile("unique_indicators", 0.5).alias("median_unique"))


def chart_series(daily: DataFrame) -> DataFrame:
    """(series, source, day, value): daily unique keys, additions and removals (below zero), gaps left out."""
    parts = F.array(*(F.struct(F.lit(n).alias("series"), v.cast("long").alias("value")) for n, v in (("unique", F.col("unique_indicators")), ("additions", F.col("additions")), ("removals", -F.col("removals")))))
    return daily.select("source", "snapshot_day", F.explode(parts).alias("x")).select("x.series", "source", "snapshot_day", "x.value").where("value is not null")
