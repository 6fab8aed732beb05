"""Distinct counts from mergeable sketches: an option beside the exact counts, never in their place.

A day's keys of a source are read once and kept as one theta sketch; counts over any
window, and the overlap of sources in it, come from sketches alone.  A sketch of 2^k
entries is exact for up to 2^k keys and beyond that has a standard error of about
1 / sqrt(2^k) (1.6 percent at k = 12); an intersection's error is that of the union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftledger.operators.summary import _keys

#: The logarithm of a sketch's entries.
ENTRIES = 12


def daily(observations: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """(source, snapshot_day, indicator_type, sketch): what is kept instead of the keys."""
    key = F.concat_ws("\x1f", "indicator_type", "indicator")
    return _keys(observations).groupBy("source", "snapshot_day", "indicator_type").agg(F.theta_sketch_agg(key, entries).alias("sketch"))


def in_window(sketches: DataFrame, start: str, end: str, by: list[str], entries: int = ENTRIES) -> DataFrame:
    """(by, sketch) over the days from start to end."""
    return sketches.where(F.col("snapshot_day").between(start, end)).groupBy(*by).agg(F.theta_union_agg("sketch", entries).alias("sketch"))


def counts(sketches: DataFrame, start: str, end: str, entries: int = ENTRIES) -> DataFrame:
    """Distinct keys of each source in a window."""
    return in_window(sketches, start, end, ["source"], entries).select("source", F.theta_sketch_estimate("sketch").alias("keys"))


def overlap(sketches: DataFrame, start: str, end: str, entries: int = ENTRIES) -> DataFrame:
    """Common and joint keys of each two sources by type in a window.  The pairs are of sources, one sketch each."""
    mine = in_window(sketches, start, end, ["source", "indicator_type"], entries)
    other = mine.select(F.col("source").alias("source_b"), "indicator_type", F.col("sketch").alias("sketch_b"))
    pairs = mine.withColumnRenamed("source", "source_a").join(other, "indicator_type").where("source_a < source_b")
    return pairs.select("source_a", "source_b", "indicator_type", F.theta_sketch_estimate(F.theta_intersection("sketch", "sketch_b")).alias("intersection"), F.theta_sketch_estimate(F.theta_union("sketch", "sketch_b", entries)).alias("union"))
