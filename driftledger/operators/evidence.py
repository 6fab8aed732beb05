"""Country classification by counted evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftledger.checkpoints import written
from driftledger.functions.addresses import parsed
from driftledger.operators.intervals import meeting


def _filled(c: str, default: str) -> Column:
    return F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)))


def prefix_matches(networks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows of networks (version, bits) with the columns of each prefix (version, bits) that meets them."""
    tagged = networks.withColumn("own_bits", F.col("bits"))
    return meeting(tagged, prefixes, []).drop("bits").withColumnRenamed("own_bits", "bits")


def classify(observations: DataFrame, evidence: DataFrame, prefixes: DataFrame, country: str = "DK", as_of: str | None = None, parse=parsed) -> DataFrame:
    """One row per source, type and indicator: label, distinct signals for and against the country, and their notes.

    A signal is its name with its source, so two prefixes of one register count
    once.  Signals on both sides conflict; signals against alone say nothing.
    as_of: leave out evidence retrieved later than this time.
    """
    keys = observations.where("indicator <> ''").select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("source_name", "indicator_type", "indicator"))).distinct()
    if as_of is not None:
        evidence = evidence.where(F.col("retrieved_at_utc") <= as_of)
    name, source, place = _filled("signal", "unspecified"), _filled("evidence_source", "unknown-source"), F.upper(F.trim(F.coalesce("country", F.lit(""))))
    ours = evidence.select(F.lower(F.trim("indicator")).alias("k"), name.alias("signal"), place.alias("place"), source.alias("src")).where("k <> '' and place not in ('', 'UNKNOWN', 'N/A', 'NA')")
    told = ours.select("k", F.concat("signal", F.lit(" ("), "src", F.lit(")")).alias("key"), (F.col("place") == country).alias("own"), F.concat("signal", F.lit(":"), "place", F.lit("/"), "src").alias("note")).distinct()
    direct = keys.join(told, F.lower("indicator") == F.col("k")).drop("k")
    # texts of both sides are parsed once each
    nets = written(keys.where(F.col("indicator_type").isin("ip", "cidr")).select("indicator").distinct().withColumn("p", parse(F.col("indicator")))).where("p is not null").select("indicator", "p.version", "p.bits")
    listed = written(prefixes.select(F.trim("prefix").alias("x"), _filled("evidence_source", "prefix-register").alias("src")).distinct().withColumn("p", parse(F.col("x")))).where("p is not null").select("p.version", "p.bits", "src").distinct()
    hit = prefix_matches(nets, listed).select("indicator", F.concat(F.lit("allocation-prefix ("), "src", F.lit(")")).alias("key"), F.lit(True).alias("own"), F.concat(F.lit(f"allocation-prefix:{country}/"), "src").alias("note")).distinct()
    by_net = keys.where(F.col("indicator_type").isin("ip", "cidr")).join(hit, "indicator")
    columns = ["source_name", "indicator_type", "indicator"]
    signals = direct.unionByName(by_net).groupBy(*columns).agg(
        F.count_distinct(F.when(F.col("own"), F.col("key"))).alias("n_own"), F.count_distinct(F.when(~F.col("own"), F.col("key"))).alias("n_other"), F.array_join(F.array_sort(F.collect_set("note")), "; ").alias("notes")
    )
    own, other = F.coalesce("n_own", F.lit(0)), F.coalesce("n_other", F.lit(0))
    label = F.when((own > 0) & (other > 0), "Conflicting").when(own >= 2, f"{country}-supported").when(own == 1, f"{country}-weak").otherwise("Unknown")
    return keys.join(signals, columns, "left").select(*columns, label.alias("country_class"), own.alias("danish_signal_count"), other.alias("non_danish_signal_count"), F.coalesce("notes", F.lit("")).alias("evidence_notes"))


def candidates(classified: DataFrame, country: str = "DK") -> DataFrame:
    """Supported and weak keys of each source."""
    return classified.groupBy("source_name").agg(F.count_if(F.col("country_class").isin(f"{country}-supported", f"{country}-weak")).alias("candidates"), F.count(F.lit(1)).alias("n_keys"))


def labels_by_source(classified: DataFrame) -> DataFrame:
    """Keys of each label and the most common type, by source (the first in order among equals)."""
    labels = classified.groupBy("source_name", "country_class").agg(F.count(F.lit(1)).alias("n"))
    types = classified.groupBy("source_name", "indicator_type").agg(F.count(F.lit(1)).alias("t")).groupBy("source_name").agg(F.min_by("indicator_type", F.struct(-F.col("t"), F.col("indicator_type"))).alias("commonest_type"))
    return labels.join(types, "source_name")
