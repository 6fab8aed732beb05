"""Set algebra of networks as leading-bit strings, without range joins and without expanding addresses.

Tables have the columns version and bits and any key columns.  Two networks meet
exactly if one's bits begin the other's, so every join here is an equality join
on truncated bits; the truncation lengths are those that occur, at most 33 and
129, which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftledger.functions.addresses import minimal, n_addresses


def containing(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of inner with `holder`, the bits of each network of outer with equal keys that holds it (or equals it)."""
    lengths = outer.select(F.col("version").alias("_v"), F.length("bits").alias("_l")).distinct()
    cut = inner.join(F.broadcast(lengths), (F.col("version") == F.col("_v")) & (F.col("_l") <= F.length("bits"))).withColumn("_t", F.substring(F.col("bits"), F.lit(1), F.col("_l"))).drop("_v", "_l")
    right = outer.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("version").alias("_v"), F.col("bits").alias("holder")).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("version") == F.col("_v"), F.col("_t") == F.col("holder")]
    return cut.join(right, on).drop("_v", "_t", *(f"_k_{k}" for k in keys))


def disjoint(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, version, bits) without networks that another one of the same keys holds."""
    one = blocks.select(*keys, "version", "bits").distinct()
    lengths = one.select(F.col("version").alias("_v"), F.length("bits").alias("_l")).distinct()
    # only shorter networks are looked for, and only those that are there stay
    shorter = one.join(F.broadcast(lengths), (F.col("version") == F.col("_v")) & (F.col("_l") < F.length("bits"))).withColumn("_t", F.substring(F.col("bits"), F.lit(1), F.col("_l")))
    held = shorter.join(one.withColumnRenamed("bits", "_t"), [*keys, "version", "_t"], "left_semi").select(*keys, "version", "bits").distinct()
    return one.join(held, [*keys, "version", "bits"], "left_anti")


def least(blocks: DataFrame, keys: list[str], width: int = 128) -> DataFrame:
    """(keys, version, bits): the least list of networks that covers the same addresses as disjoint ones of at most `width` bits.

    Halves are joined eight bits at a time: networks of k + 1 to k + 8 bits meet
    by their first k, at most 256 in a group, and what became of k bits meets on.
    """
    out = blocks.select(*keys, "version", "bits")
    for k in range(width - 8, -1, -8):
        part = F.when(F.length("bits").between(k + 1, k + 8), F.substring("bits", 1, k)).otherwise(F.col("bits"))
        met = out.groupBy(*keys, "version", part.alias("_part")).agg(F.collect_list("bits").alias("_b"))
        out = met.select(*keys, "version", F.explode(F.when(F.size("_b") == 1, F.col("_b")).otherwise(minimal(F.col("_b")))).alias("bits"))
    return out


def addresses(blocks: DataFrame, keys: list[str], name: str = "addresses") -> DataFrame:
    """Addresses that disjoint blocks cover, by keys and version."""
    return blocks.groupBy(*keys, "version").agg(F.sum(n_addresses(F.col("version"), F.col("bits"))).cast("decimal(38,0)").alias(name))


def meeting(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(columns of a, other columns of b, version, bits): the common part of each pair of networks that meet.

    a and b have equal keys and version; other columns must differ in name.
    """
    extra = [c for c in b.columns if c not in (*keys, "version", "bits")]
    mine = [c for c in a.columns if c not in (*keys, "version", "bits")]

    def joined(inner: DataFrame, outer: DataFrame, strict: bool) -> DataFrame:
        lengths = outer.select(F.col("version").alias("_v"), F.length("bits").alias("_l")).distinct()
        size = F.length("bits")
        cut = inner.join(F.broadcast(lengths), (F.col("version") == F.col("_v")) & (F.col("_l") < size if strict else F.col("_l") <= size)).withColumn("_t", F.substring(F.col("bits"), F.lit(1), F.col("_l"))).drop("_v", "_l")
        other = outer.withColumnRenamed("bits", "_t")
        return cut.join(other, [*keys, "version", "_t"]).select(*keys, *mine, *extra, "version", "bits")

    return joined(a, b, False).unionByName(joined(b, a, True))


def bound_low(version: Column, bits: Column) -> Column:
    return F.rpad(bits, F.when(version == 4, 32).otherwise(128), "0")


def bound_next(version: Column, bits: Column) -> Column:
    """First address after a network, as bits; '2' after the last address of all."""
    width = F.when(version == 4, 32).otherwise(128)
    high = F.rpad(bits, width, "1")
    zero = width - F.locate("0", F.reverse(high)) + 1
    return F.when(~high.contains("0"), "2").otherwise(F.rpad(F.concat(F.substring(high, F.lit(1), zero - 1), F.lit("1")), width, "0"))


def merged(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, version, low, next): maximal runs of overlapping or adjacent networks."""
    spans = blocks.select(*keys, "version", bound_low(F.col("version"), F.col("bits")).alias("low"), bound_next(F.col("version"), F.col("bits")).alias("next"))
    by = Window.partitionBy(*keys, "version").orderBy("low", "next")
    before = F.max("next").over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("s", (before.isNull() | (F.col("low") > before)).cast("int"))
    return starts.withColumn("run", F.sum("s").over(by)).groupBy(*keys, "version", "run").agg(F.min("low").alias("low"), F.max("next").alias("next")).drop("run")


def span_size(version: Column, low: Column, after: Column) -> Column:
    """Addresses from low up to before `after` (bits)."""
    part = lambda c, a, n: F.conv(F.substring(c, a, n), 2, 10).cast("decimal(20,0)")
    four = F.when(after == "2", F.lit(4294967296).cast("decimal(20,0)")).otherwise(part(after, 1, 32)) - part(low, 1, 32)
    top = F.when(after == "2", F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(part(after, 1, 64)) - part(low, 1, 64)
    rest = F.when(after == "2", F.lit(0).cast("decimal(20,0)")).otherwise(part(after, 65, 64)) - part(low, 65, 64)
    big = F.try_add(F.try_multiply(top, F.lit("18446744073709551616").cast("decimal(20,0)")), rest)
    return F.when(version == 4, four.cast("decimal(38,0)")).otherwise(big.cast("decimal(38,0)"))
