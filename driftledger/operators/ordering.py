"""Rows in one global order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftledger.checkpoints import written


def in_ranges(table: DataFrame, order: list[Column]) -> DataFrame:
    """table dealt to tasks by ranges of the order, each sorted: written files follow each other in their numbers."""
    return table.repartitionByRange(*order).sortWithinPartitions(*order)


def numbered(table: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """table with the place of each row in the order, from 1.

    Ranges are sorted and counted apart; a range begins after the sum of those
    before it.  Only these sums, one a range, meet in one task.  The order should
    leave no ties, else their places are any of theirs.
    """
    ids = F.monotonically_increasing_id()
    # within a task these ids rise by one from a multiple of 2^33
    rows = written(in_ranges(table, order).withColumn("_range", F.shiftright(ids, 33).cast("int")).withColumn("_at", ids.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin"))
    return rows.join(F.broadcast(begins), "_range").withColumn(name, F.col("_begin") + F.col("_at") + 1).drop("_range", "_at", "_begin")
