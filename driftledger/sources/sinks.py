"""Writing tables: stable columns, unknown numbers as NA, runs that never overwrite."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftledger.functions.scalars import rendered, slug
from driftledger.sources.tables import digests


def write_parquet(df: DataFrame, path: str, columns: list[str] | None = None, by: list[str] | None = None) -> None:
    """A table of a run; fails if the path exists."""
    out = df.select(*columns) if columns else df
    writer = out.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def exported(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df as text: nulls become NA, arrays are joined by ';'."""
    out = df.select(*columns) if columns else df
    return out.select(*(F.array_join(F.col(f.name), ";").alias(f.name) if f.dataType.typeName() == "array" else rendered(F.col(f.name)).alias(f.name) for f in out.schema.fields))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list[str] | None = None) -> None:
    """One CSV file with a header, also for no rows; fails if the path exists.  For report tables, not for observations."""
    out = exported(df, columns)
    out = out.repartition(1)
    (out.sortWithinPartitions(*order) if order else out).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def write_by_source(df: DataFrame, path: str) -> None:
    """One folder for each source."""
    df.withColumn("source_slug", slug(F.col("source"))).write.mode("errorifexists").partitionBy("source_slug").parquet(path)


def write_classified(df: DataFrame, path: str) -> None:
    """Classified rows in one pass, by whether they match and by day: the matched rows are a part of all, not a copy."""
    df.withColumn("in_scope", F.coalesce(F.col("matched") > 0, F.lit(False)).cast("int")).write.mode("errorifexists").partitionBy("in_scope", "day").parquet(path)


def classified(spark: SparkSession, path: str, matched_only: bool = False) -> DataFrame:
    """All classified rows, or those of the matched part alone."""
    rows = spark.read.parquet(path)
    return (rows.where("in_scope = 1") if matched_only else rows).drop("in_scope")


def commit_run(tables: dict[str, DataFrame], folder: str, by: dict[str, list[str]] | None = None) -> DataFrame:
    """Write the tables of a run and, last of all, the index of its files, which makes it a run.

    The index (table, path in the folder, bytes, sha256) is what readers look for:
    a run whose writing was cut short has none and is not seen.  A folder with an
    index is never written again; what a lost attempt left is written over.
    """
    spark = next(iter(tables.values())).sparkSession
    if run_index(spark, folder) is not None:
        raise FileExistsError(f"{folder} holds a run already")
    for name, rows in tables.items():
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*by[name]) if by and name in by else writer).parquet(f"{folder}/{name}")
    parts = [_files_of(spark, folder, name) for name in tables]
    index = parts[0]
    for part in parts[1:]:
        index = index.unionByName(part)
    index.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{_INDEX}")
    return run_index(spark, folder)


#: The folder of a run's index.
_INDEX = "index"


def _files_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    files = digests(spark, f"{folder}/{name}").where("path not like '%/\\_SUCCESS'")
    return files.select(F.lit(name).alias("table"), F.substring_index("path", f"/{name}/", -1).alias("path"), "bytes", "sha256")


def run_index(spark: SparkSession, folder: str) -> DataFrame | None:
    """The index of a complete run; None if the folder holds none."""
    try:
        return spark.read.parquet(f"{folder}/{_INDEX}")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_run(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a complete run; raises if the run was never finished."""
    if run_index(spark, folder) is None:
        raise FileNotFoundError(f"{folder} holds no complete run")
    return spark.read.parquet(f"{folder}/{name}")


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(table, path, problem) of files of a run that its index does not describe as they are."""
    index = run_index(spark, folder)
    names = [r.table for r in index.select("table").distinct().collect()]
    here = None
    for name in names:
        part = _files_of(spark, folder, name)
        here = part if here is None else here.unionByName(part)
    here = here.select("table", "path", F.col("sha256").alias("found"))
    both = index.select("table", "path", "sha256").join(here, ["table", "path"], "full_outer").where(~F.col("sha256").eqNullSafe(F.col("found")))
    return both.select("table", "path", F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "not in the index").otherwise("changed").alias("problem"))


def export_day(summary: DataFrame, day: str, path: str) -> None:
    """Rows of one day of a saved summary, unchanged."""
    write_csv(summary.where(F.col("snapshot_day") == day), path, order=["source"])
