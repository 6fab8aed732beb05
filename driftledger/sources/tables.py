"""Saved tables and manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftledger.functions.scalars import source_of_alias, zoned_time
from driftledger.schemas import COLLECTION_LOG


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """A CSV table by its header; a missing file is an empty table; a byte-order mark is dropped.

    strict: a row with more or fewer cells than the header is an error.
    """
    try:
        rows = spark.read.option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("enforceSchema", False).option("escape", '"').csv(path, schema=None)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty(spark, schema)
        raise
    rows = rows.toDF(*(c.removeprefix("﻿") for c in rows.columns))
    missing = [c for c in schema.names if c not in rows.columns]
    if missing and strict:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in schema.names))


def collection_log(spark: SparkSession, path: str) -> DataFrame:
    """The log of downloads with source names as in observations, its time and its success."""
    return described_log(read_csv(spark, path, COLLECTION_LOG))


def described_log(rows: DataFrame) -> DataFrame:
    at = zoned_time(F.col("retrieved_at_utc"))
    ok = (F.lower("status") == "ok") & (F.col("http_status") == "200")
    return rows.withColumn("source", source_of_alias(F.col("source"))).withColumn("at", at).withColumn("day", F.to_date("at")).withColumn("succeeded", F.coalesce(ok, F.lit(False)))


#: What the catalog needs of comparison and run manifests.
MANIFEST = T.StructType(
    [
        T.StructField("status", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("generated_at_utc", T.StringType()), T.StructField("previous_day", T.StringType()),
        T.StructField("current_day", T.StringType()), T.StructField("missing_source_snapshots", T.ArrayType(T.StringType())), T.StructField("collection_status", T.StringType()),
        T.StructField("outputs", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("sha256", T.StringType())]))),
        T.StructField("normalized", T.StructType([T.StructField("distinct_snapshot_days", T.ArrayType(T.StringType())), T.StructField("rows", T.LongType())])), T.StructField("_corrupt", T.StringType()),
    ]
)


def manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """JSON manifests of a glob; unreadable ones are skipped; none at all is an empty table."""
    try:
        rows = spark.read.schema(MANIFEST).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(pattern)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty(spark, MANIFEST).drop("_corrupt").withColumn("manifest_path", F.lit(""))
        raise
    return rows.withColumn("manifest_path", F.col("_metadata.file_path")).where("_corrupt is null").drop("_corrupt")


def manifest_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every manifest.json under a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def manifest_fields(texts: DataFrame) -> DataFrame:
    """(path, text) with the fields of each manifest by their place, whatever version wrote it, and `error` where it cannot be read.

    Numbers may be written as text, outputs as a list of objects or as an object of
    digests by path, days as one day or a list.
    """
    v = texts.withColumn("v", F.try_parse_json("text"))
    field = lambda path, kind="string": F.try_variant_get("v", path, kind)
    listed = F.transform(field("$.outputs", "array<struct<path:string,sha256:string>>"), lambda o: F.struct(o["path"].alias("path"), o["sha256"].alias("sha256")))
    mapped = F.transform(F.map_entries(field("$.outputs", "map<string,string>")), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("sha256")))
    # a list is no map and an object no list, so at most one of both is there
    days = F.coalesce(field("$.normalized.distinct_snapshot_days", "array<string>"), F.array(field("$.normalized.distinct_snapshot_days")))
    known = F.schema_of_variant("v").startswith("OBJECT")
    error = F.when(F.col("v").isNull(), "not JSON").when(~known, "not an object").when(field("$.run_id").isNull(), "no run_id")
    return v.select(
        "path", "text", field("$.run_id").alias("run_id"), field("$.status").alias("status"), field("$.generated_at_utc").alias("generated_at_utc"), field("$.previous_day").alias("previous_day"), field("$.current_day").alias("current_day"),
        field("$.normalized.rows", "bigint").alias("n_rows"), F.filter(days, lambda d: d.isNotNull()).alias("days"), F.coalesce(listed, mapped).alias("outputs"), error.alias("error"),
    )


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
