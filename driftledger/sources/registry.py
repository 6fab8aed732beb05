"""Dated registry evidence: which networks a country held on a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftledger.functions.addresses import parsed
from driftledger.functions.scalars import file_name

#: The fields of a response and of its metadata.
_RESPONSE = "status string, data struct<query_time:string, resource:string, resources:struct<ipv4:array<string>, ipv6:array<string>>>"
_METADATA = "country string, requested_date string, query_time string, retrieved_at_utc string, url string, response_file string, sha256 string, ipv4_prefixes int, ipv6_prefixes int"


def evidence_files(spark: SparkSession, metadata: str, responses: str) -> DataFrame:
    """The latest metadata file of each day with its response and the response's digest."""
    meta = spark.read.schema(_METADATA).option("multiLine", True).json(metadata).withColumn("metadata_path", F.col("_metadata.file_path"))
    return dated(meta, spark.read.format("binaryFile").load(responses).select("path", "content"))


def dated(meta: DataFrame, responses: DataFrame) -> DataFrame:
    """Metadata rows with metadata_path, the latest of each day, joined to response files (path, content)."""
    last = Window.partitionBy("requested_date").orderBy(F.col("metadata_path").desc())
    meta = meta.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")
    files = responses.select(F.col("path").alias("response_path"), F.sha2("content", 256).alias("found_sha256"), F.from_json(F.col("content").cast("string"), _RESPONSE).alias("response"))
    return meta.join(files, file_name(F.col("response_file")) == file_name(F.col("response_path")), "left")


def checked(evidence: DataFrame, country: str = "DK") -> DataFrame:
    """evidence with its networks, parsed once, and `problem`, null where the response may be used for its day.

    A response is refused as a whole if one of its networks does not parse, has
    no length or has host bits.
    """
    r = F.col("response")
    v4, v6 = r["data"]["resources"]["ipv4"], r["data"]["resources"]["ipv6"]
    rows = evidence.withColumn("nets", F.transform(F.concat(v4, v6), lambda p: parsed(p)))
    bad = F.exists("nets", lambda n: n.isNull() | (n["kind"] != "cidr") | n["host_bits"])
    problem = (
        F.when(F.col("response_path").isNull(), "response file is missing")
        .when(~F.col("found_sha256").eqNullSafe(F.col("sha256")), "response digest differs")
        .when(~F.col("country").eqNullSafe(F.lit(country)), "metadata of another country")
        .when(~r["status"].eqNullSafe(F.lit("ok")), "response is not successful")
        .when(~F.substring(r["data"]["query_time"], 1, 10).eqNullSafe(F.col("requested_date")), "query date differs from the day")
        .when(F.upper(F.coalesce(r["data"]["resource"], F.lit(country))) != country, "another country")
        .when((F.coalesce(F.size(v4), F.lit(0)) < 1) | (F.coalesce(F.size(v6), F.lit(0)) < 1), "both address families need networks")
        .when(bad, "a network is not valid")
    )
    return rows.withColumn("problem", problem)


def networks(evidence: DataFrame) -> DataFrame:
    """(day, version, bits) of usable checked evidence."""
    rows = evidence.where("problem is null").select(F.to_date("requested_date").alias("day"), F.explode("nets").alias("p"))
    return rows.select("day", "p.version", "p.bits").distinct()


def evidence_index(evidence: DataFrame) -> DataFrame:
    """One row per usable evidence day."""
    keep = ["country", "requested_date", "query_time", "retrieved_at_utc", "url", "response_file", "sha256", "ipv4_prefixes", "ipv6_prefixes", "metadata_path", "response_path"]
    return evidence.where("problem is null").select(*keep)
