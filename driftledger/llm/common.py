"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: one row in this many is held out of every fit.
HELD_OUT_MODULUS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_MODULUS == 0, F.lit(False))


def use_checkpoints(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder.

    A cluster names a shared folder in spark.checkpoint.dir, which Spark has
    then taken up already.  Only where the setting is absent, as in tests on
    one machine, a temporary folder is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def unused(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores as make it differ from every column of docs in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns of docs, also those with dots in their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


#: Labelled texts of more bytes are not used in a fit, so that what reaches the driver is bounded (they are scored like any).
SAMPLE_BYTES = 100_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most `limit` labelled ids that are not held out, one row each.

    Each class gives at most half of them, chosen by a hash of the id, so that
    the same rows come out on every run.  Of conflicting labels the larger counts,
    and of texts that share an id the one with the least hash.  Only the chosen
    ids, at most `limit`, are broadcast; other texts are not shuffled.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    half = max(1, limit // 2)
    chosen = known.where("label = 0").orderBy(*order).limit(half).unionByName(known.where("label = 1").orderBy(*order).limit(half))
    found = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "t.text", "label")
