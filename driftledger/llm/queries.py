"""The queries of the numbered operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftledger.llm import decontaminate, html_extract, license_scan, line_dedup, ngram_join, periodic_runs, phrase_mining, pieces, quality_classifier, quality_rules, sql, substring_dedup, toxicity, warc_audit
from driftledger.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The public BPE vocabulary with byte fallback, where the box keeps it.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.Vocabulary.load(PIECE_MODEL))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of all pages in which some bodies were cut short, some records lost and some added."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    shape = F.pmod("page_id", F.lit(113))
    damaged = pages.where(shape != 7).withColumn("html", F.when(shape == 11, F.substring("html", 1, F.length("html") - 1)).otherwise(F.col("html")))
    added = pages.where(shape == 29).select((-F.col("page_id") - 1).alias("page_id"), "url", "html")
    return warc_audit.audit(warc_audit.records(pages), warc_audit.records(damaged.unionByName(added)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's last_word is the largest start of a place, not the last word of one."""
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumn("last_word", F.col("last_start")).drop("last_start")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_sentencepiece,
        op3_quality_classifier,
        op4_decontamination,
        op5_ngram_join,
        op6_html_extraction,
        op7_quality_rules,
        op8_substring_dedup,
        op9_warc_audit,
        op10_license_scan,
        op11_phrase_mining,
        op12_line_dedup,
        op13_periodic_runs,
    )
}

SQL: dict[str, str] = {"op5_ngram_join": sql.NGRAM_JOIN, "op8_substring_dedup": sql.SUBSTRING_DEDUP, "op9_warc_audit": sql.WARC_AUDIT, "op10_license_scan": sql.LICENSE_SCAN, "op11_phrase_mining": sql.PHRASE_MINING, "op12_line_dedup": sql.LINE_DEDUP}
