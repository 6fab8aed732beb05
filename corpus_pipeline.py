"""A corpus pipeline over the table documents, in five stages.

Documents of low quality go; one document of each group of near duplicates
stays; long passages that an earlier document holds are cut out; documents that
hold benchmark items go; what is left is encoded to token ids.  All stages but
the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftledger.llm import decontaminate, ngram_join, pieces, quality_classifier, substring_dedup
from driftledger.llm.common import table, use_checkpoints
from driftledger.llm.queries import PIECE_MODEL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; null and empty texts have a score like any, ids do not matter, an empty table stays empty."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; rows without an id are compared too, texts without words are copies of each other only."""
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that one with a smaller id holds; rows without an id stay as they are, n_chars is counted anew."""
    return substring_dedup.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, an empty benchmark keeps all."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each document; null and empty texts have no tokens."""
    return pieces.encode(docs, pieces.Vocabulary.load(PIECE_MODEL))


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: The classifier is fitted in numpy, which SQL cannot express; each stage's operator is tested by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what a stage returns is written once, and the next reads it there."""
    use_checkpoints(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
