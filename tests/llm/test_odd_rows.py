"""Very long texts, columns with clashing names, nulls, repeats and empty tables: each operator gives what it gives for the bare rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from driftledger.llm import html_extract, license_scan, ngram_join, pieces, quality_classifier, quality_rules, queries, substring_dedup, warc_audit
from driftledger.llm.queries import PIECE_MODEL

RNG = random.Random(77)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(200)]
CLASH = ["score", "held_out", "label", "labels", "words", "ids", "batch", "bucket", "place", "part", "key", "n_words", "keep", "digest", "file_id", "url2", "html2", "Text2", "_0", "a.b"]


def _text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


LONG = _text(150_000) + " under the mit license end"
ROWS = [(1, LONG), (1, LONG), (2, _text(60)), (2, _text(60)), (None, "under the MIT License"), (None, None), (3, ""), (4, " \t\n"), *((10 + k, _text(70)) for k in range(30))]


@pytest.fixture(scope="module")
def frames(spark):
    bare = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).cache()
    return bare, bare.select("*", *(F.lit("x").alias(c) for c in CLASH)), bare.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(10 + k, k % 2) for k in range(30)] + [(None, 1), (2, None)], "doc_id long, quality int")


def _rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("name", ["classify", "rules", "license", "dedup", "join"])
def test_document_operators(frames, labels, name):
    of = {
        "classify": lambda d: quality_classifier.classify(d, labels), "rules": lambda d: quality_rules.classify(d, labels), "license": license_scan.scan, "dedup": substring_dedup.digest, "join": ngram_join.join,
    }[name]
    bare, clashing, none = frames
    got = _rows(of(bare))
    if name != "join":  # which gives rows that repeat id and text, or have no id, no row each
        assert len(got) == len(ROWS)
    assert got == _rows(of(clashing)) and of(none).collect() == []


def test_license_in_a_very_long_text(frames):
    found = {r.doc_id: r for r in license_scan.scan(frames[1]).collect()}
    assert found[1].base_labels == "mit" and found[1].n_words == 150_005 and found[None].n_words in (0, 4)


def test_pieces(frames):
    vocabulary = pieces.Vocabulary.load(PIECE_MODEL)
    bare, clashing, none = frames
    got = pieces.encode(clashing, vocabulary)
    assert _rows(got) == _rows(pieces.encode(bare, vocabulary)) and got.count() == len(ROWS)
    assert pieces.encode(none, vocabulary).collect() == [] and pieces.decode(pieces.encode(none, vocabulary), vocabulary).collect() == []


def test_pages_and_records(spark):
    body = "<p>" + "A sentence of a very long page. " * 40_000 + "</p>"
    rows = [(1, "u", body), (1, "u", body), (None, "u", "<p>x</p>"), (2, None, None), (3, "v", "")]
    bare = spark.createDataFrame(rows, "page_id long, url string, html string")
    clashing = bare.select("*", *(F.lit("x").alias(c) for c in CLASH if c != "a.b"))
    assert _rows(html_extract.extract(bare)) == _rows(html_extract.extract(clashing))
    assert html_extract.extract(clashing).where("page_id = 1").first().n_chars == 40_000 * 32 - 1
    cut = clashing.withColumn("html", F.when(F.col("page_id") == 3, "other").otherwise(F.col("html")))
    found = warc_audit.audit(warc_audit.records(clashing), warc_audit.records(cut)).collect()
    assert [(r.page_id, r.status) for r in found] == [(3, "changed")]
    assert warc_audit.audit(warc_audit.records(clashing.where("false")), warc_audit.records(cut.where("false"))).collect() == []


def test_license_query_gives_starts(spark, tmp_path):
    """Against a plain reading of the contract: n_words, n_base, first_word, last_word, base_labels."""
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    texts = ["Under THE mit-license, apache license version 2 cc by nc", "cc by nc cc by nc", "cc\x00by\x7fnc Kelvin mit", "under the mit license", "apache license version 20", "", None, "écc by nc \U0001f600 cc\nby\tnc", "the mit license under the mit license"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in queries.op10_license_scan(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        at = [(j, label) for p, label in phrases.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        starts = [j for j, _ in at]
        assert found[i] == (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
