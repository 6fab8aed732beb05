"""Phrase mining, line dedup and periodic runs against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftledger.llm import line_dedup, periodic_runs, phrase_mining

RNG = random.Random(29)
UP = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
EXTRA = ["key", "batch", "bucket", "codes", "words", "phrase", "state", "h", "lines", "runs", "n_chars", "part"]


def _frame(spark, rows, kinds="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, kinds).select("*", *(F.lit("x").alias(c) for c in EXTRA)).repartition(5)


def _phrases(rows, least, inside, first):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = []
    for (lang, g), a in found.items():
        if any(lang == m and len(b) > len(g) and any(b[i : i + len(g)] == g for i in range(len(b))) and 100 * c >= inside * a for (m, b), c in found.items()):
            continue
        score, k = min((1000000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.append((lang, -score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]], n[lang]))
    rank = Counter()
    for lang, score, a, phrase, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= first:
            yield lang, rank[lang], phrase.decode(), -a, left, right, total, -score


def _prose():
    words = ["".join(RNG.choice("abé") for _ in range(RNG.randint(1, 3))) for _ in range(25)] + [" x", "日本", "Zz"]
    rows = []
    for i in range(160):
        text = "".join(RNG.choice(words).title() + RNG.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", ", "\x0b"]) for _ in range(RNG.randint(0, 80)))
        rows.append((RNG.choice([i, i, None, 7]), text, RNG.choice(["de", "en", None, "und", ""])))
    return [*rows, *rows[:6], (None, None, None), (1, "", "de"), (2, " \t\n.", "en"), (3, "solo", "xx"), (4, "a b " * 4000 + "A,B", "de"), (5, "w" * 200_000 + " a b", "de")]


@pytest.mark.parametrize("salted", [False, True])
def test_collocations_equal_brute_force(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(phrase_mining, "RANK_ROWS", 7)
        monkeypatch.setattr(phrase_mining, "HOT_SHARE", 20)
    rows = _prose()
    got = [tuple(r) for r in phrase_mining.collocations(_frame(spark, rows), 4, 50, 30).collect()]
    assert len(got) > 60 and sorted(got) == sorted(_phrases(rows, 4, 50, 30))


def test_collocations_without_frequent_phrases(spark):
    assert phrase_mining.collocations(_frame(spark, [(1, "a b c", "de"), (2, None, "de")])).collect() == []
    assert phrase_mining.collocations(_frame(spark, [])).collect() == []


def test_equal_fingerprints_change_nothing(spark, monkeypatch):
    import numpy as np

    same = phrase_mining.Grams.prints
    few = lambda self: [p % np.uint64(40) << np.uint64(32) | p % np.uint64(3) for p in same(self)]
    texts = ["a b c a b", "b c d", "c a b c d d", "a b"] * 3
    grams = phrase_mining.Grams(["x"] * len(texts), [t.encode() for t in texts])
    monkeypatch.setattr(phrase_mining.Grams, "prints", few)
    codes, counts, _ = grams.different()
    got = {p: f for p, f in zip(*(grams.phrases(codes, counts).column(c).to_pylist() for c in ("phrase", "f")), strict=True)}
    want = Counter(" ".join(t.split()[i : i + k]) for t in texts for k in (1, 2, 3) for i in range(len(t.split()) - k + 1))
    assert got == want


def test_scores_pass_64_bits(spark):
    one = spark.createDataFrame([(10**13, 10**14, 10**13 + 1)], "a long, l1 long, r1 long").select(phrase_mining._cut(1).alias("c")).first().c
    assert one.score == 10**6 * 10**26 // (10**14 * (10**13 + 1))


def _lines(rows, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UP)
    documents = {(i, t) for i, t in rows}
    count = Counter(k for _, t in documents for k in {key(x) for x in (t or "").split("\n")})
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (key(x) and count[key(x)] >= least)]
        yield i, len(lines), len(lines) - len(left), "\n".join(left)


def _pages():
    words = ["Menu", " menu\t", "é", "É", "a  b", "\x0bfoot\r", "", " ", "x" * 50, "日本 "]
    rows = []
    for i in range(250):
        lines = ["Common"] * (i % 3 != 0) + [RNG.choice(words) if RNG.random() < 0.4 else f"own {RNG.randint(0, 60)}" for _ in range(RNG.randint(0, 12))]
        rows.append((RNG.choice([i, i, i, None, 5]), "\n".join(lines)))
    return [*rows, *rows[:30], (None, None), (901, ""), (902, "\n" * 40), (903, "common\n" * 5000 + "tail"), (904, "y" * 300_000 + "\nMENU")]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_line_dedup_equals_brute_force(spark, partitions):
    rows = _pages()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = _frame(spark, rows, "doc_id long, text string")
        got = [tuple(r) for r in line_dedup.remove(docs).collect()]
        digests = [tuple(r) for r in line_dedup.digest(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = lambda r: tuple(map(str, r))
    want = list(_lines(rows, 10))
    assert sum(r[2] > 0 for r in want) > 100 and sorted(got, key=order) == sorted(want, key=order)
    assert sorted(digests, key=order) == sorted(((*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in want), key=order)


@pytest.mark.parametrize("per_batch", [1, 2, 7, 1000])
def test_pass_over_ranges_in_small_batches(per_batch):
    """Hashes that cross batches and ranges: what goes, and what the edges' counts settle, is what at least 4 documents hold."""
    import pyarrow as pa

    rng = random.Random(per_batch)
    rows = sorted({(h, 0, False, rng.randint(0, 30), 0) for h in range(12) for _ in range(rng.choice([1, 2, 3, 4, 5, 9]))})
    names = ["h", "g", "no_id", "id", "text_id", "first", "lines"]
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), 6)), len(rows)]
    out = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        table = pa.table([*(pa.array(c) for c in zip(*rows[lo:hi], strict=True)), pa.array([0] * (hi - lo)), pa.array([[0]] * (hi - lo))], names=names)
        for part in line_dedup._pass(4)(iter(table.to_batches(max_chunksize=per_batch))):
            out += part.to_pylist()
    total = Counter()
    for r in out:
        total[r["h"]] += r["documents"] if r["state"] == line_dedup.COUNTS else 0
    got = {(r["h"], r["id"]) for r in out if r["state"] == line_dedup.GOES or r["state"] == line_dedup.WAITS and total[r["h"]] >= 4}
    count = Counter(r[0] for r in rows)
    assert got == {(r[0], r[3]) for r in rows if count[r[0]] >= 4}


def test_keys_of_few_characters_stay(spark):
    docs = spark.createDataFrame([(i, f"ab\nabc\né\n{i}") for i in range(12)], "doc_id long, text string")
    assert {r.kept_text.replace(str(r.doc_id), "#") for r in line_dedup.remove(docs, min_chars=3).collect()} == {"ab\né\n#"}


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.digest(_frame(spark, [], "doc_id long, text string")).collect() == []


def _runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def _strange(rng):
    kinds = "abcde"[: rng.choice([1, 2, 2, 3, 5])]
    shape = rng.random()
    if shape < 0.2:  # Fibonacci words are full of runs
        a, b = "a", "ab"
        for _ in range(8):
            a, b = b, b + a
        at = rng.randint(0, 20)
        return list(b[at : at + rng.randint(0, 70)])
    if shape < 0.3:  # and those of Thue and Morse hold none of three periods
        return ["ab"[bin(i).count("1") % 2] for i in range(rng.randint(0, 90))]
    words = []
    for _ in range(rng.randint(0, 6)):
        words += [rng.choice(kinds) for _ in range(rng.randint(1, 9))] * rng.randint(1, 6)
        if rng.random() < 0.3:
            words += words[rng.randrange(len(words)) :]
    return words


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_strange_texts(least):
    rng = random.Random(least)
    for _ in range(400):
        texts = [_strange(rng) for _ in range(4)]
        got = periodic_runs.Block([" ".join(t).encode() for t in texts]).runs(least)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [_runs(t, least) for t in texts]


def _digest(i, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = _runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    left = [w for k, w in enumerate(words) if not any(s + q <= k < s + size for s, size, q in runs)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(left)))


def test_runs_query_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, RNG.choice([" ", "\n", "\x0b "]).join(_strange(rng) * rng.choice([1, 1, 3]))) for i in range(300)]
    rows += [*rows[:20], (None, "a " * 20), (None, None), (-5, "b c " * 9), (400, ""), (401, " \t"), (402, "é " * 3000 + "x"), (403, "w" * 300_000 + " a" * 13)]
    got = [tuple(r) for r in periodic_runs.digest(_frame(spark, rows, "doc_id long, text string")).collect()]
    order = lambda r: tuple(map(str, r))
    want = [_digest(i, t) for i, t in rows]
    assert sum(r[1] > 0 for r in want) > 60 and sorted(got, key=order) == sorted(want, key=order)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 10


def test_runs_of_an_empty_table_and_of_long_texts(spark):
    assert periodic_runs.digest(_frame(spark, [], "doc_id long, text string")).collect() == []
    long = periodic_runs.Block([b"a b c " * 60_000 + b"d " + b"a b " * 50_000])
    assert [r.tolist() for r in long.runs()] == [[[0, 180_000, 3], [180_001, 100_000, 2]]]
