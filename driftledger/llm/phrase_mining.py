"""Phrase collocations: frequent word sequences of each language, by Rabin-Karp fingerprints.

1. Documents are dealt into batches of a few MB.  A batch cuts its texts into
   pieces and words and takes the fingerprint of every 1- to 3-gram inside a piece
   from prefix polynomials in numpy.  Each different gram of the batch is sent
   once, with its count, a pointer to one of its places and 32 bits of its
   fingerprint besides those that choose its bucket.
2. Buckets of fingerprints add the counts up.  Where the sum reaches `least`, the
   pointers go back to the batches that they came from.
3. A batch reads the words at its pointers out of the text.  Spark groups these
   phrases by their letters and adds the counts up again, so bits that two phrases
   share cost time and change nothing; only phrases of frequent
   fingerprints are ever made.
4. Joins of the phrases with their parts give the scores; parts that many phrases
   share are told to them by a broadcast of bounded size.

A batch tells its grams apart by exact word numbers, not by fingerprints.

Defined results: null texts count as empty, a null lang as `und`; null and
repeated ids do not matter, each row counts; copies of a row count as often as
they stand there; texts of any length are read whole; a run of other characters
than space and tab is one word, however long; equal scores and counts are ordered
by the bytes of the phrase; an empty table, or one without frequent phrases, gives
no rows; other columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftledger.checkpoints import kept
from driftledger.llm.wordhash import mix, run_prints

#: Bytes of text in a batch, about, and grams to a bucket, about.
BATCH_BYTES, BUCKET_GRAMS = 8 << 20, 1_000_000
#: Words of the longest phrase.
MOST_WORDS = 3
#: A part that over one in so many uses of parts name is told by a broadcast; there are about that many at most.
HOT_SHARE = 1000
#: Candidates of one language to a task of the first ranking, about.
RANK_ROWS = 20_000

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[np.frombuffer(b".,;:!?\n\x0b\x0c\r", dtype=np.uint8)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = np.uint64(0xA24BAED4963EE407)

_SENT = "bucket int, batch int, codes binary, counts binary, prints binary"
_BACK = "batch int, codes binary, counts binary"
_PHRASES = "lang string, words int, phrase string, f long"


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes first: like bytes stand together and compress."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplane(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


class Grams:
    """The words of a batch of texts, in a fixed order of its rows, whatever order they arrive in.

    normal: all words in lower case, each followed by one space; start, size: of
    each word there; lang: the place of its language in `langs`; run: how many
    words follow in its piece, itself included.
    """

    def __init__(self, langs: list[str], texts: list[bytes | None]):
        order = sorted(range(len(texts)), key=lambda i: (langs[i], texts[i] or b""))
        self.langs = sorted(set(langs))
        raw = b"\n".join([texts[i] or b"" for i in order]) + b"\n"
        low = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
        kind = _KIND[low]
        keep = kind == 0
        edge = np.flatnonzero(np.diff(keep.view(np.int8), prepend=np.int8(0)))
        start, end = edge[0::2], edge[1::2]
        breaks = np.flatnonzero(kind == 2)
        piece = np.searchsorted(breaks, start)
        begins = np.cumsum([0] + [len(texts[i] or b"") + 1 for i in order[:-1]])
        number = {lang: k for k, lang in enumerate(self.langs)}
        of_row = np.array([number[langs[i]] for i in order], dtype=np.int32)
        self.lang = of_row[np.searchsorted(begins, start, side="right") - 1] if len(start) else np.zeros(0, dtype=np.int32)
        low[end] = 0x20
        keep[end] = True
        self.normal = low[keep]
        self.size = (end - start).astype(np.int64)
        self.start = np.cumsum(self.size + 1) - self.size - 1
        n = len(start)
        ends = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, n) if n else np.zeros(0, dtype=np.int64)
        self.run = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)

    def _ids(self) -> np.ndarray:
        """Numbers that are equal for equal words."""
        offsets = np.append(self.start, len(self.normal)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(self.normal)])
        return words.dictionary_encode().indices.to_numpy()

    def prints(self) -> list[np.ndarray]:
        """The fingerprint of the gram of 1, 2, ... words that starts at each word, by one subtraction of prefix polynomials."""
        n = len(self.start)
        one = run_prints(self.normal, self.start)
        power = np.full(n + 1, _BASE, dtype=np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        inverse = np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(one * power[:n], out=sums[1:])
        raw = np.frombuffer("".join(lang + "\n" for lang in self.langs).encode(), dtype=np.uint8)
        sizes = np.array([len(lang.encode()) + 1 for lang in self.langs], dtype=np.int64)
        seed = run_prints(raw, np.cumsum(sizes) - sizes)[self.lang]
        return [mix((sums[k:] - sums[: n + 1 - k]) * inverse[: n + 1 - k] + np.uint64(k) ^ seed[: n + 1 - k]) for k in range(1, MOST_WORDS + 1) if n >= k]

    def different(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, count, fingerprint) of each different gram; a code is MOST_WORDS * (its first word here) + its words - 1."""
        ids = self._ids()
        codes, counts, prints = [], [], []
        for k, p in enumerate(self.prints(), 1):
            at = np.flatnonzero(self.run[: len(p)] >= k)
            p = p[at]
            order = np.argsort(p)
            same = p[order[1:]] == p[order[:-1]]
            key = [self.lang] + [ids[j:] for j in range(k)]
            a, b = at[order[1:]][same], at[order[:-1]][same]
            if any((x[a] != x[b]).any() for x in key):  # two grams of the batch share a fingerprint
                order = np.lexsort([x[at] for x in key])
                same = np.ones(len(order) - 1, dtype=bool)
                for x in key:
                    same &= x[at[order[1:]]] == x[at[order[:-1]]]
            head = np.flatnonzero(np.append(True, ~same)) if len(order) else np.zeros(0, dtype=np.int64)
            codes.append(at[order[head]] * MOST_WORDS + k - 1)
            counts.append(np.diff(np.append(head, len(order))))
            prints.append(p[order[head]])
        if not codes:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        return np.concatenate(codes), np.concatenate(counts), np.concatenate(prints)

    def phrases(self, codes: np.ndarray, counts: np.ndarray) -> pa.Table:
        """The grams at the codes as rows of language, number of words, text and count."""
        first, words = codes // MOST_WORDS, codes % MOST_WORDS + 1
        begin, last = self.start[first], first + words - 1
        size = self.start[last] + self.size[last] - begin
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.normal[np.arange(total) - np.repeat(ends - size, size) + np.repeat(begin, size)]
        offsets = np.append(0, ends).astype(np.int64)
        text = pa.Array.from_buffers(pa.large_string(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())
        langs = pa.array(self.langs, pa.string()).take(pa.array(self.lang[first]))
        return pa.table([langs, pa.array(words.astype(np.int32)), text, pa.array(counts.astype(np.int64))], names=["lang", "words", "phrase", "f"])


def _grams(table: pa.Table) -> Grams:
    return Grams(table.column("lang").to_pylist(), table.column("text").cast(pa.binary()).to_pylist())


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs of equal neighbours."""
    edge = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a)) if len(a) else np.zeros(1, dtype=np.int64)
    return edge[:-1], edge[1:]


def _send(n_buckets: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        codes, counts, prints = _grams(table).different()
        bucket = ((prints >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket << np.int64(36) | codes)  # a batch holds fewer words than would pass these bits
        b, c, n, p = bucket[order], codes[order], counts[order].astype(np.uint32), prints[order]
        rows: list[list] = [[] for _ in range(5)]
        for lo, hi in zip(*_runs(b), strict=True):
            step = np.diff(c[lo:hi], prepend=0).astype(np.uint32)
            row = (int(b[lo]), key[0].as_py(), _planes(step), _planes(n[lo:hi]), _planes(p[lo:hi].astype(np.uint32)))  # of a bucket that other bits choose, 32 are enough
            for col, v in zip(rows, row, strict=True):
                col.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(rows, [pa.int32()] * 2 + [pa.binary()] * 3, strict=True)], names=["bucket", "batch", "codes", "counts", "prints"])

    return run


def _frequent(least: int) -> Callable:
    """The pointers of a bucket's fingerprints whose counts add up to `least`, batch by batch."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        prints = np.concatenate([_unplane(raw, np.uint32) for raw in table.column("prints").to_pylist()])
        counts = np.concatenate([_unplane(raw, np.uint32) for raw in table.column("counts").to_pylist()])
        order = np.argsort(prints)
        head = np.flatnonzero(np.append(True, prints[order[1:]] != prints[order[:-1]]))
        sums = np.add.reduceat(counts[order].astype(np.int64), head)
        often = np.empty(len(order), dtype=bool)
        often[order] = np.repeat(sums >= least, np.diff(np.append(head, len(order))))
        rows: list[list] = [[] for _ in range(3)]
        at = 0
        for batch, raw in zip(table.column("batch").to_pylist(), table.column("codes").to_pylist(), strict=True):
            codes = np.cumsum(_unplane(raw, np.uint32).astype(np.int64))
            mine = often[at : at + len(codes)]
            if mine.any():
                row = (batch, _planes(np.diff(codes[mine], prepend=0).astype(np.uint32)), _planes(counts[at : at + len(codes)][mine]))
                for col, v in zip(rows, row, strict=True):
                    col.append(v)
            at += len(codes)
        return pa.table([pa.array(c, t) for c, t in zip(rows, [pa.int32()] + [pa.binary()] * 2, strict=True)], names=["batch", "codes", "counts"])

    return run


def _read(key: tuple, texts: pa.Table, pointers: pa.Table) -> pa.Table:
    """The phrases at the pointers of a batch, and the number of words of each of its languages as 0-word rows."""
    grams = _grams(texts)
    codes = [np.cumsum(_unplane(raw, np.uint32).astype(np.int64)) for raw in pointers.column("codes").to_pylist()]
    counts = [_unplane(raw, np.uint32) for raw in pointers.column("counts").to_pylist()]
    found = grams.phrases(np.concatenate(codes), np.concatenate(counts)) if codes else grams.phrases(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    n = np.bincount(grams.lang, minlength=len(grams.langs))
    totals = pa.table([pa.array(grams.langs, pa.string()), pa.array(np.zeros(len(n), dtype=np.int32)), pa.array([""] * len(n)), pa.array(n.astype(np.int64))], names=found.column_names)
    return pa.concat_tables([found, totals])


def phrase_counts(docs: DataFrame, least: int = 10) -> DataFrame:
    """(lang, words, phrase, f): every phrase of up to MOST_WORDS words that stands `least` times in a language; rows of 0 words hold all words."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches = max(24, -(-size // BATCH_BYTES))
    n_buckets = max(96, -(-size // (2 * BUCKET_GRAMS)))  # a word takes about six bytes and gives up to three grams
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)).cast("int").alias("batch")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text", batch)
    sent = texts.groupBy("batch").applyInArrow(_send(n_buckets), _SENT)
    back = sent.groupBy("bucket").applyInArrow(_frequent(least), _BACK)
    read = texts.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(_read, _PHRASES)
    return read.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def _told(uses: DataFrame, f: DataFrame) -> DataFrame:
    """uses with the count `f` of their part; both have (lang, part).

    A part that over 1 / HOT_SHARE of all uses name is joined by a broadcast of at
    most HOT_SHARE rows, so that a common first word is not gathered in one task.
    """
    named = uses.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("c"))
    hot = kept(named.where(F.col("c") > uses.count() // HOT_SHARE).select("lang", "part"))
    counts = F.broadcast(f.join(F.broadcast(hot), ["lang", "part"]))
    few = uses.join(F.broadcast(hot), ["lang", "part"], "left_anti")
    return uses.join(counts, ["lang", "part"]).unionByName(few.join(f, ["lang", "part"]))


def collocations(docs: DataFrame, least: int = 10, inside_percent: int = 50, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `first` phrases of each language by their worst cut's score.

    A candidate goes if a longer one that holds it stands at least inside_percent
    of its times.
    """
    counts = kept(phrase_counts(docs, least))
    candidates = counts.where("words >= 2")
    cuts = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.array_join(F.slice("w", 1, k) if side == "l" else F.slice("w", k + 1, MOST_WORDS), " ").alias("part")) for k in range(1, MOST_WORDS) for side in "lr"]
    uses = candidates.select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    uses = uses.select("lang", "words", "phrase", "a", F.explode(F.filter(F.array(*cuts), lambda c: c.k < F.col("words"))).alias("c")).select("lang", "words", "phrase", "a", "c.*")
    told = _told(uses, counts.where("words > 0").select("lang", F.col("phrase").alias("part"), "f"))
    part_count = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}") for k in range(1, MOST_WORDS) for side in "lr"]
    sides = told.groupBy("lang", "words", "phrase", "a").agg(*part_count)
    scored = sides.withColumn("cut", F.array_min(F.array(*(F.when(F.col("words") > k, _cut(k)) for k in range(1, MOST_WORDS)))))
    # what lies inside a phrase lies inside one of its two parts of one word less, and that one stands no more often
    inside = uses.where("k = words - 1 and side = 'l' or k = 1 and side = 'r'").groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    rows = kept(left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salts = -(-max(1, rows.count()) // RANK_ROWS)
    if salts > 1:  # the best of each salt first, so that no task sorts a language whole
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        rows = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= first).drop("salt", "rank")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= first)
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))  # one row a language
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cut(k: int) -> Column:
    """(score, k, l, r) of the cut after k words, in exact integers.

    10^6 a a stays under 10^38 for counts of up to 10^15; no part is rarer than its
    phrase, so a score is at most 10^6.
    """
    score = f"CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) div (CAST(l{k} AS DECIMAL(19,0)) * CAST(r{k} AS DECIMAL(19,0)))"
    return F.struct(F.expr(score).cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
