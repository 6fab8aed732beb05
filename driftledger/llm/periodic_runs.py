"""Periodic runs: stretches of words that repeat with a period, by a dictionary of basic factors.

The basic factors of a text are its stretches of 1, 2, 4, 8, ... words.  Two
factors of one length get one name if they are equal; a name of 2L words is the
pair of the names of its halves.  A factor that stands only once in its text is
in no run and goes, and so do all that hold it.

At length L, places where a factor stands again within L / 2 words lie in one
arithmetic progression; its first place is called a head.  Every place proposes
its distances from L to 2L - 1 to the next heads of its factor as periods; there
are at most three heads so near.  A run of smallest period q, L <= q < 2L, is
always proposed: either some factor of its first period has no period of up to
L / 2, so all its places are heads; or that whole stretch has such a period d and
its next copy, q further on, begins a progression of its own, as a stretch of d
words with both phases would make the run's period smaller.

Proposals are extended to both sides by whole factors, longest first, all of them
at once; equal runs count once, and of equal stretches the smallest period does.
Time is n log n words, and every step compares names, not hashes.

Defined results: null texts have no words; rows with a null id are taken as they
are; repeated rows give one row each; texts of any length are searched whole; an
empty table gives no rows; other columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and two periods.
MIN_LENGTH = 12
#: Bytes of texts that one dictionary holds, about; a longer text has one of its own.
BLOCK_BYTES = 4 << 20
#: Where one place in so many is left, names are kept as a sorted list instead of an array over all places.
_SPARSE = 6


class Factors:
    """Names of the basic factors of many texts laid end to end.

    words: a number for each word, equal for equal words; owner: the text of each
    word.  Equal factors of different texts get different names.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        self.n = n = len(words)
        self.owner = owner
        places, key = np.arange(n, dtype=np.int64), owner.astype(np.int64) << np.int64(32) | words.astype(np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.next_heads: list[np.ndarray] = []
        while True:
            order = np.argsort(key, kind="stable")
            new = np.append(True, key[order[1:]] != key[order[:-1]]) if len(order) else np.zeros(0, dtype=bool)
            group = np.cumsum(new) - 1
            many = (np.bincount(group) > 1)[group] if len(order) else new
            at, name = places[order[many]], group[many]  # by name, then place
            if not len(at):
                break
            back = np.argsort(at)
            self.levels.append(self._stored(at[back], name[back].astype(np.int64)))
            self.next_heads.append(np.stack([at, name]))
            size = 1 << len(self.levels) - 1
            halves, names = at[back], name[back]
            second = np.searchsorted(halves, halves + size)
            ok = second < len(halves)
            ok[ok] = halves[second[ok]] == halves[ok] + size
            ok[ok] &= owner[halves[ok]] == owner[halves[second[ok]]]
            places = halves[ok]
            key = names[ok].astype(np.int64) << np.int64(32) | names[second[ok]].astype(np.int64)

    def _stored(self, at: np.ndarray, name: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        if len(at) * _SPARSE < self.n:
            return at, name.astype(np.int32)
        dense = np.full(self.n, -1, dtype=np.int32)
        dense[at] = name
        return None, dense

    def name(self, level: int, i: np.ndarray) -> np.ndarray:
        """The names of the factors at the places i; -1 where a factor stands once, or leaves the block."""
        at, names = self.levels[level]
        inside = (i >= 0) & (i < self.n)
        if at is None:
            return np.where(inside, names[np.where(inside, i, 0)], -1)
        k = np.minimum(np.searchsorted(at, i), len(at) - 1)
        return np.where(inside & (at[k] == i), names[k], -1)

    def proposals(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) pairs."""
        out = []
        for level, (at, name) in enumerate(self.next_heads):
            size = 1 << level
            again = np.append(False, (name[1:] == name[:-1]) & (2 * (at[1:] - at[:-1]) <= size))
            heads = np.append(np.flatnonzero(~again), len(at))
            following = np.searchsorted(heads, np.arange(len(at)), side="right")
            for k in range(3):
                h = heads[np.minimum(following + k, len(heads) - 1)]
                ok = h < len(at)
                ok[ok] = name[h[ok]] == name[ok]
                mine = np.flatnonzero(ok)
                period = at[h[mine]] - at[mine]
                fit = (period >= size) & (period < 2 * size)
                out.append((at[mine[fit]], period[fit]))
        if not out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place, period = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((place, period))
        place, period = place[order], period[order]
        lone = np.ones(len(place), dtype=bool)  # of places next to each other with one period, one is enough
        lone[1:] = (period[1:] != period[:-1]) | (place[1:] > place[:-1] + 1)
        return place[lone], period[lone]

    def runs(self, min_length: int = MIN_LENGTH) -> np.ndarray:
        """Rows (start, length, period) of all runs, by start and period; places count through the block."""
        place, period = self.proposals()
        right, left = place.copy(), place.copy()  # words [left, right) equal those a period later
        for level in range(len(self.levels) - 1, -1, -1):
            size = 1 << level
            for _ in range(2 if level == len(self.levels) - 1 else 1):
                a, b = self.name(level, right), self.name(level, right + period)
                right = np.where((a >= 0) & (a == b), right + size, right)
                a, b = self.name(level, left - size), self.name(level, left - size + period)
                left = np.where((a >= 0) & (a == b), left - size, left)
        length = right - left + period
        fit = length >= np.maximum(min_length, 2 * period)
        found = np.stack([left[fit], length[fit], period[fit]], axis=1)
        if len(found):
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))]
            found = found[np.lexsort((found[:, 2], found[:, 0]))]
        return found


class Block:
    """The words of a block of texts; texts may be given a planted repeat (first word, period) each."""

    def __init__(self, texts: list[bytes | None], planted: list[tuple[int, int] | None] | None = None):
        words = [(t or b"").split() for t in texts]  # bytes.split() parts at space, tab, LF, VT, FF and CR
        for i, plan in enumerate(planted or ()):
            if plan is not None:
                a, p = plan
                w = words[i]
                words[i] = w[:a] + (w[a : a + p] * (-(-(len(w) - a) // p)))[: len(w) - a]
        self.words = words
        self.count = np.array([len(w) for w in words], dtype=np.int64)
        self.begin = np.cumsum(self.count) - self.count
        flat = [x for w in words for x in w]
        ids = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy() if flat else np.zeros(0, dtype=np.int32)
        self.factors = Factors(ids, np.repeat(np.arange(len(words)), self.count))

    def runs(self, min_length: int = MIN_LENGTH) -> list[np.ndarray]:
        """The runs of each text, with places counted in it."""
        found = self.factors.runs(min_length)
        owner = self.factors.owner[found[:, 0]] if len(found) else np.zeros(0, dtype=np.int64)
        cut = np.searchsorted(owner, np.arange(len(self.words) + 1))
        return [found[lo:hi] - np.array([b, 0, 0]) for lo, hi, b in zip(cut[:-1], cut[1:], self.begin, strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [w for w, d in zip(words, depth[:-1].cumsum().tolist(), strict=True) if not d]


def plant(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The repeat that the test design puts into one document of ten: its first word and period."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


_OUT = "doc_id long, n_words long, n_runs long, start long, length long, period long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find(docs: DataFrame, min_length: int = MIN_LENGTH, planted: bool = False) -> DataFrame:
    """One row per row: its runs, the longest of them (ties: smallest start, then period), and the text with each run cut to one period.

    planted: documents chosen by their id are given a repeat first.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        ids, texts, size = [], [], 0
        for rows in batches:
            for i, t in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if ids and size + len(t or b"") > BLOCK_BYTES:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t or b"")
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
        for ids, texts in blocks(batches):
            block = Block(texts, [plant(i, len((t or b"").split())) for i, t in zip(ids, texts, strict=True)] if planted else None)
            rows = []
            for i, words, runs in zip(ids, block.words, block.runs(min_length), strict=True):
                best = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=[None] * 3)
                listed = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()]
                rows.append((i, len(words), len(runs), *best, listed, b" ".join(collapsed(words, runs))))
            cols = [pa.array(c, pa.binary() if k == 7 else t) for k, (c, t) in enumerate(zip(zip(*rows, strict=True), kinds, strict=True))]
            cols[7] = cols[7].cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _OUT.replace("<start:long,length:long,period:long>", "").split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)


def digest(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, with the planted repeats."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    exponent = F.expr("1000 * length div period").alias("exponent_milli")
    return find(docs, min_length, planted=True).select("doc_id", "n_runs", "start", "length", "period", exponent, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
