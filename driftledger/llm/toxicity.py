"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (and of itself).  A
document is the mean of all its words, each with a weight that is learned too: the
exponential of a linear function of the word's vector, 1 for a word of unknown
subwords.  So a few insults in a long text are not averaged away, and no word is
left out.  NEUTRAL words of weight 1 are added, so that one chance word does not
decide a short text.  A linear softmax over the mean gives the score.  Vectors,
weights and softmax are trained jointly in numpy: first on stretches of documents,
then on whole ones.  An unseen misspelling shares n-grams with known words and so a
part of their vectors.  A run of over LONGEST letters (words glued together, scripts
without spaces) counts as several words: overlapping pieces of PIECE letters, so
that all of it is scored.

A word enters the score through two numbers, its weight and its part in the
log-odds, which scoring looks up for every word of the text.

Defined results: null and empty texts, and texts without letters, score as an
empty bag (the softmax of its bias); texts of any length are scored whole; repeated
rows give one row each; an empty table gives no rows; only the columns doc_id and
text are read; without labels, or with one class only, every score is the share of
label 1 (0.5 if no labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftledger.llm.common import is_held_out, labelled_sample

#: Labelled rows that a fit may use, half of each class at most.
SAMPLE_ROWS = 6_000
#: Characters of text that a fit takes to the driver, about; its rows come in the order of a hash of their ids.
FIT_BYTES = 60_000_000
#: Words of weight 1 and no meaning that every bag holds besides its own.
NEUTRAL = 8
#: Words in a stretch, and stretches of a document, in the first part of a fit.
STRETCH, STRETCHES = 8, 4
#: A word's weight is between exp(-STEEP) and exp(STEEP).
STEEP = 12.0
#: Vectors of a fit at most, and the standard errors at which a vector counts for half.
VECTORS, DOUBT = 10_000, 5.0
#: Lengths of the character n-grams of a word with its end marks.
NGRAMS = (3, 4, 5, 6)
#: Letters of a word at most; longer runs are cut into pieces of PIECE letters, each half over the next, so every n-gram is in one.
LONGEST, PIECE = 64, 24
#: Word parts kept for scoring at once in a task; the table starts afresh beyond.
CACHE_WORDS = 400_000

_LETTERS = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    """The words of a text; runs of over LONGEST letters give their overlapping pieces."""
    out: list[str] = []
    for run in _LETTERS.findall(text.lower()) if text else []:
        if len(run) <= LONGEST:
            out.append(run)
        else:
            out += [run[i : i + PIECE] for i in range(0, len(run) - PIECE // 2, PIECE // 2)]
    return out


def subwords(word: str) -> list[str]:
    """The word with end marks and its character n-grams."""
    w = f"<{word}>"
    return [w, *(w[i : i + n] for n in NGRAMS for i in range(len(w) - n + 1) if n < len(w))]


@dataclass
class Model:
    part: dict[str, tuple[float, float]]  # a subword's parts in the log-odds and in the logarithm of the weight
    bias: float

    def word(self, word: str) -> tuple[float, float]:
        """(weight, weight times part in the log-odds)."""
        got = subwords(word)
        known = [p for s in got if (p := self.part.get(s)) is not None]
        weight = math.exp(min(STEEP, max(-STEEP, sum(p[1] for p in known) / len(got))))
        return weight, weight * sum(p[0] for p in known) / len(got)

    def scorer(self):
        """A function from text to score that remembers the words it has met."""
        known: dict[str, tuple[float, float]] = {}

        def score(text: str | None) -> float:
            if len(known) > CACHE_WORDS:
                known.clear()
            total, odds = float(NEUTRAL), 0.0
            for w, n in Counter(tokens(text)).items():
                got = known.get(w)
                if got is None:
                    got = known[w] = self.word(w)
                total += n * got[0]
                odds += n * got[1]
            return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.bias + odds / total))))

        return score


@dataclass
class _Bags:
    """Bags of words: entry k says that word[k] stands count[k] times in bag owner[k]; words of unknown subwords are only counted."""

    owner: np.ndarray
    word: np.ndarray
    count: np.ndarray
    neutral: np.ndarray  # of each bag
    label: np.ndarray

    @classmethod
    def of(cls, bags: list[np.ndarray], labels: list[int], unknown: np.ndarray) -> _Bags:
        size = np.array([len(b) for b in bags])
        flat, owner = np.concatenate(bags), np.repeat(np.arange(len(bags)), size)
        neutral = NEUTRAL + np.bincount(owner[unknown[flat]], minlength=len(bags)).astype(np.float32)
        use = ~unknown[flat]
        key, count = np.unique(owner[use] * np.int64(len(unknown)) + flat[use], return_counts=True)
        return cls(key // len(unknown), key % len(unknown), count.astype(np.float32), neutral, np.array(labels))


def _sum_by(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, k], minlength=size) for k in range(values.shape[1])], axis=1).astype(np.float32)


def _loss(params: tuple, bags: _Bags, words: tuple, cost: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Cross-entropy of the bags and its gradient by vectors, softmax, bias and pull.

    words: (word, subword, share) of each subword in a word, and the number of words;
    cost: of each bag, as a column.
    """
    emb, soft, bias, pull = params
    rows, cols, share, n_words = words
    n = len(bags.label)
    word = _sum_by(rows, emb[cols] * share, n_words)
    h = word[bags.word]
    log_weight = h @ pull
    mass = bags.count * np.exp(np.clip(log_weight, -STEEP, STEEP))
    total = bags.neutral + np.bincount(bags.owner, mass, minlength=n)
    alpha = (mass / total[bags.owner]).astype(np.float32)[:, None]
    mean = _sum_by(bags.owner, alpha * h, n)
    logit = mean @ soft + bias
    logit -= logit.max(axis=1, keepdims=True)
    p = np.exp(logit)
    p /= p.sum(axis=1, keepdims=True)
    loss = float(-(np.log(np.maximum(p[np.arange(n), bags.label], 1e-30)) * cost[:, 0]).sum())
    p[np.arange(n), bags.label] -= 1
    p = (p * cost).astype(np.float32)
    g_mean = p @ soft.T
    g_here = g_mean[bags.owner]
    g_log = alpha * ((h - mean[bags.owner]) * g_here).sum(axis=1, keepdims=True)
    g_word = _sum_by(bags.word, alpha * g_here + g_log * pull, n_words)
    return loss, [_sum_by(cols, g_word[rows] * share, len(emb)), mean.T @ p, p.sum(axis=0), (g_log * h).sum(axis=0)]


def train(texts: list[str | None], labels: list[int], dim: int = 6, epochs: tuple[int, int] = (10, 50), rate: float = 0.08, vectors: int = VECTORS, doubt: float = DOUBT, decay: float = 1e-5) -> Model:
    """Fit vectors, weights and softmax together by Adam on the cross-entropy of the bags.

    A subword's vector is shrunk by z^4 / (z^4 + doubt^4), where z says by how many
    standard errors its share of documents differs between the classes, so that
    chance has a small part and no subword is judged by a bar.  The table of vectors
    holds `vectors` subwords, those shrunk least; others are zero vectors.
    """
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        return Model({}, float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -12, 12)))
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in tokens(t)], dtype=np.int32) for t in texts]
    number: dict[str, int] = {}
    split = [np.array([number.setdefault(s, len(number)) for s in subwords(w)], dtype=np.int32) for w in index]
    seen = np.zeros((2, len(number)))  # in how many documents of each class a subword stands
    for d, label in zip(docs, y, strict=True):
        if len(d):
            seen[label, np.unique(np.concatenate([split[i] for i in np.unique(d)]))] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    p = seen.sum(axis=0) / (n0 + n1)
    apart = np.abs(seen[1] / n1 - seen[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n0 + 1 / n1))
    shrunk = apart**4 / (apart**4 + doubt**4)
    kept = np.zeros(len(number), dtype=bool)
    kept[np.argsort(-shrunk, kind="stable")[:vectors]] = True
    kept &= shrunk > 0
    if not kept.any():
        return Model({}, float(np.log(n1 / n0)))
    size = np.array([len(s) for s in split])
    flat = np.concatenate(split)
    use = kept[flat]
    rows, cols = np.repeat(np.arange(len(split)), size)[use], (np.cumsum(kept) - 1)[flat[use]]
    share = (np.repeat(1 / size, size)[use] * shrunk[flat[use]]).astype(np.float32)[:, None]
    grams = [s for s, i in number.items() if kept[i]]
    n_words = len(index)
    unknown = np.bincount(rows, minlength=n_words) == 0
    del split, number, flat, seen, index
    rng = np.random.default_rng(0)
    emb = rng.normal(0, 0.1, (len(grams), dim)).astype(np.float32)
    soft, bias, pull = rng.normal(0, 0.1, (dim, 2)).astype(np.float32), np.zeros(2, dtype=np.float32), rng.normal(0, 0.1, dim).astype(np.float32)
    params = (emb, soft, bias, pull)
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    balance = len(y) / (2 * np.array([n0, n1]))
    held = [(d, label) for d, label in zip(docs, y.tolist(), strict=True) if len(d)]
    stretches = [(d[b : b + STRETCH], label) for d, label in held for b in rng.integers(0, max(1, len(d) - STRETCH + 1), STRETCHES)]
    for chosen, turns in zip((stretches, held), epochs, strict=True):
        bags = _Bags.of(*zip(*chosen, strict=True), unknown)
        cost = (balance[bags.label] / balance[bags.label].sum())[:, None]
        for _ in range(turns):
            step += 1
            grads = _loss(params, bags, (rows, cols, share, n_words), cost)[1]
            for k in (0, 1, 3):
                grads[k] = grads[k] + decay * params[k]
            for k, (param, g) in enumerate(zip(params, grads, strict=True)):
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                param -= (rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    emb *= shrunk[kept][:, None].astype(np.float32)
    odds, weight = emb @ (soft[:, 1] - soft[:, 0]), emb @ pull
    return Model({s: (float(odds[i]), float(weight[i])) for i, s in enumerate(grams)}, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Model:
    """A model from at most `limit` labelled rows outside the held-out fold, and at most about FIT_BYTES of text."""
    rows, size = [], 0
    for r in labelled_sample(docs, labels, "toxic", limit).orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        size += len(r.text or "")
        if size > FIT_BYTES:
            break
        rows.append((r.doc_id, r.text, r.label))
    rows.sort(key=lambda r: r[0])
    return train([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([of(t) for t in rows.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = score(docs, fit(docs, labels, limit))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
