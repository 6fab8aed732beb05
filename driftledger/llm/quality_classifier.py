"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown in numpy on a bounded sample of labelled rows and flattened
into arrays (feature, threshold, left, right, value).  Scoring walks all rows of
an Arrow batch down all trees at once.

Defined results: null and empty texts have statistics of 0 and get the score the
model gives those; repeated rows get one row each; with no usable labels, or one
class only, every score is the share of label 1 in the sample (0.5 if empty); texts
of any length are measured whole; an empty table gives no rows; other columns of any
name are not read by `classify` and come back unchanged from `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftledger.llm import docstats
from driftledger.llm.common import columns_of, is_held_out, labelled_sample, unused

FEATURES = [*docstats.BASE, *docstats.RATIOS]
#: Labelled rows that a fit may use, half of each class at most.
SAMPLE_ROWS = 20_000


@dataclass
class Trees:
    """Boosted trees as flat arrays; tree t starts at node roots[t]; leaves have feature -1."""

    base: float
    roots: list[int] = field(default_factory=list)
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    depth: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, dtype=np.int32)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, down, at)
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 48, rate: float = 0.15, ridge: float = 1.0, least: float = 3.0) -> Trees:
    """Boost depth-limited trees on the logistic loss, splits sought over histograms."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Trees(base=30.0 if share == 1 else -30.0 if share == 0 else 0.0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    trees = Trees(base=float(np.log(share / (1 - share))), depth=depth)
    nodes: list[list] = []
    margin = np.full(len(y), trees.base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, 0, 0, float(-rate * gs / (hs + ridge))])
        best, where = 1e-6, None
        if level < depth and len(rows) > 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                gl = np.bincount(b, g[rows], len(c) + 1).cumsum()[:-1]
                hl = np.bincount(b, h[rows], len(c) + 1).cumsum()[:-1]
                nl = np.bincount(b, minlength=len(c) + 1).cumsum()[:-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, where = gain[k], (f, k)
        if where is None:
            margin[rows] += nodes[me][4]
            return me
        f, k = where
        low = binned[rows, f] <= k
        nodes[me][:2] = [f, float(cuts[f][k])]
        nodes[me][2] = grow(rows[low], g, h, level + 1)
        nodes[me][3] = grow(rows[~low], g, h, level + 1)
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        trees.roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0))
    trees.feature, trees.left, trees.right = (np.array([n[i] for n in nodes], dtype=np.int32) for i in (0, 2, 3))
    trees.threshold, trees.value = (np.array([n[i] for n in nodes]) for i in (1, 4))
    return trees


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most `limit` labelled rows outside the held-out fold.

    Only the statistics of those rows, a bounded table, come to the driver.
    """
    sample = labelled_sample(docs, labels, "quality", limit)
    rows = docstats.with_stats(sample, ["doc_id", "label"]).toPandas().sort_values("doc_id")
    return fit_trees(rows[FEATURES].to_numpy(dtype=float), rows["label"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Trees, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns `keep` and the score, one row for each row of docs, from its whole text."""
    # names by place inside, as mapInArrow takes no name with a dot
    places = [f"_{i}" for i in range(len(keep))]
    kept = docs.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(keep, places, strict=True)), F.col("text").alias("_text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x = np.array([docstats.of_text(t) for t in rows.column(len(keep)).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(model.score(x), pa.float64())], names=[*places, "_score"])

    return kept.mapInArrow(run, f"{kinds}_score double").toDF(*keep, name)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = score(docs, fit(docs, labels, limit))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs whose score reaches the threshold; all columns stay, whatever their names.

    Null and empty texts are scored by their statistics, which are all 0, and go
    if these score low; null and repeated ids change nothing; very long texts are
    read whole; ties at the threshold stay; an empty table stays empty.
    """
    name = unused(docs, "__score")
    scored = score(docs, fit(docs, labels, limit), keep=tuple(docs.columns), name=name)
    return scored.where(F.col(name) >= threshold).select(columns_of(docs))
