"""Quality rules: ordered decision lists learned from labelled statistics.

Sequential covering: a conjunction of threshold tests is grown on two thirds of
the labelled rows left (best information gain first), pruned on the other third,
kept if it is precise enough there, and the rows that it covers are taken out.
The list becomes one ordered Spark conditional expression over columns of
statistics, which any user can read and edit.

Defined results: null and empty texts have no words, fail the base rule
(n_words < 50) and are not kept; repeated rows give one row each; without usable
labels the list is empty and the base rule alone decides; texts of any length are
measured whole; an empty table gives no rows; other columns of any name are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftledger.llm import docstats
from driftledger.llm.common import labelled_sample

#: Labelled rows that a fit may use, half of each class at most.
SAMPLE_ROWS = 20_000
#: Statistics that rules may test; the rest of a row identifies it.
TESTED = [*docstats.BASE, *docstats.RATIOS]
#: Fixed values of the base rule: too few words, or too large a part of them repeated.
BASE_MIN_WORDS, BASE_MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Test:
    stat: str
    above: bool
    threshold: float

    def on(self, x: np.ndarray) -> np.ndarray:
        col = x[:, TESTED.index(self.stat)]
        return col > self.threshold if self.above else col <= self.threshold

    def column(self) -> Column:
        c = F.col(self.stat)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rows that pass all tests are rejected."""

    tests: tuple[Test, ...]

    def on(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([t.on(x) for t in self.tests])

    def column(self) -> Column:
        out = self.tests[0].column()
        for t in self.tests[1:]:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def _grow(x: np.ndarray, bad: np.ndarray, most: int, cuts: int) -> list[Test]:
    """Add the test of the highest gain until no good row is covered."""
    tests: list[Test] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(tests) < most and (bad & inside).any() and (~bad & inside).any():
        rows, target = x[inside], bad[inside]
        p, n = target.sum(), (~target).sum()
        before = np.log2(p / (p + n))
        best, found = 1e-9, None
        for f, stat in enumerate(TESTED):
            for c in np.unique(np.quantile(rows[:, f], np.linspace(0, 1, cuts + 1)[1:-1])):
                high = rows[:, f] > c
                for above, side in ((True, high), (False, ~high)):
                    pp = (target & side).sum()
                    nn = side.sum() - pp
                    if pp and (gain := pp * (np.log2(pp / (pp + nn)) - before)) > best:
                        best, found = gain, Test(stat, above, float(c))
        if found is None:
            break
        tests.append(found)
        inside &= found.on(x)
    return tests


def learn(x: np.ndarray, good: np.ndarray, ids: np.ndarray, most_rules: int = 12, most_tests: int = 4, cuts: int = 24, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Rules that reject rows of label 0, in the order they were found."""
    bad, rules = good == 0, []
    left = np.ones(len(bad), dtype=bool)
    fold = (ids.astype(np.int64) * 2654435761 >> 16) % 3 == 0
    while len(rules) < most_rules and (bad & left).sum() >= least:
        grow, prune = left & ~fold, left & fold
        tests = _grow(x[grow], bad[grow], most_tests, cuts)
        if not tests:
            break

        def worth(k: int) -> float:
            hit = Rule(tuple(tests[:k])).on(x[prune])  # noqa: B023
            p = (bad[prune] & hit).sum()  # noqa: B023
            return (2 * p - hit.sum()) / max(1, hit.sum())

        rule = Rule(tuple(tests[: max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))]))
        hit = rule.on(x) & left
        if (bad & hit).sum() < least or (bad & hit).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from at most `limit` labelled rows outside the held-out fold; only their statistics come to the driver."""
    rows = docstats.with_stats(labelled_sample(docs, labels, "quality", limit), ["doc_id", "label"]).toPandas().sort_values("doc_id")
    if rows["label"].nunique() < 2:
        return []
    return learn(rows[TESTED].to_numpy(dtype=float), rows["label"].to_numpy(), rows["doc_id"].to_numpy())


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), 0 if none: one ordered conditional expression."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].column(), F.lit(k)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words"))


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The base counts, base_failed, rule and kept of every row, from its whole text."""
    return docstats.with_stats(docs, ["doc_id"]).select(
        "doc_id", *docstats.BASE, base_failed().alias("base_failed"), verdict(rules).alias("rule"), (~base_failed() & (verdict(rules) == 0)).alias("kept")
    )


def classify(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    return apply_rules(docs, fit(docs, labels, limit))
