"""Statistics of whole texts, one Arrow batch at a time."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words are runs of characters other than space, tab, LF, VT, FF and CR.
WORD = re.compile("[^\x20\x09-\x0d]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_DIGIT = re.compile(r"[0-9]")
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")

#: The counts that the contract of the quality rules fixes.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that the learned models use besides.
RATIOS = (
    "log_words", "mean_word_chars", "sd_word_chars", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "top_word_rate",
    "upper_word_rate", "upper_char_rate", "digit_rate", "alpha_rate", "stop_end_rate", "comma_rate", "bang_rate", "pipe_rate",
    "mean_line_words", "short_line_rate", "adjacent_rate", "long_word_rate", "odd_end_rate",
)


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * kinds + ids[1:]
    if kinds > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
        key = pair[:-1] * np.int64(n + 1) + np.unique(ids, return_inverse=True)[1][2:]
    else:
        key = pair[:-1] * kinds + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(n - 2, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def of_text(text: str | None) -> tuple:
    """BASE and then RATIOS of one text; all 0 for a null or empty one."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    dup_lines = lines = short = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            short += len(line) < 200 and len(WORD.findall(line)) < 4
            if line in seen:
                dup_lines += 1
            seen.add(line)
    if not n:
        return (0,) * (len(BASE) + len(RATIOS))
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=n)
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    chars = int(size.sum())
    symbols = len(_SYMBOL.findall(text))
    repeats = repeated_words(ids, len(index))
    kinds = Counter(w[-1] for w in words)
    count = np.bincount(ids)
    upper = sum(map(str.isupper, words))
    alpha = sum(map(str.isalpha, words))
    ends = kinds["."] + kinds["?"] + kinds["!"]
    odd = sum(v for k, v in kinds.items() if not (k.isalnum() or k in ".,;:!?"))
    ratios = (
        np.log1p(n), chars / n, float(size.std()), symbols / n, dup_lines / max(1, lines), repeats / n, len(index) / n, float(count.max()) / n,
        upper / n, len(_UPPER.findall(text)) / len(text), len(_DIGIT.findall(text)) / len(text), alpha / n, ends / n, kinds[","] / n, text.count("!") / n, text.count("|") / n,
        n / max(1, lines), short / max(1, lines), float((ids[1:] == ids[:-1]).sum()) / n, float((size > 16).sum()) / n, odd / n,
    )
    return (n, chars, symbols, dup_lines, repeats, *map(float, ratios))


SCHEMA = ", ".join([*(f"{c} long" for c in BASE), *(f"{c} double" for c in RATIOS)])


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and the statistics of its text; one row per row."""
    kept = docs.select(*keep, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            got = [of_text(t) for t in rows.column(len(keep)).to_pylist()]
            cols = list(zip(*got)) or [()] * len(BASE + RATIOS)
            stats = [pa.array(c, pa.int64() if k < len(BASE) else pa.float64()) for k, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *stats], names=[*keep, *BASE, *RATIOS])

    return kept.mapInArrow(run, f"{kinds}, {SCHEMA}")
