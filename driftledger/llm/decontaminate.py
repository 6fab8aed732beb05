"""Benchmark decontamination: pigeonhole edit matching.

Texts are compared letter by letter in a normal form (lower case, runs of other
characters than letters and digits as one space).  An item of L characters may
differ from a passage in e = L * error_rate edits.  It is cut into e + 1 pieces:
a passage within e edits must hold one of them unchanged.  An automaton finds all
pieces in one walk over each whole text; each hit names a diagonal where the item
would stand, and diagonals that meet become one span.  There the pigeonhole is
asked again with twice as many pieces, of which at most e may be missing; so items
that share an opening are told apart without a distance.  Myers' bit-parallel
distance goes over what is left, once a span, so that a text that repeats a piece
takes time linear in its length.

Items are taken in blocks of at most BLOCK_CHARS characters, each a broadcast of
that bound; every block meets all rows.  The benchmark may so grow without limit.

Defined results: null and empty texts match nothing; items of fewer than MIN_CHARS
characters in the normal form are found word for word only, with an error budget
of 0 and word borders at both ends; items without letters and digits match
nothing; texts of any length are searched whole; repeated rows give one row each;
rows with a null id keep it; `clean` judges each row by its own text, whatever
its id, and keeps columns of any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of items that one broadcast holds at most.
BLOCK_CHARS = 4_000_000
#: Items of fewer characters have no error budget and must stand between word borders.
MIN_CHARS = 24
#: Edits allowed per character of an item.
ERROR_RATE = 0.06

class _Plain(dict):
    """Letters and digits as they are, all else as a space; filled in as characters are met."""

    def __missing__(self, code: int) -> str:
        self[code] = got = chr(code) if chr(code).isalnum() else " "
        return got


_PLAIN = _Plain()


def normal(text: str | None) -> str:
    return " ".join(text.lower().translate(_PLAIN).split()) if text else ""


def budget(length: int, error_rate: float) -> int:
    return int(length * error_rate) if length >= MIN_CHARS else 0


def pieces(item: str, n: int) -> list[tuple[int, str]]:
    """(offset, piece): n parts of nearly equal length that make up the item."""
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(pattern: str, text: str, most: int, enough: int = 0) -> tuple[int, int] | None:
    """(distance, end) of the substring of text nearest to pattern, if within `most` edits; the first of equal ones.

    Myers' algorithm: a column of the edit matrix is two bit vectors of vertical
    steps.  The search ends at the first substring within `enough` edits.
    """
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    best: tuple[int, int] | None = None
    for end, c in enumerate(text, 1):
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up = down | ~(diagonal | up) & full
        right_down = up & diagonal
        score += 1 if right_up & top else -1 if right_down & top else 0
        right_up = right_up << 1 & full  # a match may begin anywhere: the top row stays 0
        right_down = right_down << 1 & full
        up = right_down | ~(eq | down | right_up) & full
        down = right_up & (eq | down)
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
            if score <= enough:
                break
    return best


class Matcher:
    """An automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float = ERROR_RATE):
        import ahocorasick

        self.items, self.budget = items, [budget(len(t), error_rate) for _, t in items]
        self.fine: dict[int, list[str]] = {}
        self.find = ahocorasick.Automaton()
        at: dict[str, dict[int, tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for offset, piece in pieces(text, self.budget[k] + 1):
                uses = at.setdefault(piece, {})
                uses[k] = (uses[k][0], offset) if k in uses else (offset, offset)
        #: of each different piece: its size, the item length up to which its places make one span, and (item, first and last offset)
        self.uses = [(len(piece), min(len(items[k][1]) for k in uses), [(k, *o) for k, o in uses.items()]) for piece, uses in at.items()]
        for number, piece in enumerate(at):
            self.find.add_word(piece, number)
        self.any = bool(at)
        if self.any:
            self.find.make_automaton()

    def _spans(self, text: str) -> dict[int, list[list[int]]]:
        """For each item with a piece in the text, the stretches where it may stand, apart and in order.

        Places of a piece that lie closer than an item is long are taken together
        first, so a text that repeats a piece costs one step a place and not one for
        each place, item and offset.
        """
        places: dict[int, list[list[int]]] = {}
        uses = self.uses
        for last, number in self.find.iter(text):
            got = places.get(number)
            if got is None:
                places[number] = [[last, last]]
            elif last - got[-1][1] <= uses[number][1]:
                got[-1][1] = last
            else:
                got.append([last, last])
        found: dict[int, list[list[int]]] = {}
        for number, stretches in places.items():
            size, _, mine = uses[number]
            for k, low, high in mine:
                most, length = self.budget[k], len(self.items[k][1])
                found.setdefault(k, []).extend([max(0, a - size + 1 - high - most), min(len(text), b - size + 1 - low + length + most)] for a, b in stretches)
        for k, spans in found.items():
            spans.sort()
            out = spans[:1]
            for lo, hi in spans[1:]:
                if lo <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], hi)
                else:
                    out.append([lo, hi])
            found[k] = out
        return found

    def _may_stand(self, k: int, text: str, lo: int, hi: int) -> bool:
        """Whether at most e of 2e + 2 pieces of item k are missing between lo and hi."""
        most = self.budget[k]
        fine = self.fine.get(k)
        if fine is None:
            fine = self.fine[k] = [piece for _, piece in pieces(self.items[k][1], min(2 * most + 2, len(self.items[k][1])))]
        missing = 0
        for piece in fine:
            if text.find(piece, lo, hi) < 0:
                missing += 1
                if missing > most:
                    return False
        return True

    def _nearest(self, k: int, text: str, spans: list[list[int]], enough: int) -> tuple[int, int] | None:
        """(distance, end) of the passage of a text nearest to item k, the first of equal ones; any passage within `enough` will do."""
        item, most = self.items[k][1], self.budget[k]
        if len(item) < MIN_CHARS:
            at = f" {text} ".find(f" {item} ")
            return None if at < 0 else (0, at + len(item))
        for lo, hi in spans:
            at = text.find(item, lo, hi)
            if at >= 0:
                return 0, at + len(item)
        best = None
        for lo, hi in spans:
            if most and self._may_stand(k, text, lo, hi):
                got = best_match(item, text[lo:hi], most, max(1, enough))
                if got:
                    best, most = (got[0], lo + got[1]), got[0] - 1
                    if best[0] <= enough:
                        break
        return best

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item's place, distance, end in the text) for each item found, its nearest passage."""
        if not self.any or not text:
            return []
        got = ((k, self._nearest(k, text, spans, 0)) for k, spans in self._spans(text).items())
        return sorted((k, *near) for k, near in got if near)

    def any_in(self, text: str) -> bool:
        """Whether an item stands in the text within its budget; the first passage found decides."""
        return self.any and bool(text) and any(self._nearest(k, text, spans, self.budget[k]) for k, spans in self._spans(text).items())


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in normal form, block by block; a block is what the driver holds at once."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total * 2 // block_chars))
    for block in range(n_blocks):
        mine = benchmark.select("item_id", "text").where("text is not null")
        if n_blocks > 1:
            mine = mine.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n_blocks)) == block)
        yield sorted({(r.item_id, t) for r in mine.toLocalIterator() if (t := normal(r.text))}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, begin, end): for each row and each item found in it, the nearest passage.

    Places count characters of the normal form; begin is end less the item's length.
    """
    out = None
    for items in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate)
            for rows in batches:
                found = []
                for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    for k, d, e in matcher.matches(normal(text)):
                        item, form = shared.value[k]
                        found.append((doc, item, d, e - len(form), e))
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "distance", "begin", "end"])

        got = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance int, begin long, end long")
        out = got if out is None else out.unionByName(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs whose text holds no item; all columns stay, and nothing is shuffled.

    Null and empty texts hold none; ids do not matter, so null and repeated ones
    are like any; very long texts are read whole; an empty table stays empty, and
    an empty benchmark keeps all rows.
    """
    # names by place inside, as mapInArrow takes no name with a dot
    names = docs.columns
    text = names.index("text")
    docs = docs.toDF(*(f"_{i}" for i in range(len(names))))
    for items in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, text: int = text) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate)
            for rows in batches:
                yield rows.filter(pa.array([not matcher.any_in(normal(t)) for t in rows.column(text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)
