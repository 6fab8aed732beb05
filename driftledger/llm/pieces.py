"""SentencePiece encoding and decoding over a relational lattice.

The distinct parts of all texts become rows.  Every substring of a part, up to
the longest piece, is exploded and equi-joined to the piece table (a broadcast
of at most MAX_PIECES rows); the edges that are pieces are grouped by part, and
a higher-order aggregate folds over the lattice.  Two folds exist: Viterbi, for
unigram models (best sum of piece scores), and merge order, for BPE models, whose
right segmentation is not that of the best sum: each step of the aggregate takes
the best-scored edge that joins two neighbouring segments.

A part ends wherever no piece holds both neighbouring characters; no piece
crosses such a place, so parts encode on their own.  Texts are dealt into batches
once, compressed.  A batch finds its different parts in numpy and sends each of
them once, packed by bucket.  A bucket groups them by part, together with the
places (batch and number in the batch) that asked for it, builds the lattice, and
tells the ids to those places.  A batch then lays the ids of its parts end to end.
Nothing loops over the characters or words of texts.

The few parts of over MAX_WORD characters are encoded in the batch itself, by the
rule of the model: BPE parts are merged by an agenda, unigram parts go through
Viterbi.

Defined results: null and empty texts encode to no tokens (and decode to the
empty text); characters outside the vocabulary become byte pieces; rows that
repeat, and rows with a null doc_id, give one row each; texts of any length are
encoded whole (a task holds a batch, or the one text that is larger); an empty
table gives no rows; only the columns doc_id and text are read.  Models that
normalise texts (other than marking spaces) are refused.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftledger.llm.wordhash import run_prints

SPACE = "▁"
#: A part of a text has at most so many characters in the lattice (a bit mask holds its boundaries).
MAX_WORD = 48
#: The piece table is broadcast; larger tables are refused.
MAX_PIECES = 1 << 20
#: Bytes of text to a batch, about.
BATCH_BYTES = 8 << 20
#: Buckets grow with this power of the megabytes of text, as different parts grow slower than the text; a bucket's lattice fits in memory.
BUCKET_GROWTH = 0.75
#: Characters, or parts, that one numpy step handles at most.
STEP = 1 << 18
#: Rows that go back from a task at once.
ROWS = 500
#: Of rows that agree in all, so many of a task share a batch.
COPIES = 4


@dataclass
class Vocabulary:
    """Pieces with their ids and scores; kind: 'bpe' or 'unigram'."""

    kind: str
    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    special: set[int] = field(default_factory=set)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        byte = [i for i in range(n) if p.is_byte(i)]
        special = {i for i in range(n) if p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)}
        known = [p.id_to_piece(i) for i in range(n)]
        probe = p.encode("a b", out_type=str)
        if not probe or not probe[0].startswith(SPACE):
            raise ValueError("only models with a leading space mark are supported")
        text = "\ufb01\u2460  A\u030a x "  # compatibility forms, a combining mark, runs of spaces
        if p.normalize(text) != SPACE + text.replace(" ", SPACE):
            raise ValueError("only models that leave texts as they are, but for marking spaces, are supported")
        merges = p.encode(SPACE + "x") == p.encode(" x")
        kind = "bpe" if merges and min(p.get_score(i) for i in range(n)) <= -n + 2000 else "unigram"
        return cls(kind, known, [p.get_score(i) for i in range(n)], byte, special)

    def __post_init__(self) -> None:
        if len(self.pieces) > MAX_PIECES:
            raise ValueError(f"{len(self.pieces)} pieces; at most {MAX_PIECES} can be broadcast")
        if any(SPACE in p.lstrip(SPACE) for i, p in enumerate(self.pieces) if i not in self.special):
            raise ValueError("a piece crosses a space")

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if i not in self.special}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @cached_property
    def rank(self) -> dict[int, int]:
        """Place of each piece when the best score comes first; equal scores share one."""
        order = {s: k for k, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        return {i: order[self.scores[i]] for i in self.ids.values()}

    @cached_property
    def pairs(self) -> set[str]:
        """Neighbouring characters of some piece; elsewhere nothing can merge."""
        return {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}

    @cached_property
    def char_kinds(self) -> np.ndarray:
        """A small number for each code point, a space being a mark: 0 if no piece holds it together with another."""
        out = np.zeros(0x110000, dtype=np.uint16)
        for k, c in enumerate(sorted({c for p in self.pairs for c in p}), 1):
            out[ord(c)] = k
        out[ord(" ")] = out[ord(SPACE)]
        return out

    @cached_property
    def joined(self) -> np.ndarray:
        """For kinds a and b, at a * (number of kinds) + b: whether some piece holds them side by side."""
        kinds = self.char_kinds
        out = np.zeros((int(kinds.max()) + 1,) * 2, dtype=bool)
        for a, b in self.pairs:
            out[kinds[ord(a)], kinds[ord(b)]] = True
        return out

    @cached_property
    def byte_values(self) -> dict[int, int]:
        return {i: k for k, i in enumerate(self.byte_ids)}

    def bytes_of(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]

    def ids_of(self, word: str, fold: int | list[int]) -> list[int]:
        """Token ids of a word from its fold: the boundary mask of a BPE model, or the ids of a unigram model."""
        if isinstance(fold, int):
            at = [i for i in range(len(word) + 1) if fold >> i & 1]
            parts = [word[a:b] for a, b in zip(at, at[1:], strict=False)]
        else:
            parts = [i if i >= 0 else word[-i - 1] for i in fold]
        out: list[int] = []
        for p in parts:
            got = p if isinstance(p, int) else self.ids.get(p)
            out += self.bytes_of(p) if got is None else [got]
        return out

    def merge(self, word: str) -> list[int]:
        """Merge-order encoding of one word of any length with an agenda."""
        n = len(word)
        right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        agenda: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and end[j] - i <= self.longest and (got := self.ids.get(word[i : end[j]])) is not None:
                heapq.heappush(agenda, (self.rank[got], i, end[j]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, stop = heapq.heappop(agenda)
            j = right[i] if alive[i] else n
            if j >= n or end[j] != stop or end[i] != j:
                continue
            alive[j], end[i], right[i] = False, stop, right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        out: list[int] = []
        i = 0
        while i < n:
            got = self.ids.get(word[i : end[i]])
            out += self.bytes_of(word[i : end[i]]) if got is None else [got]
            i = end[i]
        return out

    def viterbi(self, word: str) -> list[int]:
        """Best-score encoding of one word of any length; it equals the fold of `segment`, ties too."""
        # the best ways to all places form a tree: place j follows parent[j] by token[j]; jump makes climbing logarithmic
        n, worst = len(word), min(self.scores) - 10.0
        score, parent, token, depth, jump = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)

        def up(v: int, d: int) -> int:
            while depth[v] > d:
                v = jump[v] if depth[jump[v]] >= d else parent[v]
            return v

        def is_greater(s: int, i: int, t: int, k: int) -> bool:
            """Whether the ids on the way to s, then i, come after those on the way to t, then k."""
            d = min(depth[s], depth[t])
            a, b = up(s, d), up(t, d)
            if a == b:
                return (i if depth[s] == d else token[up(s, d + 1)]) > (k if depth[t] == d else token[up(t, d + 1)])
            while parent[a] != parent[b]:
                a, b = (jump[a], jump[b]) if jump[a] != jump[b] else (parent[a], parent[b])
            return token[a] > token[b]

        for j in range(1, n + 1):
            s, i, best = j - 1, -j, score[j - 1] + worst
            for t in range(max(0, j - self.longest), j):
                k = self.ids.get(word[t:j])
                if k is not None and ((got := score[t] + self.scores[k]) > best or got == best and is_greater(t, k, s, i)):
                    s, i, best = t, k, got
            score[j], parent[j], token[j], depth[j] = best, s, i, depth[s] + 1
            jump[j] = jump[jump[s]] if depth[s] - depth[jump[s]] == depth[jump[s]] - depth[jump[jump[s]]] else s
        way = []
        while n:
            way.append(token[n])
            n = parent[n]
        return self.ids_of(word, way[::-1])

    def encode_part(self, word: str) -> list[int]:
        """Token ids of a part of any length."""
        return self.merge(word) if self.kind == "bpe" else self.viterbi(word)

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of token ids; first: they begin a text, whose leading mark is dropped."""
        value = self.byte_values
        out, held = [], bytearray()
        for i in ids:
            if i in value:
                held.append(value[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")[1 if first else 0 :]


def _piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """The pieces, and the empty one that the edge of length 0 of each word meets."""
    rows = [("", -1, 0, 0.0), *((p, i, vocabulary.rank[i], float(vocabulary.scores[i])) for p, i in vocabulary.ids.items())]
    return spark.createDataFrame(rows, "piece string, id int, rank int, score double")


#: Parts of a packed edge: rank, first character, length, id.  Its order is that of merges: best rank, then leftmost.
_EDGE = "(shiftleft(cast(rank AS bigint), 32) | shiftleft(cast(s AS bigint), 26) | shiftleft(cast(l AS bigint), 20) | cast(id AS bigint))"
_S, _L = "cast(shiftright({0}, 26) & 63 AS int)", "cast(shiftright({0}, 20) & 63 AS int)"
_INSIDE = f"shiftleft(shiftleft(1L, {_L} - 1) - 1L, {_S} + 1)"
_ENDS = f"(shiftleft(1L, {_S}) | shiftleft(1L, {_S} + {_L}))"


def _edges(words: DataFrame, table: DataFrame, shortest: int, longest: int, carry: list[str]) -> DataFrame:
    """(key columns, carried columns, s, l, id, rank, score): the substrings of each word, of at least `shortest` characters, that are pieces.

    Each word has an edge with s = -1 besides, the only one that holds the carried
    columns.  Explode and broadcast join keep the partitioning of the words, so
    grouping by word needs no further shuffle.
    """
    keys = [c for c in words.columns if c not in carry]
    size = F.char_length("word")
    starts = words.select(*keys, *carry, F.explode(F.sequence(F.lit(-1), F.greatest(size - shortest, F.lit(-1)))).alias("s"))
    lengths = F.when(F.col("s") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(shortest), F.least(F.lit(longest), size - F.col("s"))))
    spans = starts.select(*keys, *(F.when(F.col("s") < 0, F.col(c)).alias(c) for c in carry), "s", F.explode(lengths).alias("l"))
    return spans.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("l"))).join(F.broadcast(table), "piece").drop("piece")


def segment(words: DataFrame, vocabulary: Vocabulary, carry: tuple[str, ...] = ()) -> DataFrame:
    """words (word, and other key columns; carried columns are no keys) with their segmentation.

    For BPE: `mask`, whose bit i is set where a segment begins or the word ends.
    For unigram models: `ids`, where -(i + 1) stands for character i, which no piece
    covers.  Words have 1 to MAX_WORD characters.
    """
    keys = [c for c in words.columns if c not in carry]
    table = _piece_table(words.sparkSession, vocabulary)
    edges = _edges(words, table, 2 if vocabulary.kind == "bpe" else 1, max(2, vocabulary.longest), list(carry))
    carried = [F.first(c, ignorenulls=True).alias(c) for c in carry]
    if vocabulary.kind == "bpe":
        grouped = edges.groupBy(*keys).agg(F.sort_array(F.collect_list(F.expr(f"CASE WHEN s >= 0 THEN {_EDGE} END"))).alias("e"), *carried)
        grouped = grouped.withColumn("t", F.expr(f"transform(e, x -> struct({_ENDS.format('x')} AS ends, {_INSIDE.format('x')} AS inside))"))
        # state: the boundaries left, and the edges that they still allow, best first; a step joins the two segments under
        # the first edge that has one boundary inside, and drops the edges that lost an end or have nothing left inside
        best = "get(filter(s.t, y -> bit_count(s.m & y.inside) = 1), 0).inside"
        left = "filter(s.t, y -> (m & y.ends) = y.ends AND (m & y.inside) <> 0L)"
        step = f"coalesce(get(transform(filter(array(s.m & ~{best}), m -> m IS NOT NULL), m -> named_struct('m', m, 't', {left})), 0), named_struct('m', s.m, 't', slice(s.t, 1, 0)))"
        step = f"CASE WHEN size(s.t) = 0 THEN s ELSE {step} END"
        fold = f"aggregate(slice(sequence(0, char_length(word)), 1, char_length(word) - 1), named_struct('m', shiftleft(1L, char_length(word) + 1) - 1L, 't', t), (s, k) -> {step}).m"
        return grouped.select(*keys, *carry, F.expr(fold).alias("mask"))
    # Viterbi: best[j] is (score, ids) of the best way to the end of character j
    grouped = edges.groupBy(*keys).agg(F.collect_list(F.when(F.col("s") >= 0, F.struct("s", "l", "id", "score"))).alias("e"), *carried)
    worst = min(vocabulary.scores) - 10.0
    best = (
        "aggregate(sequence(1, char_length(word)), array(struct(0.0D AS score, cast(array() AS array<int>) AS ids)), (a, j) -> concat(a, array("
        "array_max(transform(filter(concat(e, array(struct(j - 1 AS s, 1 AS l, -j AS id, {worst}D AS score))), x -> x.s + x.l = j), x -> "
        "struct(get(a, x.s).score + x.score AS score, concat(get(a, x.s).ids, array(x.id)) AS ids))))))"
    ).replace("{worst}", repr(worst))
    return grouped.select(*keys, *carry, F.expr(f"element_at({best}, -1).ids").alias("ids"))


class Batch:
    """The texts of a batch, laid end to end as UTF-8 with a space before each, and their parts.

    ids, sizes: of each row, in bytes (size 0: no text); marked: the text has a mark
    of its own; raw: the bytes; start: of each part; part: the number of each part
    among the different parts, which are in the order of their bucket and
    fingerprint; first: a place of each different part; ptr: parts of text i are
    ptr[i] to ptr[i + 1].
    """

    def __init__(self, table: pa.Table, vocabulary: Vocabulary, n_buckets: int):
        expand = zstandard.ZstdDecompressor()
        self.ids = table.column("ids").combine_chunks().flatten()
        sizes = table.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.marked, self.sizes = sizes < 0, np.abs(sizes)
        at = np.append(0, np.cumsum(self.sizes))
        self.raw = np.empty(at[-1], dtype=np.uint8)
        lo = 0
        for packed in table.column("packed"):
            part = np.frombuffer(expand.decompress(packed.as_py()), dtype=np.uint8)
            self.raw[lo : lo + len(part)] = part
            lo += len(part)
        cut = np.zeros(len(self.raw), dtype=bool)
        kinds, joined = vocabulary.char_kinds, vocabulary.joined
        flat, n_kinds, last = joined.ravel(), np.int32(len(joined)), np.zeros(1, dtype=np.int32)
        lo = 0
        while lo < len(cut):
            hi = min(len(cut), lo + STEP)
            while hi < len(cut) and self.raw[hi] & 0xC0 == 0x80:
                hi += 1
            here = self.raw[lo:hi]
            kind = np.concatenate([last, kinds[np.frombuffer(here.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)].astype(np.int32)])
            cut[lo:hi][(here & 0xC0) != 0x80] = ~flat[kind[:-1] * n_kinds + kind[1:]]
            lo, last = hi, kind[-1:]
        cut[at[:-1][self.sizes > 0]] = True
        self.start = np.flatnonzero(cut).astype(np.int32 if len(cut) < 1 << 31 else np.int64)
        del cut
        self.ptr = np.searchsorted(self.start, at)
        coded = pa.array(run_prints(self.raw, self.start, STEP)).dictionary_encode()
        self.part, different = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy().copy()
        del coded
        self.bucket = (different % np.uint64(n_buckets)).astype(np.int32)
        order = np.lexsort((different, self.bucket))
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.bucket, self.first = self.bucket[order], np.empty(len(order), dtype=np.int64)
        for lo in reversed(range(0, len(self.part), STEP)):  # from the end, so that the first place is the last one written
            here = self.part[lo : lo + STEP] = rank[self.part[lo : lo + STEP]]
            self.first[here[::-1]] = np.arange(lo, lo + len(here))[::-1]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, size in bytes and size in characters of each different part."""
        begin = self.start[self.first].astype(np.int64)
        after = self.first + 1
        size = np.where(after < len(self.start), self.start[np.minimum(after, len(self.start) - 1)], len(self.raw)) - begin
        heads = (self.raw[_ranges(begin, size)] & 0xC0) != 0x80
        return begin, size, np.add.reduceat(heads, np.cumsum(size) - size, dtype=np.int64) if len(size) else size

    def words(self) -> pa.StringArray:
        """The different parts, with spaces for marks; those of over MAX_WORD characters are left empty."""
        begin, size, chars = self.spans()
        size = np.where(chars <= MAX_WORD, size, 0)
        ends = np.append(0, np.cumsum(size)).astype(np.int32)
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(self.raw[_ranges(begin, size)]))

    def long_words(self) -> Iterator[tuple[int, str]]:
        """(number, part) of the different parts of over MAX_WORD characters."""
        begin, size, chars = self.spans()
        for k in np.flatnonzero(chars > MAX_WORD).tolist():
            yield k, self.raw[begin[k] : begin[k] + size[k]].tobytes().decode("utf-8").replace(" ", SPACE)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ..., sizes[i] of them, for each i."""
    ends = np.cumsum(sizes)
    out = np.arange(ends[-1] if len(ends) else 0)
    out += np.repeat(starts - (ends - sizes), sizes)
    return out


_PACKED = "batch int, ids array<long>, sizes array<int>, packed binary"
_ASKED = "bucket int, batch int, base int, words array<string>"
_TOLD = "batch int, places binary, counts binary, flat binary, lost binary"
_CODED = "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean"


def _pack(n_batches: int):
    """Deal rows into batches by id and text; the texts of an Arrow batch that go to one batch are compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, met = zstandard.ZstdCompressor(level=5), Counter()
        for rows in batches:
            ids, texts, marked = rows.column(0).to_pylist(), [], []
            for t in rows.column(1).cast(pa.binary()):
                text = t.as_py().decode("utf-8", "replace") if t.is_valid else ""
                marked.append(SPACE in text)
                texts.append((" " + text.replace(SPACE, " ")).encode("utf-8") if text else b"")
            held: dict[int, list[int]] = {}
            for i, key in enumerate(rows.column(2).to_pylist()):
                held.setdefault((key + met[key] // COPIES * 0x9E3779B97F4A7C15 >> 3) % n_batches, []).append(i)
                met[key] += 1
            out = []
            for batch, mine in sorted(held.items()):
                sizes = [-len(texts[i]) if marked[i] else len(texts[i]) for i in mine]  # negative: with a mark of its own
                out.append((batch, [ids[i] for i in mine], sizes, squeeze.compress(b"".join(texts[i] for i in mine))))
            if out:
                kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["batch", "ids", "sizes", "packed"])

    return run


def _answer(shared, small: type):
    """Tell the ids of each word to the places that asked for it, packed by batch."""

    def told(ids: list[list[int]], lost: list[bool], asked: list[np.ndarray]) -> pa.RecordBatch:
        count, n_asked = np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(map(len, asked), np.int64, len(ids))
        flat, begin = np.fromiter((i for x in ids for i in x), small, int(count.sum())), np.cumsum(count) - count
        word, place = np.repeat(np.arange(len(ids)), n_asked), np.concatenate(asked)
        order = np.argsort(place)
        word, place = word[order], place[order]
        batch, bad = place >> 32, np.array(lost)
        at = np.append(np.flatnonzero(np.append(True, batch[1:] != batch[:-1])), len(batch))
        out = []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            w, p = word[lo:hi], (place[lo:hi] & 0xFFFFFFFF).astype(np.uint32)
            out.append((int(batch[lo]), p.tobytes(), count[w].astype(np.uint16).tobytes(), flat[_ranges(begin[w], count[w])].tobytes(), p[bad[w]].tobytes()))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["batch", "places", "counts", "flat", "lost"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        ids, lost, asked, n = [], [], [], 0
        for rows in batches:
            for w, fold, places in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
                got = v.ids_of(w, fold)
                ids.append(got)
                lost.append(v.decode(got, first=False) != w.replace(SPACE, " "))
                asked.append(places.values.to_numpy())
                n += len(asked[-1])
            if n >= STEP:
                yield told(ids, lost, asked)
                ids, lost, asked, n = [], [], [], 0
        if ids:
            yield told(ids, lost, asked)

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, token_ids and round_trip (decoding gives the text again), one row for each row of docs."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches, n_buckets = int(max(24, -(-size // BATCH_BYTES))), max(48, int((size / 1e6) ** BUCKET_GROWTH))
    shared = spark.sparkContext.broadcast(vocabulary)
    small = np.uint16 if len(vocabulary.pieces) <= 1 << 16 else np.uint32
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(_pack(n_batches), _PACKED).repartition("batch")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        mine = Batch(table, shared.value, n_buckets)
        begin = np.append(np.flatnonzero(np.append(True, mine.bucket[1:] != mine.bucket[:-1])) if len(mine.bucket) else [], len(mine.bucket)).astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(begin), mine.words())
        base = begin[:-1]
        pa.default_memory_pool().release_unused()
        return pa.table([pa.array(mine.bucket[base]), pa.array(np.full(len(base), key[0].as_py(), dtype=np.int32)), pa.array(base), words], names=["bucket", "batch", "base", "words"])

    asked = texts.groupBy("batch").applyInArrow(ask, _ASKED).repartition(n_buckets, "bucket").select("bucket", "batch", "base", F.posexplode("words").alias("at", "word")).where("word <> ''")
    asked = asked.withColumn("word", F.translate("word", " ", SPACE))
    place = F.shiftleft(F.col("batch").cast("long"), 32) + F.col("base") + F.col("at")
    distinct = asked.groupBy("bucket", "word").agg(F.collect_list(place).alias("asked"))
    known = segment(distinct, vocabulary, ("asked",))
    told = known.select("word", "mask" if vocabulary.kind == "bpe" else "ids", "asked").mapInArrow(_answer(shared, small), _TOLD)

    def finish(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        v = shared.value
        mine = Batch(table, v, n_buckets)
        count, lost = np.zeros(len(mine.first), dtype=np.int64), np.zeros(len(mine.first), dtype=bool)
        rows = [[np.frombuffer(b, dtype=t) for b, t in zip(r, (np.uint32, np.uint16, small, np.uint32), strict=True)] for r in zip(*(told.column(c).to_pylist() for c in ("places", "counts", "flat", "lost")), strict=True)]
        for places, counts, _, bad in rows:
            count[places], lost[bad] = counts, True
        own = {}
        for k, w in mine.long_words():
            own[k] = v.encode_part(w)
            count[k], lost[k] = len(own[k]), v.decode(own[k], first=False) != w.replace(SPACE, " ")
        if not count.all():
            raise RuntimeError("a part of a text was told no ids")
        begin = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), dtype=np.int32)
        for places, counts, got, _ in rows:
            flat[_ranges(begin[places], counts.astype(np.int64))] = got
        for k, got in own.items():
            flat[begin[k] : begin[k] + len(got)] = got
        del rows
        total = np.zeros(len(mine.part) + 1, dtype=np.int64)
        np.cumsum(count.astype(np.int32)[mine.part], out=total[1:])
        tokens = np.empty(total[-1], dtype=np.int32)
        for lo in range(0, len(mine.part), STEP):
            p = mine.part[lo : lo + STEP]
            tokens[total[lo] : total[lo + len(p)]] = flat[_ranges(begin[p], count[p])]
        bad = np.append(0, np.cumsum(lost[mine.part]))[mine.ptr]
        ends = total[mine.ptr].astype(np.int32)
        del total
        good = (np.diff(bad) == 0) & ~mine.marked
        pa.default_memory_pool().release_unused()
        out = pa.table([mine.ids, pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens)), pa.array(good)], names=["doc_id", "n_tokens", "token_ids", "round_trip"])
        return pa.Table.from_batches(out.to_batches(max_chunksize=ROWS), out.schema)  # the JVM holds so many rows of the reply at once

    return texts.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(finish, _CODED)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of rows with token_ids; a null list decodes to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([shared.value.decode(i or []) for i in rows.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
