"""Substring dedup: long passages that an earlier document already holds.

Windows of k words are the edges of a de Bruijn graph over word sequences (the
nodes are the sequences of k - 1 words that two windows share).  The graph is
cut for the shuffle by minimisers, as in minimum substring partitioning: a
window goes to the bucket of its least m-word fingerprint, so that consecutive
windows mostly travel as one segment with its place in the text.

1. Documents are dealt into batches of a few MB.  A batch sends each different
   window once, from its first place (copies inside a batch cost nothing).
2. A bucket sorts its windows; an edge found in a smaller document gets that
   document's place as its source.  Consecutive edges whose sources are
   consecutive too are compacted, and go back to the batch they came from.
3. The batch joins the pieces end to start into maximal nonbranching paths: a
   path ends where the next edge's source is not the next place of the same
   source document.  Paths carry a second fingerprint of all their words.
4. Paths are joined with the batch of their source, which recomputes that
   fingerprint at the source coordinates; paths that do not agree are dropped.
5. The batch takes out the words that verified paths cover.

The texts are shuffled once; steps 1, 3, 4 and 5 read that one exchange.

Defined results: rows with a null doc_id are never matched and stay whole; null
texts count as empty; rows that repeat a doc_id never match each other; texts of
fewer than k words lose nothing; texts of any length are read whole, as one batch if
they are longer than one; an empty table gives no rows; `clean` returns other columns
of any name unchanged, the other functions do not read them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftledger.llm.wordhash import Words, mix

#: Bytes of text in a batch, about, and words to a bucket, about.
BATCH_BYTES, BUCKET_WORDS = 3 << 20, 1_000_000
#: Words of a minimiser.
MINIMISER = 6
_SENT = "bucket int, batch int, docs binary, begins binary, sizes binary, low binary, high binary"
_BACK = "batch int, docs binary, begins binary, sizes binary, sources binary, source_begins binary"
_PATH = "batch int, begins binary, size int, source long, source_begin long, print long"


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes first: like bytes stand together and compress."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplane(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


class Batch:
    """The rows of one batch in a fixed order, whatever order they arrive in; words are counted through the batch."""

    def __init__(self, table: pa.Table, k: int, seed: int = 1):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or b""))
        self.row, self.ids, self.texts = order, [ids[i] for i in order], [texts[i] for i in order]
        self.words = Words(self.texts, seed)
        self.owner = self.words.text_of_word()
        self.has_id = np.array([i is not None for i in self.ids], dtype=bool)
        self.doc = np.array([i or 0 for i in self.ids], dtype=np.int64)
        self.k = k

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, first word) of the windows of rows that have an id, in order."""
        prints, first = self.words.windows(self.k)
        ok = self.has_id[self.owner[first]] if len(first) else np.zeros(0, dtype=bool)
        return prints[ok], first[ok]

    def first_places(self, prints: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each window, which window of the batch has its words first (least document, then place)."""
        order = np.argsort(prints, kind="stable")  # places of a batch are in document order already
        new = np.ones(len(order), dtype=bool)
        new[1:] = prints[order[1:]] != prints[order[:-1]]
        out = np.empty(len(order), dtype=np.int64)
        out[order] = order[new][np.cumsum(new) - 1]
        return out


def _send(k: int, n_buckets: int) -> Callable:
    m = min(MINIMISER, k)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        batch = Batch(table, k)
        prints, first = batch.windows()
        small, small_first = batch.words.windows(m)
        parts: list[list] = [[] for _ in range(7)]
        if len(prints):
            of_word = np.zeros(len(batch.words.hash), dtype=np.uint64)
            of_word[small_first] = small
            least = of_word[first]
            for j in range(1, k - m + 1):
                least = np.minimum(least, of_word[first + j])
            bucket = (mix(least) % np.uint64(n_buckets)).astype(np.int64)
            mine = np.flatnonzero(batch.first_places(prints, first) == np.arange(len(prints)))
            order = mine[np.argsort(bucket[mine], kind="stable")]
            b, at, p = bucket[order], first[order], prints[order]
            doc = batch.doc[batch.owner[at]]
            starts = np.ones(len(at), dtype=bool)
            starts[1:] = (b[1:] != b[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
            seg = np.flatnonzero(starts)
            size = np.diff(np.append(seg, len(at)))
            long = np.flatnonzero(size > 60000)
            if len(long):  # sizes travel as 16 bits
                cut = np.concatenate([np.arange(seg[i], seg[i] + size[i], 60000) for i in long])
                seg = np.unique(np.concatenate([seg, cut]))
                size = np.diff(np.append(seg, len(at)))
            edges = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                s0, s1 = np.searchsorted(seg, (lo, hi))
                # a window's bucket is chosen by other bits than these 48
                row = (int(b[lo]), key[0].as_py(), _planes(doc[seg[s0:s1]]), _planes(at[seg[s0:s1]].astype(np.uint32)), _planes(size[s0:s1].astype(np.uint16)), _planes((p[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), _planes((p[lo:hi] >> np.uint64(32)).astype(np.uint16)))
                for col, v in zip(parts, row, strict=True):
                    col.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(parts, [pa.int32()] * 2 + [pa.binary()] * 5, strict=True)], names=_names(_SENT))

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for each segment."""
    ends = sizes.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def _match(key: tuple, table: pa.Table) -> pa.Table:
    """Sources of the windows of a bucket that a smaller document has."""
    got: list[list[np.ndarray]] = [[] for _ in range(4)]
    for r in table.to_pylist():
        size = _unplane(r["sizes"], np.uint16).astype(np.int64)
        got[0].append(_unplane(r["low"], np.uint32).astype(np.uint64) | _unplane(r["high"], np.uint16).astype(np.uint64) << np.uint64(32))
        got[1].append(np.repeat(_unplane(r["docs"], np.int64), size))
        got[2].append(_spread(_unplane(r["begins"], np.uint32).astype(np.int64), size))
        got[3].append(np.full(int(size.sum()), r["batch"], dtype=np.int64))
    prints, doc, at, batch = (np.concatenate(x) for x in got)
    order = np.argsort(prints, kind="stable")
    head = np.ones(len(order), dtype=bool)
    head[1:] = prints[order[1:]] != prints[order[:-1]]
    group = np.cumsum(head) - 1
    many = (np.bincount(group) > 1)[group]
    order, group = order[many], group[many]
    order = order[np.lexsort((at[order], doc[order], group))]
    head = np.ones(len(order), dtype=bool)
    head[1:] = group[1:] != group[:-1]
    source = order[head][np.cumsum(head) - 1] if len(order) else order
    take = doc[order] != doc[source]
    mine, source = order[take], source[take]
    by = np.lexsort((at[mine], doc[mine], batch[mine]))
    mine, source = mine[by], source[by]
    cols: list[list] = [[] for _ in range(6)]
    if len(mine):
        starts = np.ones(len(mine), dtype=bool)
        starts[1:] = ~((batch[mine[1:]] == batch[mine[:-1]]) & (doc[mine[1:]] == doc[mine[:-1]]) & (at[mine[1:]] == at[mine[:-1]] + 1) & (doc[source[1:]] == doc[source[:-1]]) & (at[source[1:]] == at[source[:-1]] + 1))
        seg = np.flatnonzero(starts)
        size = np.diff(np.append(seg, len(mine)))
        m, s = mine[seg], source[seg]
        edges = np.append(np.flatnonzero(np.append(True, batch[m[1:]] != batch[m[:-1]])), len(m))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            row = (int(batch[m[lo]]), _planes(doc[m[lo:hi]]), _planes(at[m[lo:hi]].astype(np.uint32)), _planes(size[lo:hi].astype(np.uint32)), _planes(doc[s[lo:hi]]), _planes(at[s[lo:hi]].astype(np.uint32)))
            for col, v in zip(cols, row, strict=True):
                col.append(v)
    return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int32()] + [pa.binary()] * 5, strict=True)], names=_names(_BACK))


def _span_prints(batch: Batch, begin: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A fingerprint of `words` words from `begin`, from another hash than the windows'; 0 where they leave the row."""
    h = batch.words.hash
    n = len(h)
    base = np.uint64(0xD6E8FEB86659FD93)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, dtype=np.uint64)]))
    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(base), -1, 1 << 64)), dtype=np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:n])]).astype(np.uint64)
    end = begin + words
    ok = (begin >= 0) & (end <= n)
    b, e = np.where(ok, begin, 0), np.where(ok, end, 1 if n else 0)
    if n:
        ok &= batch.owner[b] == batch.owner[np.maximum(e - 1, 0)]
    got = mix((sums[e] - sums[b]) * inverse[b] + words.astype(np.uint64))
    return np.where(ok, got, np.uint64(0)).astype(np.uint64)


def _paths(k: int, n_batches: int) -> Callable:
    """Join the pieces of a batch, and the matches inside it, into paths."""

    def run(key: tuple, texts: pa.Table, pieces: pa.Table) -> pa.Table:
        batch = Batch(texts, k)
        prints, first = batch.windows()
        source_doc = np.zeros(len(first), dtype=np.int64)
        source_at = np.full(len(first), -1, dtype=np.int64)
        doc = batch.doc[batch.owner[first]] if len(first) else source_doc
        for r in pieces.to_pylist():
            size = _unplane(r["sizes"], np.uint32).astype(np.int64)
            at = _spread(_unplane(r["begins"], np.uint32).astype(np.int64), size)
            w = np.searchsorted(first, at)
            source_doc[w] = np.repeat(_unplane(r["sources"], np.int64), size)
            source_at[w] = _spread(_unplane(r["source_begins"], np.uint32).astype(np.int64), size)
        if len(first):
            lead = batch.first_places(prints, first)
            has = source_at[lead] >= 0
            inside = ~has & (doc[lead] < doc)
            source_doc = np.where(has, source_doc[lead], np.where(inside, doc[lead], 0))
            source_at = np.where(has, source_at[lead], np.where(inside, first[lead], -1))
            del lead, has, inside
        del prints, doc
        on = np.flatnonzero(source_at >= 0)
        if not len(on):
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], names=_names(_PATH))
        starts = np.ones(len(on), dtype=bool)
        a, b = on[1:], on[:-1]
        starts[1:] = ~((first[a] == first[b] + 1) & (batch.owner[first[a]] == batch.owner[first[b]]) & (source_doc[a] == source_doc[b]) & (source_at[a] == source_at[b] + 1))
        seg = on[starts]
        words = np.diff(np.append(np.flatnonzero(starts), len(on))) + k - 1
        strong = _span_prints(Batch(texts, k, seed=2), first[seg], words)
        # places of the batch that name one source span share a row, so that a source many documents copy is asked for once per batch
        order = np.lexsort((first[seg], strong, words, source_at[seg], source_doc[seg]))
        seg, words, strong = seg[order], words[order], strong[order]
        span = np.stack([source_doc[seg], source_at[seg], words, strong.view(np.int64)])
        heads = np.flatnonzero(np.append(True, (span[:, 1:] != span[:, :-1]).any(axis=0)))
        begins = [b.tobytes() for b in np.split(first[seg].astype(np.int64), heads[1:])]
        return pa.table(
            [pa.array(np.full(len(heads), key[0].as_py(), dtype=np.int32)), pa.array(begins, pa.binary()), pa.array(words[heads].astype(np.int32)), *(pa.array(span[k, heads]) for k in (0, 1, 3))], names=_names(_PATH)
        )

    return run


def _verify(k: int) -> Callable:
    def run(key: tuple, texts: pa.Table, paths: pa.Table) -> pa.Table:
        if not paths.num_rows or not texts.num_rows:
            return paths.slice(0, 0)
        batch = Batch(texts, k, seed=2)
        begin, size = paths.column("source_begin").to_numpy(), paths.column("size").to_numpy().astype(np.int64)
        same = _span_prints(batch, begin, size) == paths.column("print").to_numpy().view(np.uint64)
        owner = batch.owner[np.clip(begin, 0, max(0, len(batch.owner) - 1))] if len(batch.owner) else np.zeros(len(begin), dtype=np.int64)
        same &= batch.doc[owner] == paths.column("source").to_numpy()
        return paths.filter(pa.array(same))

    return run


def _batched(docs: DataFrame, columns: tuple[str, ...] = ()) -> tuple[DataFrame, int, int]:
    """doc_id, text and the batch of each row; the numbers of batches and buckets, from the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(96, -(-size // (6 * BUCKET_WORDS)))
    n_batches = max(24, -(-size // min(64 << 20, max(BATCH_BYTES, 100 * n_buckets))))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int").alias("batch")
    rest = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)]
    return docs.select("doc_id", "text", *rest, batch), int(n_batches), int(n_buckets)


def _verified(texts: DataFrame, n_batches: int, n_buckets: int, k: int) -> DataFrame:
    sent = texts.groupBy("batch").applyInArrow(_send(k, n_buckets), _SENT)
    back = sent.groupBy("bucket").applyInArrow(_match, _BACK)
    paths = texts.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(_paths(k, n_batches), _PATH)
    aimed = paths.withColumn("source_batch", F.pmod(F.xxhash64("source"), F.lit(n_batches)).cast("int"))
    return texts.groupBy("batch").cogroup(aimed.groupBy("source_batch")).applyInArrow(lambda key, a, b: _verify(k)(key, a, b.select(_names(_PATH))), _PATH)


def remove(docs: DataFrame, k: int = 13, columns: tuple[str, ...] = (), as_it_was: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words left, joined by one space), one row for each row.

    columns: other columns of docs to carry along; they come back as _0, _1 and so
    on.  as_it_was: texts that lose nothing keep their white space.
    """
    texts, n_batches, n_buckets = _batched(docs, columns)
    verified = _verified(texts, n_batches, n_buckets, k)

    def run(key: tuple, rows: pa.Table, paths: pa.Table) -> pa.Table:
        batch = Batch(rows, k)
        words = batch.words
        gone = np.zeros(len(words.hash) + 1, dtype=np.int32)
        for begins, size in zip(paths.column("begins").to_pylist(), paths.column("size").to_pylist(), strict=True):
            begin = np.frombuffer(begins, dtype=np.int64)
            np.add.at(gone, begin, 1)
            np.add.at(gone, begin + size, -1)
        gone = gone[:-1].cumsum() > 0
        left, lost, count = [], [], words.counts()
        for i, (lo, hi) in enumerate(zip(words.ptr[:-1].tolist(), words.ptr[1:].tolist(), strict=True)):
            out = gone[lo:hi]
            lost.append(int(out.sum()))
            if lost[-1]:
                stay = np.flatnonzero(~out) + lo
                left.append(b" ".join([words.raw[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]))
            elif as_it_was:
                left.append(batch.texts[i])
            else:
                left.append(b" ".join((batch.texts[i] or b"").split()))  # bytes.split() parts words at the same bytes
        rest = [rows.column(f"_{i}").combine_chunks().take(pa.array(batch.row, pa.int64())) for i in range(len(columns))]
        names = ["doc_id", "n_words", "n_removed", "kept_text", *(f"_{i}" for i in range(len(columns)))]
        return pa.table([pa.array(batch.ids, pa.int64()), pa.array(count, pa.int64()), pa.array(lost, pa.int64()), pa.array(left, pa.binary()).cast(pa.string()), *rest], names=names)

    kinds = "".join(f", _{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    return texts.groupBy("batch").cogroup(verified.groupBy("batch")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string" + kinds)


def clean(docs: DataFrame, k: int = 13) -> DataFrame:
    """docs with repeated passages taken out of `text` (and n_chars, if there, counted anew); all columns and rows stay."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = remove(docs, k, rest, as_it_was=True)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")} | {c: F.col(f"_{i}") for i, c in enumerate(rest)}
    return out.select(*(made[c].alias(c) for c in docs.columns))


def repeated_paths(docs: DataFrame, k: int = 13) -> DataFrame:
    """Verified paths: batch-wise places of repeated passages and their source documents."""
    return _verified(*_batched(docs), k)


def digest(docs: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove(docs, k).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
