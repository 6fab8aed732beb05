"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Texts become sets of word n-grams.  `rows` minima make a band; the number of
bands follows from the wanted recall at the threshold.  Band hashes are
shuffled; documents of a bucket are tied to its least member only, so a bucket
of any size gives as many rows as it has members.  The components of these ties
say which documents can be linked at all.  Inside a component documents are cut
by set size (sets of very different size cannot be similar) and then by a hash
into blocks of bounded size; each pair of blocks is one group, whose texts are
shuffled to it; there pairs that share a band are verified on their full sets.  A
group returns, per document, how many links it found and the least document it is
tied to, never the pairs.

Copies of a text are one node, so a third of all rows may be one text.  A node is
a text fingerprint; its number is the least id of the text's rows, or, where that
is null or taken by another text, a hash that no other node has.

Defined results: ids need not be unique.  `join` gives one row for each id and
text, and leaves out rows with a null id, as its SQL twin does; `one_of_each`
compares all rows.  A text of fewer than n words has its whole word sequence as its
only n-gram; null texts count as empty; texts without words have no n-grams and
are linked to nothing, but copies of each other; texts of any length are compared on
all their n-grams; an empty table gives no rows; `one_of_each` returns other columns
of any name unchanged, `join` does not read them.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftledger.llm.common import columns_of, unused, use_checkpoints
from driftledger.llm.components import connected
from driftledger.llm.wordhash import Words, blocks, mix

#: Documents, and n-grams, in a block at most, on average; a task holds two blocks.
BLOCK_DOCS, BLOCK_GRAMS = 1024, 1 << 20


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """Bands of `rows` minima so that a pair at the threshold shares one with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def gram_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The sorted set of 64-bit n-gram fingerprints of each text."""
    words = Words(texts)
    prints, first = words.windows(n)
    ptr = np.searchsorted(first, words.ptr)
    out = []
    for i, count in enumerate(words.counts()):
        if count >= n:
            out.append(np.unique(prints[ptr[i] : ptr[i + 1]]))
        elif count:
            h = np.uint64(count)
            for w in words.hash[words.ptr[i] : words.ptr[i + 1]]:
                h = mix(np.array([h ^ w], dtype=np.uint64))[0]
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _fingerprint(text: bytes | None) -> bytes:
    return hashlib.md5(text or b"", usedforsecurity=False).digest()


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(texts, bands) 64-bit band hashes; the number of the band is part of its hash."""
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    if full:
        x = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        ptr = np.cumsum([0] + [len(sets[i]) for i in full])[:-1]
        for band in range(bands):
            h = np.full(len(full), band + 1, dtype=np.uint64)
            for k in range(band * rows, band * rows + rows):
                h = mix(h ^ np.minimum.reduceat(x * a[k] + b[k], ptr).astype(np.uint64))
            out[full, band] = h
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, n_grams, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for i, t in blocks(ids, texts):
                sets = gram_sets(t, n)
                got = band_hashes(sets, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, bands), pa.int32()), pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i, pa.int64()), pa.array(map(_fingerprint, t), pa.binary()), pa.array([len(s) for s in sets], pa.int32()), lists], names=["doc_id", "key", "n_grams", "bands"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary, n_grams int, bands array<long>")


def _count_links(ids: np.ndarray, side: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], threshold: float, across: bool) -> Iterator[tuple[int, int, int]]:
    """(id, links, least id tied to) among the documents of one task."""
    share = np.zeros((len(ids), len(ids)), dtype=bool)
    for k in range(bands.shape[1]):
        share |= bands[:, None, k] == bands[None, :, k]
    i, j = np.nonzero(np.triu(share, 1))
    if across:
        i, j = i[side[i] != side[j]], j[side[i] != side[j]]
    size = np.array([len(s) for s in sets])
    if len(i) > 2 * len(ids):  # a dense task: count common n-grams by a matrix product over those in two sets or more
        grams, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        use = count[place] > 1
        owner, place = np.repeat(np.arange(len(ids)), size)[use], column[place[use]]
        common = np.zeros((len(ids), len(ids)), dtype=np.float32)
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        for lo in range(0, int((count > 1).sum()), 4096):
            a, b = np.searchsorted(place, (lo, lo + 4096))
            m = np.zeros((len(ids), 4096), dtype=np.float32)
            m[owner[a:b], place[a:b] - lo] = 1
            common += m @ m.T
        both = common[i, j].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
    i, j = i[ok], j[ok]
    links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    root = np.arange(len(ids))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    order = np.argsort(ids, kind="stable")
    rank = np.argsort(order, kind="stable")
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            low, high = (a, b) if rank[a] < rank[b] else (b, a)
            root[high] = low
    for v in np.flatnonzero(links):
        yield int(ids[v]), int(links[v]), int(ids[find(v)])


def _key() -> F.Column:
    """The fingerprint of a text, as `_fingerprint` gives it."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, rows: int = 6, recall: float = 0.99999) -> DataFrame:
    """One row per id and text: doc_id, class_id, copy_of, n_links, n_grams.

    copy_of is the least document with the same text; n_links is the number of
    other texts whose n-gram sets reach the threshold; class_id is the least
    document of the group that links and copies tie together.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    found = _classes(docs, n, threshold, rows, recall)
    return docs.select("doc_id", _key().alias("key")).distinct().join(found, "key").select("doc_id", "class_id", F.col("rep").alias("copy_of"), "n_links", "n_grams")


def _numbered(texts: DataFrame) -> DataFrame:
    """texts (key, rep, and others), one row each, with a doc_id that no two share, and odd: it is not the text's rep."""
    total = texts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rep").alias("reps")).first()
    if total["n"] == total["reps"]:
        return texts.withColumn("doc_id", F.col("rep")).withColumn("odd", F.lit(False))
    pairs = texts.select("key", "rep")
    taken = pairs.where("rep is not null").groupBy("rep").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("rep", "least")
    odd = pairs.join(taken, "rep", "left").where("rep is null or key <> least").select("key")
    for salt in itertools.count():
        number = odd.select("key", F.xxhash64("key", F.lit(salt)).alias("number")).checkpoint()
        same = number.agg((F.count(F.lit(1)) - F.count_distinct("number")).alias("n")).first()["n"]
        if not same and number.join(pairs, F.col("number") == F.col("rep"), "left_semi").isEmpty():
            return texts.join(number, "key", "left").withColumn("doc_id", F.coalesce("number", "rep")).withColumn("odd", F.col("number").isNotNull()).drop("number").checkpoint()


def _classes(docs: DataFrame, n: int, threshold: float, rows: int, recall: float) -> DataFrame:
    """(key, rep, class_id, kept, n_links, n_grams) of every text; kept: it has the least id (then fingerprint) of its class; null ids come last."""
    spark = docs.sparkSession
    use_checkpoints(spark)
    bands, rows_of_band = bands_for(threshold, rows, recall), rows
    every = _numbered(signatures(docs, n, bands, rows).groupBy("key").agg(F.min("doc_id").alias("rep"), F.min(F.struct("n_grams", "bands")).alias("s")).select("key", "rep", "s.*").checkpoint())
    node = every.where("n_grams > 0")

    spread = node.select("doc_id", F.explode("bands").alias("h"))
    # written, so that both sides of the join are plain shuffles, of which adaptive execution splits a hot bucket
    first = spread.groupBy("h").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c").checkpoint()
    ties = spread.join(first, "h").select(F.col("doc_id").alias("a"), "b").where("a <> b")
    part = connected(ties).checkpoint()

    # sets of classes further apart than one cannot reach the threshold (a margin keeps rounding harmless)
    width = -math.log(threshold * 0.98)
    sized = part.join(node, part.node == node.doc_id).select("doc_id", "root", "key", "rep", "n_grams", F.floor(F.log("n_grams") / width).cast("int").alias("s")).checkpoint()
    counts = sized.groupBy("root", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"))
    counts = counts.select("root", "s", "n", F.ceil(F.greatest(F.col("n") / BLOCK_DOCS, F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks")).checkpoint()
    around = (
        sized.join(counts, ["root", "s"])
        .join(counts.select("root", (F.col("s") - 1).alias("s"), F.col("blocks").alias("up")), ["root", "s"], "left")
        .join(counts.select("root", (F.col("s") + 1).alias("s"), F.col("blocks").alias("down")), ["root", "s"], "left")
        .withColumn("b", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    )

    def to(n_blocks: str, make) -> F.Column:
        return F.when(F.coalesce(F.col(n_blocks), F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.col(n_blocks) - 1), make)).otherwise(F.array().cast("array<struct<s0:int,s1:int,b0:int,b1:int,side:int>>"))

    def task(s0, s1, b0, b1, side) -> F.Column:
        return F.struct(s0.alias("s0"), s1.alias("s1"), b0.cast("int").alias("b0"), b1.cast("int").alias("b1"), F.lit(side).cast("int").alias("side") if isinstance(side, int) else side.cast("int").alias("side"))

    s, b = F.col("s"), F.col("b")
    own = to("blocks", lambda o: task(s, s, F.least(b, o), F.greatest(b, o), (b > o).cast("int")))
    own = F.when(F.col("n") > 1, own).otherwise(F.array().cast("array<struct<s0:int,s1:int,b0:int,b1:int,side:int>>"))
    tasks = F.concat(own, to("up", lambda o: task(s, s + 1, b, o, 0)), to("down", lambda o: task(s - 1, s, o, b, 1)))
    wanted = around.select("doc_id", "root", "key", "rep", tasks.alias("tasks")).where(F.size("tasks") > 0)

    keyed = docs.select(F.col("doc_id").alias("of"), "text", _key().alias("of_key"))
    # rows with a null id have nothing but the text to deal them by, so copies go before the shuffle
    one = keyed.where("of is not null").unionByName(keyed.where("of is null").dropDuplicates(["of_key"]))
    texts = one.join(wanted, F.col("of").eqNullSafe(F.col("rep")) & (F.col("of_key") == F.col("key")))

    key = ["root", "s0", "s1", "b0", "b1"]
    dealt = texts.select("doc_id", "root", "text", F.explode("tasks").alias("t")).select("root", "t.s0", "t.s1", "t.b0", "t.b1", "t.side", "doc_id", "text")
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(head: tuple, rows: dict[int, tuple[int, bytes]]) -> Iterator[tuple[int, int, int]]:
            if len(rows) > 1:
                ids = np.array(list(rows), dtype=np.int64)
                side, texts = zip(*rows.values(), strict=True)
                sets = [g for _, part in blocks(list(ids), list(texts)) for g in gram_sets(part, n)]
                yield from _count_links(ids, np.array(side), band_hashes(sets, bands, rows_of_band), sets, threshold, head[1::2] != head[2::2])

        now, rows = None, {}
        for batch in batches:
            heads = list(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True))
            out = []
            for head, side, doc, text in zip(heads, batch.column(5).to_pylist(), batch.column(6).to_pylist(), batch.column(7).cast(pa.binary()).to_pylist(), strict=True):
                if head != now:
                    if now:
                        out += done(now, rows)
                    now, rows = head, {}
                rows[doc] = (side, text)
            yield from _links(out)
        if now:
            yield from _links(list(done(now, rows)))

    def _links(out: list) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "links", "b"])

    found = dealt.mapInArrow(verify, "a long, links long, b long").checkpoint()
    total = found.groupBy(F.col("a").alias("doc_id")).agg(F.sum("links").alias("n_links"))
    roots = connected(found.select("a", "b")).select(F.col("node").alias("doc_id"), "root")
    all_texts = every.select("doc_id", "key", "rep", "n_grams", "odd")
    if all_texts.where("odd").isEmpty():
        roots = roots.select("doc_id", F.col("root").alias("class_id"), (F.col("doc_id") == F.col("root")).alias("kept"))
    else:  # numbers have no order then
        named = roots.join(all_texts, "doc_id")
        heads = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "key")).alias("h"))
        roots = named.join(heads, "root").select("doc_id", F.col("h.rep").alias("class_id"), (F.col("key") == F.col("h.key")).alias("kept"))
    return (
        all_texts.join(total, "doc_id", "left")
        .join(roots, "doc_id", "left")
        .select("key", "rep", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("kept", F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n_grams").cast("long").alias("n_grams"))
    )


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, rows: int = 6, recall: float = 0.99999) -> DataFrame:
    """One row of docs for each class of texts, that of the least id, null ids last; all columns stay.

    A row goes only if its text is a copy of, or linked to, that of a row that stays.
    Null and empty texts are texts like others: one row of each stays. An empty table stays empty.
    """
    key, held, rep = (unused(docs, c) for c in ("__key", "__kept", "__rep"))
    kept = _classes(docs, n, threshold, rows, recall).where("kept").select(F.col("key").alias(held), F.col("rep").alias(rep))
    keyed = docs.withColumn(key, _key())
    same = [keyed["doc_id"].eqNullSafe(kept[rep]), keyed[key] == kept[held]]
    return keyed.join(kept, same, "left_semi").dropDuplicates([key]).select(columns_of(docs))
