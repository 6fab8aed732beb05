"""Line dedup: lines that many documents hold go from all of them.

1. Each document sends every different key of its lines once: a 128-bit hash, its
   own identity and the places of the key's lines.
2. The hashes are dealt by range, ordered by hash, document and first place, so a
   hash that a third of all documents hold fills as many ranges as it needs.  One
   pass over a range sees the documents of a hash one after the other.  It keeps
   the first `least - 1` of them back; from the next one on the key is common, and
   all its places are given out as they come.
3. A hash at the edge of a range may go on in the next one.  A range says of its
   first and last hash how many documents it saw, at most `least`; these few rows,
   at most 2 * least a range, are added up and settle what was kept back.
4. The places of a document become one compressed bitmap of the lines to keep.
   Texts meet only these.

Defined results: null and empty texts are one empty line; a document is a
different pair of doc_id and text, so repeated rows count once and each lose the
same lines, while rows that share an id (or have none) but not the text count
each; empty keys are never common; texts and lines of any length are read whole;
an empty table gives no rows; other columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftledger.checkpoints import written

#: White space that a key loses at both ends.
_STRIP = b" \t\n\x0b\x0c\r"
_HASHED = "h long, g long, no_id boolean, id long, text_id long, first int, lines array<int>"
#: What a row of the pass says: these lines go, these lines wait for the sum, this hash has so many documents more.
GOES, WAITS, COUNTS = 0, 1, 2
_FOUND = "state int, h long, g long, no_id boolean, id long, text_id long, lines array<int>, documents int"


def _identity() -> list[Column]:
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("text_id")]


def keys_of(text: str | bytes | None) -> list[bytes]:
    """The key of each line."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return [line.strip(_STRIP).lower() for line in raw.split(b"\n")]  # lower() of bytes changes A-Z only


def hashed_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """A row for each row of docs and each different key of at least min_chars code points in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            owner, digests, first, places, ends = [], [], [], [], [0]
            for i, text in enumerate(rows.column(3).cast(pa.binary()).to_pylist()):
                at: dict[bytes, list[int]] = {}
                for place, key in enumerate(keys_of(text)):
                    if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        at.setdefault(key, []).append(place)
                for key, lines in at.items():
                    owner.append(i)
                    digests.append(hashlib.blake2b(key, digest_size=16).digest())
                    first.append(lines[0])
                    places += lines
                    ends.append(len(places))
            hashes = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            mine = pa.array(owner, pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
            cols = [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), *(rows.column(k).take(mine) for k in range(3)), pa.array(first, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "g", "no_id", "id", "text_id", "first", "lines"])

    return docs.select(*_identity(), "text").mapInArrow(run, _HASHED)


def _pass(least: int):
    """One pass over a range, in order of hash and document."""

    def given(rows: pa.Table, state: int, documents: int = 0) -> pa.RecordBatch:
        n = rows.num_rows
        filled = {"state": pa.array(np.full(n, state, dtype=np.int32)), "documents": pa.array(np.full(n, documents, dtype=np.int32))}
        names = ["state", "h", "g", "no_id", "id", "text_id", "lines", "documents"]
        return pa.table([filled[c] if c in filled else rows.column(c) for c in names], names=names).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the different documents of the last hash seen, `least` at most
        at_edge = True  # whether that hash is the first one of the range
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            known = 0 if held is None else held.num_rows
            cols = [rows.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g", "no_id", "id", "text_id")]
            differs = lambda names: np.append(True, np.any([c[1:] != c[:-1] for c in names], axis=0))
            new = np.flatnonzero(differs(cols))  # a row that repeats its document says nothing more
            hash_at = np.flatnonzero(differs(cols[:2])[new])
            size = np.diff(np.append(hash_at, len(new)))
            common = np.repeat(size >= least, size)
            gone = known if known >= least else 0  # these were given out already
            goes = new[common & (new >= gone)]
            if len(goes):
                yield given(rows.take(pa.array(goes)), GOES)
            if at_edge and len(hash_at) > 1:  # the range's first hash ends here
                yield from edge(rows, new[: size[0]])
            at_edge = at_edge and len(hash_at) == 1
            held = rows.take(pa.array(new[hash_at[-1] :][:least]))
        if held is not None:
            yield from edge(held, np.arange(held.num_rows))

    def edge(rows: pa.Table, which: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield given(rows.take(pa.array(which[:1])), COUNTS, min(least, len(which)))
        if len(which) < least:
            yield given(rows.take(pa.array(which)), WAITS)

    return run


def common_lines(docs: DataFrame, least: int = 10, min_chars: int = 1) -> DataFrame:
    """(no_id, id, text_id, lines): places of lines whose key at least `least` documents hold, once for each document and key."""
    order = ["h", "g", "no_id", "id", "text_id", "first"]
    ranges = hashed_lines(docs, min_chars).repartitionByRange(*order[:5]).sortWithinPartitions(*order)
    found = written(ranges.mapInArrow(_pass(least), _FOUND))
    settled = found.where(F.col("state") == COUNTS).groupBy("h", "g").agg(F.sum("documents").alias("n")).where(F.col("n") >= least).select("h", "g")
    late = found.where(F.col("state") == WAITS).join(F.broadcast(settled), ["h", "g"], "left_semi")
    return found.where(F.col("state") == GOES).unionByName(late).select("no_id", "id", "text_id", "lines")


def bitmaps(docs: DataFrame, least: int = 10, min_chars: int = 1) -> DataFrame:
    """(no_id, id, text_id, n_dropped, keep): of each document that loses lines, a zlib-compressed bitmap of the lines to keep.

    Bit 7 of the first byte is line 0; lines after the last bit stay.  id is the
    doc_id, text_id the xxhash64 of the text.
    """
    places = common_lines(docs, least, min_chars).groupBy("no_id", "id", "text_id").agg(F.flatten(F.collect_list("lines")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keeps, lost = [], []
            for lines in rows.column(3):
                at = np.unique(lines.values.to_numpy(zero_copy_only=False))
                keep = np.ones((int(at[-1]) // 8 + 1) * 8, dtype=bool)
                keep[at] = False
                keeps.append(zlib.compress(np.packbits(keep).tobytes()))
                lost.append(len(at))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(lost, pa.int64()), pa.array(keeps, pa.binary())], names=["no_id", "id", "text_id", "n_dropped", "keep"])

    return places.mapInArrow(run, "no_id boolean, id long, text_id long, n_dropped long, keep binary")


def kept_text(text: bytes | None, keep: bytes | None) -> bytes:
    """The lines that a bitmap keeps, joined by newlines."""
    if keep is None:
        return text or b""
    lines = (text or b"").split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8))[: len(lines)].tolist()
    return b"\n".join([line for line, bit in zip(lines, bits, strict=False) if bit] + lines[len(bits) :])


def remove(docs: DataFrame, least: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text, one row for each row."""
    rows = docs.select("doc_id", "text", *_identity()).join(bitmaps(docs, least, min_chars), ["no_id", "id", "text_id"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part.column(1).cast(pa.binary()).to_pylist()
            kept = [kept_text(t, k) for t, k in zip(texts, part.column(3).to_pylist(), strict=True)]
            lines = pa.array([(t or b"").count(b"\n") + 1 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), lines, part.column(2), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    return rows.select("doc_id", "text", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "keep").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_text string")


def digest(docs: DataFrame, least: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return remove(docs, least, min_chars).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
