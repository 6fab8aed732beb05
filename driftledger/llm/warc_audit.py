"""WARC: Merkle fixity audit of replicas.

Pages are laid out as WARC records in files of a fixed range of page ids, so that
a lost record does not move its neighbours' places in the tree.  Records are
hashed where they are read; above them each node hashes its children's lengths
and hashes in order and covers their range of offsets.  Two replicas are compared
from the roots: only the children of nodes that differ are joined at the next
level, down to the records at fault.

Everything is native DataFrame work; no task sees more than the records of one
node.

Defined results: rows with a null page_id have no place in an archive and are
left out; a null url or html counts as empty; rows that repeat a page_id share a
leaf, which hashes all of them with their number; an empty table has no nodes;
bodies of any length are hashed whole; other columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from driftledger.llm.common import use_checkpoints

#: Page ids to a file, and children to a node.
FILE_RECORDS, FANOUT = 512, 8
LEVELS = 3  # FANOUT ** LEVELS == FILE_RECORDS


def record_text() -> F.Column:
    """The bytes of a record, as text, from the columns page_id, url and html."""
    body = F.coalesce("html", F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame) -> DataFrame:
    """(page_id, file_id, n_bytes, digest) of every page's record; the html goes no further than its digest."""
    made = pages.select("page_id", "url", "html").where("page_id is not null").select("page_id", record_text().alias("r"))
    return made.select("page_id", F.floor(F.col("page_id") / FILE_RECORDS).cast("long").alias("file_id"), F.octet_length("r").cast("long").alias("n_bytes"), F.sha2("r", 256).alias("digest"))


def leaves(found: DataFrame) -> DataFrame:
    """(file_id, slot, page_id, begin, n_bytes, digest): one leaf per page id, with its offset in the file."""
    one = found.groupBy("file_id", "page_id", "digest", "n_bytes").agg(F.count(F.lit(1)).alias("copies"))
    leaf = one.groupBy("file_id", "page_id").agg(
        F.sum(F.col("n_bytes") * F.col("copies")).cast("long").alias("n_bytes"),
        F.max("copies").alias("most"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "digest", "copies"))), ","), 256).alias("many"),
        F.min("digest").alias("single"),
        F.count(F.lit(1)).alias("kinds"),
    )
    order = Window.partitionBy("file_id").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.select(
        "file_id", F.pmod("page_id", F.lit(FILE_RECORDS)).cast("int").alias("slot"), "page_id", F.coalesce(F.sum("n_bytes").over(order), F.lit(0)).alias("begin"), "n_bytes",
        F.when((F.col("kinds") == 1) & (F.col("most") == 1), F.col("single")).otherwise(F.col("many")).alias("digest"),
    )


def parents(nodes: DataFrame) -> DataFrame:
    """The nodes one level up: (file_id, slot, begin, n_bytes, digest)."""
    child = F.struct("slot", "n_bytes", "digest")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c.slot, c.n_bytes, c.digest)), ",")
    return nodes.groupBy("file_id", F.floor(F.col("slot") / FANOUT).cast("int").alias("up")).agg(F.min("begin").alias("begin"), F.sum("n_bytes").alias("n_bytes"), F.sha2(text, 256).alias("digest")).withColumnRenamed("up", "slot")


def tree(found: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the roots of the files.  The leaves are written, so that no level reads the pages again."""
    use_checkpoints(found.sparkSession)
    levels = [leaves(found).checkpoint()]
    for _ in range(LEVELS):
        levels.append(parents(levels[-1]))
    return levels


def _differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    a = ours.select("file_id", "slot", F.col("digest").alias("digest_a"))
    b = theirs.select("file_id", "slot", F.col("digest").alias("digest_b"))
    return a.join(b, ["file_id", "slot"], "full_outer").where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).select("file_id", "slot")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """One row per record at fault: file_id, page_id, status (changed, missing, extra), its offsets and digests in both.

    Both arguments are tables of records (see `records`).
    """
    a, b = tree(primary), tree(replica)
    bad = _differing(a[LEVELS], b[LEVELS]).checkpoint()
    for level in range(LEVELS - 1, -1, -1):
        # only children of differing nodes are looked at
        below = bad.select("file_id", F.col("slot").alias("up"))

        def under(nodes: DataFrame, below: DataFrame = below) -> DataFrame:
            return nodes.withColumn("up", F.floor(F.col("slot") / FANOUT).cast("int")).join(below, ["file_id", "up"], "left_semi").drop("up")

        ours, theirs = under(a[level]), under(b[level])
        if level:
            bad = _differing(ours, theirs).checkpoint()
    left = ours.select("file_id", "page_id", F.col("begin").alias("begin_a"), F.col("n_bytes").alias("n_bytes_a"), F.col("digest").alias("digest_a"))
    right = theirs.select("file_id", "page_id", F.col("begin").alias("begin_b"), F.col("n_bytes").alias("n_bytes_b"), F.col("digest").alias("digest_b"))
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    return left.join(right, ["file_id", "page_id"], "full_outer").where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).withColumn("status", status)


def roots(found: DataFrame) -> DataFrame:
    """(file_id, n_bytes, digest) of each file: what a replica needs to send first."""
    return tree(found)[LEVELS].select("file_id", "n_bytes", "digest")


def parse(content: bytes) -> Iterator[tuple[int, int, str, str, bytes]]:
    """(offset, length, type, target URI, body) of the records of one uncompressed WARC file."""
    at = 0
    while (head := content.find(b"\r\n\r\n", at)) >= 0:
        fields = dict(line.split(b":", 1) for line in content[at:head].split(b"\r\n")[1:] if b":" in line)
        fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
        size = int(fields.get(b"content-length", b"0"))
        end = head + 4 + size + 4
        yield at, end - at, fields.get(b"warc-type", b"").decode(), fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), content[head + 4 : head + 4 + size]
        at = end


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, begin, n_bytes, type, url, html) of the records of uncompressed WARC files; one task per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, content in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                got = [(name, *r[:4], r[4].decode("utf-8", "replace")) for r in parse(content)]
                if got:
                    yield pa.RecordBatch.from_pydict(dict(zip(["path", "begin", "n_bytes", "type", "url", "html"], map(list, zip(*got, strict=True)), strict=True)))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, begin long, n_bytes long, type string, url string, html string")
