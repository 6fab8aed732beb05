"""Raw feed files to observations.

Files are read whole as bytes (a feed snapshot is small); each becomes lines or
items by native expressions, so files are parsed in parallel and a bad one
concerns only itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftledger.functions.addresses import is_parsed, let, parsed
from driftledger.functions.scalars import computed, domain_of, file_name, first_filled, packed, retrieved_at, snapshot_id, unpacked
from driftledger.schemas import OBSERVATION

#: Part of a file name, source name and format; the first that fits counts.
ROUTES = (("firehol", "FireHOL", "netset"), ("spamhaus", "Spamhaus DROP", "json"), ("blocklist", "blocklist.de", "list"), ("urlhaus", "URLhaus", "csv"))
#: Keys of a JSON item, the first filled one counts.
VALUE_KEYS = ("cidr", "ip", "ip_address", "range", "network")
REASON_KEYS = ("sblid", "reason", "rir", "as", "asn")
TIME_KEYS = ("timestamp", "last_seen", "first_seen", "date")
LIST_KEYS = ("blocklist", "data", "entries")


def _routed(name: Column, what: int) -> Column:
    def of(lower: Column) -> Column:
        out = F.lit(None).cast("string")
        for route in reversed(ROUTES):
            out = F.when(lower.contains(route[0]), route[what]).otherwise(out)
        return out

    return let(F.lower(name), of)


def scan(spark: SparkSession, raw: str) -> DataFrame:
    """Every file under a folder: source_path, name, format, source_name, times, digest and text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(raw)
    return described(files.select("path", "modificationTime", "content"))


def described(files: DataFrame) -> DataFrame:
    """(path, modificationTime, content) with what names and contents tell; bad bytes become the replacement character."""
    name = file_name(F.col("path"))
    at = retrieved_at(name, F.col("modificationTime"))
    more = ["error"] if "error" in files.columns else []
    return files.select(
        F.col("path").alias("source_path"), name.alias("name"), _routed(name, 2).alias("format"), _routed(name, 1).alias("source_name"), at.alias("retrieved_at_utc"), snapshot_id(name, at).alias("snapshot_id"),
        F.sha2("content", 256).alias("sha256"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), *more,
    )


_META = ("snapshot_id", "source_name", "retrieved_at_utc", "source_path", "sha256")


def _lines(files: DataFrame) -> DataFrame:
    return files.select(*_META, F.posexplode(F.split("text", "\r\n|\r|\n")).alias("at", "line"))


def _row(**filled: Column) -> list[Column]:
    base = {"country_class": F.lit("Unknown"), "status": F.lit("listed")} | filled
    return [(F.col(c) if c in _META else base.get(c, F.lit(""))).cast("string").alias(c) for c in OBSERVATION.names]


def network_lines(files: DataFrame) -> DataFrame:
    """Netsets and plain lists: one address or network a line, comments from '#', in netsets also lines from ';'."""
    content = F.trim(F.substring_index("line", "#", 1))
    rows = _lines(files.where(F.col("format").isin("netset", "list"))).withColumn("content", content)
    rows = rows.where((F.col("content") != "") & ~((F.col("source_name") == "FireHOL") & F.col("content").startswith(";")))
    rows = rows.where(is_parsed(F.col("content"))).withColumn("p", parsed(F.col("content")))
    return rows.select(*_row(indicator_type=F.col("p.kind"), indicator=F.col("p.text"), source_value=F.col("content"), notes=F.concat(F.lit("line "), F.col("at") + 1)))


def _json_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\r\n|\r|\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))


def is_refused(kind: Column, text: Column) -> Column:
    """Whether the parser of a format refuses a file: JSON that is neither one value nor a value a line."""
    one = lambda x: F.coalesce(F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1, F.lit(False))  # noqa: E731  (other readers stop after the first value)
    broken = ~one(text) & F.exists(_json_lines(text), lambda x: ~one(x))
    return F.coalesce((kind == "json") & broken, F.lit(False))


def _exploded(files: DataFrame, packs: Column, names: tuple[str, ...], distinct: bool) -> DataFrame:
    """A row with the fields of each pack of a file; of a file's equal packs one where they are to be distinct, told where the file is read, with no shuffle."""
    # packs are made before they part, so that no row carries its whole file; and once, since the explode's filter on them stays above
    made = computed(files, "rest", F.array_distinct(packs) if distinct else packs).select(*_META, "rest")
    rows = made.select(*_META, F.explode("rest").alias("pack"))
    return computed(rows, "fields", unpacked(F.col("pack"), names)).select(*_META, "fields.*")


def json_items(files: DataFrame, distinct: bool = False) -> DataFrame:
    """JSON feeds: an object with a list or object of items, a list, or an object a line.

    A file with a line that does not parse gives no rows at all; `parse_notes` names it.
    Items of a file that agree in what is read of them give one row if `distinct`.

    Two shapes that the plain reading of the format leaves without rows, a list
    at top level and a single line that is itself an item, give their items.
    """
    text = files.where((F.col("format") == "json") & ~is_refused(F.col("format"), F.col("text"))).withColumn("whole", F.trim("text"))
    items = F.lit(None).cast("array<string>")
    for key in reversed(LIST_KEYS):
        inner = F.get_json_object("whole", f"$.{key}")
        listed = F.from_json(inner, "array<string>")
        mapped = F.map_values(F.from_json(inner, "map<string,string>"))
        items = F.when(inner.startswith("[") & (F.size(listed) > 0), listed).when(inner.startswith("{") & (F.size(mapped) > 0), mapped).otherwise(items)
    single = F.try_parse_json("whole").isNotNull()
    lines = _json_lines(F.col("text"))
    items = F.when(single & F.col("whole").startswith("["), F.from_json("whole", "array<string>")).when(single & items.isNotNull(), items).otherwise(lines)
    value = lambda item: F.when(item.startswith("{"), first_filled(item, VALUE_KEYS)).otherwise(F.regexp_replace(item, '^"|"$', ""))
    packs = F.transform(items, lambda item: packed(value(item), first_filled(item, REASON_KEYS), first_filled(item, TIME_KEYS)))
    rows = _exploded(text, packs, ("value", "reason", "time"), distinct).where(is_parsed(F.col("value"))).withColumn("p", parsed(F.col("value")))
    return rows.select(*_row(indicator_type=F.col("p.kind"), indicator=F.col("p.text"), source_value=F.col("value"), reason=F.col("reason"), provider_timestamp=F.col("time")))


def url_rows(files: DataFrame, distinct: bool = False) -> DataFrame:
    """CSV feeds of URLs: the first line without '#' names the columns; the URL counts, else the host.  Lines of a file that agree in what is read of them give one row if `distinct`."""
    lines = F.filter(F.split("text", "\r\n|\r|\n"), lambda x: ~x.startswith("#") & (x != ""))
    kept = files.where("format = 'csv'").withColumn("lines", lines).where(F.size("lines") > 1)

    def cells(line: Column) -> Column:
        # a field is quoted, with doubled quotes inside, or runs to the next comma
        found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
        return F.transform(found, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))

    headed = kept.select(*_META, cells(F.element_at("lines", 1)).alias("names"), F.slice("lines", F.lit(2), F.size("lines") - 1).alias("below"))
    used = ("url", "host", "dateadded", "last_online", "threat", "url_status")
    placed = headed.select(*_META, "below", *(F.array_position("names", F.lit(n)).cast("int").alias(f"at_{n}") for n in used))

    def read(cell: Column) -> Column:
        texts = F.array(*(F.trim(F.coalesce(F.when(F.col(f"at_{n}") > 0, F.get(cell, F.col(f"at_{n}") - 1)), F.lit(""))) for n in used))
        return let(texts, lambda t: told(*(t[k] for k in range(len(used)))))

    def told(url: Column, host: Column, added: Column, online: Column, threat: Column, state: Column) -> Column:
        has_url = url != ""
        return packed(F.when(has_url, "url").otherwise("domain"), F.when(has_url, url).otherwise(host), threat, F.when(added != "", added).otherwise(online), state)

    packs = F.transform("below", lambda line: let(cells(line), read))
    rows = _exploded(placed, packs, ("kind", "value", "reason", "time", "state"), distinct).where("value <> ''")
    return rows.select(
        *_row(
            indicator_type=F.col("kind"), indicator=F.when(F.col("kind") == "url", F.col("value")).otherwise(domain_of(F.col("value"))), source_value=F.col("value"),
            reason=F.col("reason"), provider_timestamp=F.col("time"), notes=F.col("state"),
        )
    )


def observations(files: DataFrame, distinct: bool = False) -> DataFrame:
    """Rows of all parsers; of a file's equal rows one if `distinct` (lines of networks differ by their number)."""
    return network_lines(files).unionByName(json_items(files, distinct)).unionByName(url_rows(files, distinct))


def parse_notes(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, error) of files that gave no observation, also of those that could not be read (`error` of a feed folder)."""
    unread = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    empty = files.select("source_path", "format", unread.alias("unread"), is_refused(F.col("format"), F.col("text")).alias("refused")).join(rows.select("source_path").distinct(), "source_path", "left_anti")
    error = (
        F.when(F.col("unread").isNotNull(), F.col("unread")).when(F.col("format").isNull(), "no parser for this file name").when(F.col("refused"), "a line is not JSON").otherwise("no supported records parsed")
    )
    return empty.select(F.col("source_path").alias("path"), error.alias("error"))
