"""Small column expressions: names, times, digests, ratios, slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftledger.functions.addresses import let

_STAMP = r"([0-9]{8}T[0-9]{6}Z)"
#: Source names that a file name or a log may use.
SOURCE_ALIASES = {"firehol": "FireHOL", "spamhaus": "Spamhaus DROP", "spamhaus drop": "Spamhaus DROP", "blocklist_de": "blocklist.de"}


def computed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a costly column that is computed once a row: a generator is not merged into the filters and columns that read it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def has_stamp(name: Column) -> Column:
    return name.rlike(_STAMP)


def retrieved_at(name: Column, modified: Column) -> Column:
    """UTC text time from the stamp in a file name, else from its modification time."""
    stamp = F.regexp_extract(name, _STAMP, 1)
    at = F.try_to_timestamp(F.when(stamp != "", stamp), F.lit("yyyyMMdd'T'HHmmssX"))
    return F.date_format(F.coalesce(at, modified), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snapshot_id(name: Column, retrieved: Column) -> Column:
    return F.when(has_stamp(name), stem(name)).otherwise(F.concat_ws("_", stem(name), F.translate(retrieved, ":-", "")))


def domain_of(value: Column) -> Column:
    """Host of a URL or bare host, in lower case and without a last dot; the value itself if there is none."""
    url = F.when(value.contains("://"), value).otherwise(F.concat(F.lit("http://"), value))
    return F.rtrim(F.lower(F.coalesce(F.nullif(F.try_parse_url(url, F.lit("HOST")), F.lit("")), value)), F.lit("."))


def first_filled(item: Column, names: tuple[str, ...]) -> Column:
    """The first non-empty of several keys of a JSON object in text, else ''.  Text without a key's letters, and without an escape that may stand for them, is not read for it."""
    found = (F.when(item.contains(n) | item.contains("\\"), F.get_json_object(item, f"$.{n}")) for n in names)
    return F.coalesce(F.get(F.filter(F.array(*found), lambda x: x != ""), F.lit(0)), F.lit(""))


def packed(*texts: Column) -> Column:
    """Texts as one that is equal for equal texts only: the lengths of all but the last one, then themselves."""
    return let(F.array(*texts), lambda t: F.concat(*(x for k in range(len(texts) - 1) for x in (F.length(t[k]).cast("string"), F.lit(","))), F.array_join(t, "")))


def unpacked(pack: Column, names: tuple[str, ...]) -> Column:
    """What `packed` was given, as fields of a struct."""
    last = len(names) - 1

    def fields(parts: Column) -> Column:
        ends = [F.lit(0)]
        for k in range(last):
            ends.append(ends[-1] + parts[k].cast("int"))
        lengths = [parts[k].cast("int") for k in range(last)] + [F.length(parts[last])]
        return F.struct(*(F.substring(parts[last], e + 1, n).alias(name) for e, n, name in zip(ends, lengths, names, strict=True)))

    return let(F.split(pack, ",", last + 1), fields)


def raw_day(at: Column) -> Column:
    """First ten characters of a time, 'unknown' if there are none."""
    return F.when(F.coalesce(at, F.lit("")) == "", "unknown").otherwise(F.substring(at, 1, 10))


def valid_day(at: Column) -> Column:
    """The ISO date that a time begins with, else null."""
    day = F.substring(at, 1, 10)
    return F.when(day.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day.try_cast("date"))


def zoned_time(at: Column) -> Column:
    """Timestamp of a text time that names its zone; null without one."""
    return F.when(at.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(at))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def percent_change(before: Column, after: Column) -> Column:
    """100 (after - before) / before to 4 places, half to even; null if before is 0."""
    return F.bround(100.0 * (after - before) / F.nullif(before, F.lit(0)), 4)


def jaccard(common: Column, union: Column) -> Column:
    """To 6 places, half to even; null for an empty union."""
    return F.bround(common / F.nullif(union, F.lit(0)), 6)


def safe_integer(value: Column) -> Column:
    return value.try_cast("bigint")


def portable_path(path: Column) -> Column:
    """The part of a path from data/raw/ on; null if there is none or it climbs with '..'."""
    part = F.regexp_extract(F.translate(path, "\\", "/"), r"(?:^|/)data/raw/(.+)$", 1)
    climbs = F.exists(F.split(part, "/"), lambda s: s == "..")
    return F.when((part != "") & ~climbs, F.concat(F.lit("data/raw/"), part))


def source_of_alias(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SOURCE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(name)), name)


def rendered(value: Column) -> Column:
    """Text for exports: NA where a number is unknown."""
    return F.coalesce(value.cast("string"), F.lit("NA"))
