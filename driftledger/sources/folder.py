"""A feed folder as a data source: one task a file, files of other feeds and days left out unread, faults as rows.

For folders that executors have mounted; `feeds.scan` reads any store that Spark
reads, but ends at the first file that cannot be read.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedFolder)
    spark.read.format("feed_folder").load(path).where("source_name = 'FireHOL'")

Its columns are those that `feeds.described` takes, so `feeds.observations` parses it.
Filters on source_name and day reach the listing of files; the setting
spark.sql.python.filterPushdown.enabled has to be on.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from driftledger.sources.feeds import ROUTES

_STAMP = re.compile(r"_(\d{4})(\d{2})(\d{2})T\d{6}Z")


@dataclass
class FeedFile(InputPartition):
    path: str
    source: str | None
    day: str | None


def _described(path: str) -> FeedFile:
    """What a file's name tells: the feed, by the first route that fits, and the day of its stamp."""
    name = os.path.basename(path)
    source = next((source for part, source, _ in ROUTES if part in name.lower()), None)
    stamp = _STAMP.search(name)
    return FeedFile(path, source, "-".join(stamp.groups()) if stamp else None)


class FeedFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_folder"

    def schema(self) -> str:
        return "path string, source_name string, day string, modificationTime timestamp, content binary, error string"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options["path"].removeprefix("file:"))


class FeedReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("source_name", "day"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[FeedFile]:
        found = (_described(os.path.join(at, name)) for at, _, names in os.walk(self.folder) for name in names)
        fits = lambda f: f.source in self.wanted.get("source_name", {f.source}) and f.day in self.wanted.get("day", {f.day})
        # a table without files still needs a part
        return sorted(filter(fits, found), key=lambda f: f.path) or [FeedFile("", None, None)]

    def read(self, file: FeedFile) -> Iterator[tuple]:
        if not file.path:
            return
        changed, content, error = None, None, None
        try:
            changed = datetime.fromtimestamp(os.stat(file.path).st_mtime, tz=timezone.utc)
            with open(file.path, "rb") as handle:
                content = handle.read()
        except OSError as fault:
            error = f"{type(fault).__name__}: {fault.strerror}"
        yield file.path, file.source, file.day, changed, content, error
