"""A running log of what came and went, from snapshots that may come late, twice or in the same second."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_KEYS = T.ArrayType(T.StructType([T.StructField("indicator_type", T.StringType()), T.StructField("indicator", T.StringType())]))
_OUT = T.StructType([T.StructField("source", T.StringType()), T.StructField("at_us", T.LongType()), T.StructField("indicator_type", T.StringType()), T.StructField("indicator", T.StringType()), T.StructField("change", T.StringType())])
#: What the state of a streaming query needs; set it on the session before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Changes(StatefulProcessor):
    """State of one part of a feed's keys.

    waiting: by snapshot time in microseconds, the keys of snapshots that the
    watermark has not passed; last: the keys of the last one that it has.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        at = T.StructType([T.StructField("at", T.LongType())])
        keys = T.StructType([T.StructField("keys", _KEYS)])
        self.waiting = handle.getMapState("waiting", at, keys)
        self.last = handle.getValueState("last", T.StructType([T.StructField("at", T.LongType()), T.StructField("keys", _KEYS)]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = self.last.get()[0] if self.last.exists() else None
        for part in rows:
            for at, listed in part.groupby("at_us"):
                at = int(at)
                if passed is not None and at <= passed:
                    continue  # beyond the watermark's patience
                have = {tuple(k) for k in self.waiting.getValue((at,))[0]} if self.waiting.containsKey((at,)) else set()
                named = listed[listed["indicator"].notna()]
                have |= set(zip(named["indicator_type"], named["indicator"], strict=True))
                self.waiting.updateValue((at,), (sorted(have),))
                self.handle.registerTimer(-(-at // 1000))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        out = []
        for at in sorted(k[0] for k in self.waiting.keys() if k[0] <= upto):
            now = {tuple(k) for k in self.waiting.getValue((at,))[0]}
            if self.last.exists():
                before = {tuple(k) for k in self.last.get()[1]}
                out += [(at, *k, "added") for k in sorted(now - before)] + [(at, *k, "removed") for k in sorted(before - now)]
            self.last.update((at, sorted(now)))
            self.waiting.removeKey((at,))
        if out:
            found = pd.DataFrame(out, columns=["at_us", "indicator_type", "indicator", "change"])
            found.insert(0, "source", key[0])
            yield found

    def close(self) -> None:
        pass


def _bucket(kind: Column, value: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(kind, value), F.lit(parts)).cast("int")


def changes(stream: DataFrame, parts: int = 16, patience: str = "1 day") -> DataFrame:
    """(source, at, indicator_type, indicator, change) from a stream of snapshot parts (source, at, keys).

    keys: array of struct(indicator_type, indicator).  A snapshot may come in
    several rows, in any order, and more than once; rows of one time are one
    snapshot, so two snapshots of a second are told apart by microseconds.  A
    snapshot counts when the watermark, the greatest time seen less `patience`, has
    passed it; one that comes later is left out.  The first snapshot of a source
    gives no changes; an empty one removes all keys.

    State is dealt by source and hash of the key, so that a large feed is `parts`
    groups; each holds its share of one snapshot and of those that wait.
    """
    at_us = F.unix_micros("at")
    told = F.transform(F.coalesce("keys", F.array().cast(_KEYS)), lambda k: F.struct(_bucket(k["indicator_type"], k["indicator"], parts).alias("part"), k["indicator_type"].alias("indicator_type"), k["indicator"].alias("indicator")))
    heads = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda b: F.struct(b.cast("int").alias("part"), F.lit(None).cast("string").alias("indicator_type"), F.lit(None).cast("string").alias("indicator")))
    rows = stream.withWatermark("at", patience).select("source", "at", at_us.alias("at_us"), F.explode(F.concat(told, heads)).alias("k")).select("source", "k.part", "at", "at_us", "k.indicator_type", "k.indicator")
    found = rows.groupBy("source", "part").transformWithStateInPandas(_Changes(), outputStructType=_OUT, outputMode="append", timeMode="eventtime")
    return found.select("source", F.timestamp_micros("at_us").alias("at"), "indicator_type", "indicator", "change")
