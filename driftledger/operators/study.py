"""The registry study: classified keys of usable snapshots, compared over days and sources.

`Study` holds four tables: calendar (day), sources (source), usable (day,
source, evidence) and members (day, source, indicator_type, indicator, version,
bits, label, matched, hits) with the kinds ip and cidr; others are in `named`.
Days without a usable snapshot stay unknown, never empty.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftledger.checkpoints import written
from driftledger.functions.addresses import minimal, n_addresses
from driftledger.functions.scalars import jaccard, percent_change
from driftledger.operators.intervals import addresses, containing, disjoint, meeting

#: Scopes of a comparison and the flag of a key that counts in each.
SCOPES = (("GLOBAL_IP_CIDR", "in_all"), ("{c}_FULL", "in_full"), ("{c}_ANY_MATCH", "in_any"))


def classify(members: DataFrame, registry: DataFrame, country: str = "DK", with_text: bool = False) -> DataFrame:
    """members (day, ..., version, bits) with label, matched addresses, and hits, the covered parts as bits.

    registry: (day, version, bits).  A day without registry rows is unknown, not
    empty.  with_text: hits as the least list of networks.
    """
    blocks = written(disjoint(registry, ["day"]))
    days = blocks.select("day").distinct().withColumn("evidence", F.lit(True))
    nets = members.select("day", "version", "bits").distinct()
    whole = containing(nets, blocks, ["day"]).select("day", "version", "bits").distinct().withColumn("full", F.lit(True))
    inside = containing(blocks, nets, ["day"]).where("bits <> holder")
    parts = inside.groupBy("day", "version", F.col("holder").alias("bits")).agg(F.array_sort(F.collect_set("bits")).alias("parts"), F.sum(n_addresses(F.col("version"), F.col("bits"))).cast("decimal(38,0)").alias("part_size"))
    judged = nets.join(F.broadcast(days), "day", "left").join(whole, ["day", "version", "bits"], "left").join(parts, ["day", "version", "bits"], "left")
    size = n_addresses(F.col("version"), F.col("bits"))
    full = F.coalesce("full", F.lit(False)) | F.coalesce(F.col("part_size") == size, F.lit(False))
    label = F.when(F.col("evidence").isNull(), "UNKNOWN_EVIDENCE").when(full, f"{country}_FULL").when(F.col("parts").isNotNull(), f"{country}_PARTIAL").otherwise(f"NO_{country}_MATCH")
    matched = F.when(F.col("evidence").isNotNull(), F.when(full, size).otherwise(F.coalesce("part_size", F.lit(0).cast("decimal(38,0)"))))
    hits = F.when(full, F.array("bits")).when(F.col("parts").isNotNull(), minimal(F.col("parts")) if with_text else F.col("parts")).otherwise(F.array().cast("array<string>"))
    judged = judged.select("day", "version", "bits", label.alias("label"), matched.alias("matched"), hits.alias("hits"))
    return members.join(judged, ["day", "version", "bits"])


@dataclass
class Study:
    calendar: DataFrame
    sources: DataFrame
    usable: DataFrame
    members: DataFrame
    named: DataFrame
    country: str = "DK"

    @classmethod
    def of(cls, keys: DataFrame, snapshots: DataFrame, registry: DataFrame, calendar: DataFrame, sources: DataFrame, parse, country: str = "DK") -> Study:
        """keys: (day, source, indicator_type, indicator) of selected snapshots; snapshots: (day, source) usable ones.

        Keys that come with their version and bits are not parsed again.
        """
        address = F.col("indicator_type").isin("ip", "cidr")
        net = F.when(F.col("bits").isNotNull(), F.struct("version", "bits")) if {"version", "bits"} <= set(keys.columns) else parse(F.col("indicator"))
        keys = written(keys.select("day", "source", "indicator_type", "indicator", F.when(address, net).alias("p")))
        usable = snapshots.select("day", "source").distinct().join(F.broadcast(registry.select("day").distinct().withColumn("evidence", F.lit(True))), "day", "left").fillna(False, ["evidence"])
        nets = keys.where(address & F.col("p").isNotNull()).select("day", "source", "indicator_type", "indicator", "p.version", "p.bits")
        return cls(calendar, written(sources), written(usable), written(classify(nets, registry, country)), keys.where(~address).drop("p"), country)

    @cached_property
    def frame(self) -> DataFrame:
        """Every day and source; the calendar is bounded by the study window."""
        return self.sources.select("source").distinct().join(F.broadcast(self.calendar.agg(F.collect_list("day").alias("days")))).select("source", F.explode("days").alias("day"))

    @cached_property
    def flagged(self) -> DataFrame:
        full, part = F.col("label") == f"{self.country}_FULL", F.col("label") == f"{self.country}_PARTIAL"
        return self.members.select("day", "source", "indicator_type", "indicator", F.lit(True).alias("in_all"), full.alias("in_full"), (full | part).alias("in_any"))

    @cached_property
    def covered(self) -> DataFrame:
        """(day, source, version, bits): disjoint networks in scope that a source covers on a day."""
        return written(disjoint(written(self.members.where(F.size("hits") > 0).select("day", "source", "version", F.explode("hits").alias("bits")).distinct()), ["day", "source"]))

    def label_counts(self) -> DataFrame:
        other = self.named.select("day", "source", F.lit("NOT_IP_IN_SCOPE").alias("label"))
        return self.members.select("day", "source", "label").unionByName(other).groupBy("day", "source", "label").agg(F.count(F.lit(1)).alias("n"))

    def daily(self) -> DataFrame:
        """Counts of every day and source of the calendar; null where nothing is known."""
        c = self.country
        is_ = lambda label: F.count_if(F.col("label") == label)
        counts = self.members.groupBy("day", "source").agg(F.count(F.lit(1)).alias("n_all"), is_(f"{c}_FULL").alias("n_full"), is_(f"{c}_PARTIAL").alias("n_part"), is_(f"NO_{c}_MATCH").alias("n_none"), is_("UNKNOWN_EVIDENCE").alias("n_unknown"))
        named = self.named.groupBy("day", "source").agg(F.count(F.lit(1)).alias("n_named"))
        sizes = addresses(self.covered, ["day", "source"]).groupBy("day", "source").agg(*(F.max(F.when(F.col("version") == v, F.col("addresses"))).alias(f"v{v}") for v in (4, 6)))
        on = ["day", "source"]
        rows = self.frame.join(self.usable.withColumn("u", F.lit(True)), on, "left").join(counts, on, "left").join(named, on, "left").join(sizes, on, "left")
        zero = lambda n: F.coalesce(n, F.lit(0)).cast("long")
        used, known = F.coalesce("u", F.lit(False)), F.coalesce("evidence", F.lit(False))
        if_used = lambda n: F.when(used, zero(n))
        if_known = lambda n: F.when(known, zero(n))
        size = lambda v: F.when(known, F.coalesce(v, F.lit(0)).cast("decimal(38,0)"))
        coverage = F.when(used & (zero("n_all") > 0), F.when(known, 100).otherwise(0))
        return rows.select(
            "day", "source", F.when(used, "usable").otherwise("missing_or_blocked").alias("status"), if_used("n_all").alias("global_ip_cidr"), if_known("n_full").alias("full"), if_known("n_part").alias("partial"),
            F.when(known, zero("n_full") + zero("n_part")).alias("any_match"), if_known("n_none").alias("no_match"), if_used("n_unknown").alias("unknown"), if_used("n_named").alias("non_ip_entries"),
            size("v4").alias("ipv4_addresses"), size("v6").alias("ipv6_addresses"), coverage.alias("classification_coverage_pct"),
        )

    def adjacent_pairs(self) -> DataFrame:
        days = self.calendar.select(F.col("day").alias("previous_date"), F.date_add("day", 1).alias("current_date"))
        return days.join(self.calendar.select(F.col("day").alias("current_date")), "current_date", "left_semi").select("previous_date", "current_date")

    def observed_pairs(self) -> DataFrame:
        """All pairs of observed days: as many as the window asks for, made from one array of days."""
        days = self.usable.agg(F.array_sort(F.collect_set("day")).alias("d"))
        pairs = F.flatten(F.transform("d", lambda a, i: F.transform(F.slice("d", i + 2, F.size("d")), lambda b: F.struct(a.alias("previous_date"), b.alias("current_date")))))
        return days.select(F.explode(pairs).alias("p")).select("p.*")

    def _common(self) -> DataFrame:
        """Keys that adjacent days share, by source, and how many entered or left a scope between them."""
        key = ["source", "indicator_type", "indicator"]
        later = self.flagged.select(F.date_sub("day", 1).alias("day"), *key, F.struct("in_full", "in_any").alias("y"))
        both = self.flagged.withColumn("x", F.struct("in_full", "in_any")).join(later, ["day", *key])
        found = [F.count(F.lit(1)).alias("c_all"), F.lit(0).cast("long").alias("e_all"), F.lit(0).cast("long").alias("l_all")]
        for s in ("full", "any"):
            x, y = F.col(f"x.in_{s}"), F.col(f"y.in_{s}")
            found += [F.count_if(x & y).alias(f"c_{s}"), F.count_if(y & ~x).alias(f"e_{s}"), F.count_if(x & ~y).alias(f"l_{s}")]
        return both.groupBy("source", F.col("day").alias("previous_date"), F.date_add("day", 1).alias("current_date")).agg(*found)

    def _common_of_all_pairs(self) -> DataFrame:
        """The same for every two observed days of a source, without pairing the days of a key.

        A key's history is the set of its source's observed days on which it is
        listed, and of those on which it is in each scope; keys of one history are
        counted first.  Histories as rows of bits over the days, times their
        counts, multiplied by themselves, give the keys of every pair.  A source's
        histories are dealt to tasks of HISTORIES each; a task holds tables of days
        by days, at most 3,660 a side.
        """
        line = Window.partitionBy("source").orderBy("day")
        places = self.usable.select("source", "day").distinct().withColumn("place", F.row_number().over(line) - 1)
        listed = self.flagged.join(places, ["source", "day"]).groupBy("source", "indicator_type", "indicator").agg(F.array_sort(F.collect_list(F.struct("place", "in_full", "in_any"))).alias("d"))
        on = {"all": F.col("d"), "full": F.filter("d", lambda x: x["in_full"]), "any": F.filter("d", lambda x: x["in_any"])}
        histories = written(listed.select("source", *(F.transform(d, lambda x: x["place"]).alias(f"in_{s}") for s, d in on.items())).groupBy("source", "in_all", "in_full", "in_any").agg(F.count(F.lit(1)).alias("w")))
        salts = -(-max(1, histories.count()) // HISTORIES)
        dealt = histories.withColumn("salt", F.pmod(F.xxhash64("in_all", "in_full", "in_any"), F.lit(salts)).cast("int"))
        grid = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<int>")))
        sums = grid.groupBy("source", "salt").cogroup(dealt.groupBy("source", "salt")).applyInArrow(_multiplied, _PAIR_COUNTS)
        if salts > 1:
            sums = sums.groupBy("source", "previous_date", "current_date").agg(*(F.sum(c).alias(c) for c in sums.columns[3:]))
        return sums

    def compare(self, adjacent: bool = True) -> DataFrame:
        """Every pair of days, source and scope: what came and went, and whether the feed or the registry moved."""
        pairs = self.adjacent_pairs() if adjacent else self.observed_pairs()
        grid = self.sources.select("source").distinct().join(F.broadcast(pairs.agg(F.collect_list(F.struct("previous_date", "current_date")).alias("p")))).select("source", F.explode("p").alias("p")).select("source", "p.*")
        sizes = self.flagged.groupBy("day", "source").agg(*(F.count_if(f"in_{s}").alias(f"n_{s}") for s in ("all", "full", "any")))
        state = self.usable.join(sizes, ["day", "source"], "left").fillna(0, ["n_all", "n_full", "n_any"])
        side = lambda p, d: state.select("source", F.col("day").alias(d), F.struct("evidence", "n_all", "n_full", "n_any").alias(p))
        rows = grid.join(side("x", "previous_date"), ["source", "previous_date"], "left").join(side("y", "current_date"), ["source", "current_date"], "left").join(self._common() if adjacent else self._common_of_all_pairs(), ["source", "previous_date", "current_date"], "left")
        both = F.col("x").isNotNull() & F.col("y").isNotNull()
        scopes = []
        for name, flag in SCOPES:
            s = flag[3:]
            ok = both if s == "all" else both & F.col("x.evidence") & F.col("y.evidence")
            part = lambda k, s=s, ok=ok: F.when(ok, F.coalesce(F.col(f"{k}_{s}"), F.lit(0)))
            scopes.append(
                F.struct(F.lit(name.format(c=self.country)).alias("scope"), ok.alias("ok"), F.when(ok, F.col(f"x.n_{s}")).alias("before"), F.when(ok, F.col(f"y.n_{s}")).alias("now"), part("c").alias("common"), part("e").alias("entered"), part("l").alias("left"))
            )
        out = rows.select("source", "previous_date", "current_date", F.explode(F.array(*scopes)).alias("s")).select("source", "previous_date", "current_date", "s.*")
        b, c, k = F.col("before"), F.col("now"), F.col("common")
        return out.select(
            "previous_date", "current_date", "source", F.datediff("current_date", "previous_date").alias("calendar_gap_days"), "scope", F.when(F.coalesce("ok", F.lit(False)), "compared").otherwise("unknown_missing_input").alias("status"),
            b.alias("previous_count"), c.alias("current_count"), (c - k).alias("added_count"), (b - k).alias("removed_count"), k.alias("unchanged_count"), (c - b).alias("net_change"), percent_change(b, c).alias("percent_change"),
            jaccard(k, b + c - k).alias("jaccard"), (c - k - F.col("entered")).alias("feed_added"), (b - k - F.col("left")).alias("feed_removed"), F.col("entered").alias("registry_scope_entered"), F.col("left").alias("registry_scope_left"),
        )

    def first_and_last(self) -> DataFrame:
        """The pair of the window's ends; empty if either was not observed."""
        ends = self.calendar.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a < b").select(F.col("a").alias("previous_date"), F.col("b").alias("current_date"))
        days = ends.select(F.explode(F.array("previous_date", "current_date")).alias("day"))
        # the study of these two days alone has no other pair
        two = replace(self, usable=self.usable.join(F.broadcast(days), "day", "left_semi"), members=self.members.join(F.broadcast(days), "day", "left_semi"))
        return two.compare(adjacent=False)

    def changes(self) -> DataFrame:
        """Keys that entered or left the scope between adjacent days, with the cause."""
        known = self.usable.where("evidence").select("day", "source")
        steps = known.withColumn("next", F.date_add("day", 1)).join(known.select(F.col("day").alias("next"), "source"), ["next", "source"]).select("source", F.col("day").alias("previous_date"), F.col("next").alias("current_date"))
        keys = self.flagged.select("source", "indicator_type", "indicator", "day", "in_any")
        as_before = keys.join(steps.withColumnRenamed("previous_date", "day"), ["source", "day"]).select("source", F.col("day").alias("previous_date"), "current_date", "indicator_type", "indicator", F.col("in_any").alias("x"), F.lit(None).cast("boolean").alias("y"))
        as_now = keys.join(steps.withColumnRenamed("current_date", "day"), ["source", "day"]).select("source", "previous_date", F.col("day").alias("current_date"), "indicator_type", "indicator", F.lit(None).cast("boolean").alias("x"), F.col("in_any").alias("y"))
        sides = as_before.unionByName(as_now).groupBy("source", "previous_date", "current_date", "indicator_type", "indicator").agg(F.max("x").alias("x"), F.max("y").alias("y"))
        moved = sides.where(F.coalesce("x", F.lit(False)) != F.coalesce("y", F.lit(False)))
        added = F.coalesce("y", F.lit(False))
        other = F.when(added, F.col("x")).otherwise(F.col("y"))
        return moved.select(
            "previous_date", "current_date", "source", F.datediff("current_date", "previous_date").alias("calendar_gap_days"), "indicator_type", "indicator", F.when(added, "added").otherwise("removed").alias("change"),
            F.when(other.isNull(), "feed_membership_changed").otherwise("registry_scope_changed").alias("cause"),
        )

    def persistence(self) -> DataFrame:
        """Presence of each key over the days on which its source could be seen, for the whole feed and the scope."""
        eligible = self.usable.select("source", "day", F.explode(F.when(F.col("evidence"), F.array(F.lit("GLOBAL_IP_CIDR"), F.lit(f"{self.country}_ANY_MATCH"))).otherwise(F.array(F.lit("GLOBAL_IP_CIDR")))).alias("scope")).join(F.broadcast(self.calendar.select("day")), "day", "left_semi")
        line = Window.partitionBy("source", "scope").orderBy("day")
        eligible = eligible.withColumn("place", F.row_number().over(line)).withColumn("before", F.lag("day").over(line)).withColumn("after", F.lead("day").over(line))
        total = eligible.groupBy("source", "scope").agg(F.count(F.lit(1)).alias("eligible"))
        keys = self.flagged.select("day", "source", "indicator_type", "indicator", F.explode(F.when(F.col("in_any"), F.array(F.lit("GLOBAL_IP_CIDR"), F.lit(f"{self.country}_ANY_MATCH"))).otherwise(F.array(F.lit("GLOBAL_IP_CIDR")))).alias("scope"))
        seen = keys.join(eligible, ["source", "scope", "day"])
        key = ["source", "scope", "indicator_type", "indicator"]
        by = Window.partitionBy(*key).orderBy("day")
        seen = seen.withColumn("gap", F.col("place") - F.lag("place").over(by)).withColumn("island", F.date_sub("day", F.row_number().over(by)))
        runs = seen.groupBy(*key, "island").agg(
            F.count(F.lit(1)).alias("run"), F.count_if(F.col("gap") > 1).alias("back"), F.min(F.struct("day", "before")).alias("head"), F.max(F.struct("day", "after")).alias("tail")
        )
        out = runs.groupBy(*key).agg(F.sum("run").alias("present"), F.max("run").alias("longest"), F.sum("back").alias("back"), F.min("head").alias("head"), F.max("tail").alias("tail"))
        out = out.join(total, ["source", "scope"])
        return out.select(
            "source", "scope", "indicator_type", "indicator", F.col("head.day").alias("first_observed_date"), F.col("tail.day").alias("last_observed_date"), F.col("present").alias("present_sampled_days"),
            F.col("eligible").alias("eligible_sampled_days"), F.bround(F.col("present") / F.col("eligible"), 6).alias("present_fraction"), F.col("longest").alias("longest_consecutive_calendar_presence"),
            F.col("back").alias("observed_reappearances_after_sampled_absence"), (~F.col("head.before").eqNullSafe(F.date_sub("head.day", 1))).alias("left_censored_or_gap"), (~F.col("tail.after").eqNullSafe(F.date_add("tail.day", 1))).alias("right_censored_or_gap"),
        )

    def overlap(self) -> DataFrame:
        """Each two sources on each day: common keys in scope, and common addresses, which is another matter."""
        known = self.usable.where("evidence").select("day", "source")
        keys = self.flagged.where("in_any").select("day", "source", "indicator_type", "indicator")
        sizes = keys.groupBy("day", "source").agg(F.count(F.lit(1)).alias("n"))
        listed = keys.groupBy("day", "indicator_type", "indicator").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
        pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("source_a"), b.alias("source_b")))))
        common = listed.select("day", F.explode(pairs).alias("p")).groupBy("day", "p.source_a", "p.source_b").agg(F.count(F.lit(1)).alias("c"))
        mine = self.covered.withColumnRenamed("source", "source_a")
        other = self.covered.withColumnRenamed("source", "source_b")
        both = meeting(mine, other, ["day"]).where("source_a < source_b").groupBy("day", "source_a", "source_b", "version").agg(F.sum(n_addresses(F.col("version"), F.col("bits"))).alias("n"))
        both = both.groupBy("day", "source_a", "source_b").agg(*(F.max(F.when(F.col("version") == v, F.col("n"))).cast("decimal(38,0)").alias(f"v{v}") for v in (4, 6)))
        names = self.sources.agg(F.array_sort(F.collect_set("source")).alias("s")).select(F.explode(pairs).alias("p")).select("p.*")
        grid = self.calendar.select("day").join(F.broadcast(names.agg(F.collect_list(F.struct("source_a", "source_b")).alias("p")))).select("day", F.explode("p").alias("p")).select("day", "p.*")
        on = ["day", "source_a", "source_b"]
        has = lambda s, flag: known.select("day", F.col("source").alias(s), F.lit(True).alias(flag))
        n = lambda s, name: sizes.select("day", F.col("source").alias(s), F.col("n").alias(name))
        rows = grid.join(has("source_a", "ha"), ["day", "source_a"], "left").join(has("source_b", "hb"), ["day", "source_b"], "left").join(n("source_a", "na"), ["day", "source_a"], "left").join(n("source_b", "nb"), ["day", "source_b"], "left")
        rows = rows.join(common, on, "left").join(both, on, "left")
        ok = F.coalesce(F.col("ha") & F.col("hb"), F.lit(False))
        zero = lambda x: F.coalesce(x, F.lit(0))
        return rows.select(
            *on, F.when(ok, "compared").otherwise("unknown_missing_input").alias("status"), F.when(ok, zero("c")).alias("key_overlap"), F.when(ok, jaccard(zero("c"), zero("na") + zero("nb") - zero("c"))).alias("key_jaccard"),
            *(F.when(ok, zero(f"v{v}").cast("decimal(38,0)")).alias(f"overlapping_ipv{v}_addresses") for v in (4, 6)),
        )

    def exclusive(self) -> DataFrame:
        """What each source alone holds on days on which every source can be seen."""
        known = self.usable.where("evidence").join(F.broadcast(self.sources.select("source").distinct()), "source", "left_semi").groupBy("day").agg(F.count_distinct("source").alias("k"))
        complete = known.join(F.broadcast(self.sources.agg(F.count_distinct("source").alias("k"))), "k", "left_semi").select("day", F.lit(True).alias("ok"))
        keys = self.flagged.where("in_any").groupBy("day", "indicator_type", "indicator").agg(F.collect_set("source").alias("s")).where(F.size("s") == 1)
        alone = keys.groupBy("day", F.get("s", F.lit(0)).alias("source")).agg(F.count(F.lit(1)).alias("k"))
        # per source, the networks of all others without nested ones
        others = disjoint(self.covered.withColumnRenamed("source", "_s").join(F.broadcast(self.sources.agg(F.collect_set("source").alias("all")))).select("day", F.explode("all").alias("source"), "_s", "version", "bits").where("source <> _s"), ["day", "source"])
        shared = meeting(self.covered, others, ["day", "source"]).groupBy("day", "source", "version").agg(F.sum(n_addresses(F.col("version"), F.col("bits"))).alias("n"))
        own = addresses(self.covered, ["day", "source"]).join(shared, ["day", "source", "version"], "left").select("day", "source", "version", (F.col("addresses") - F.coalesce("n", F.lit(0))).cast("decimal(38,0)").alias("x"))
        own = own.groupBy("day", "source").agg(*(F.max(F.when(F.col("version") == v, F.col("x"))).alias(f"v{v}") for v in (4, 6)))
        rows = self.frame.join(complete, "day", "left").join(alone, ["day", "source"], "left").join(own, ["day", "source"], "left")
        ok = F.coalesce("ok", F.lit(False))
        return rows.select(
            "day", "source", F.when(ok, "compared").otherwise("unknown_missing_input").alias("status"), F.when(ok, F.coalesce("k", F.lit(0))).alias("exclusive_keys"),
            *(F.when(ok, F.coalesce(f"v{v}", F.lit(0)).cast("decimal(38,0)")).alias(f"exclusive_ipv{v}_addresses") for v in (4, 6)),
        )

    def address_changes(self) -> DataFrame:
        """Addresses in scope that each source gained and lost between adjacent days, by version."""
        size = addresses(self.covered, ["day", "source"], "n")
        later = self.covered.select(F.date_sub("day", 1).alias("day"), "source", "version", "bits")
        common = meeting(self.covered, later, ["day", "source"]).groupBy("day", "source", "version").agg(F.sum(n_addresses(F.col("version"), F.col("bits"))).alias("common"))
        known = self.usable.where("evidence").select("day", "source")
        grid = self.frame.join(F.broadcast(self.adjacent_pairs().withColumnRenamed("previous_date", "day")), "day").withColumn("version", F.explode(F.array(F.lit(4), F.lit(6))))
        rows = (
            grid.join(known.withColumn("a", F.lit(True)), ["day", "source"], "left")
            .join(known.select(F.col("day").alias("current_date"), "source", F.lit(True).alias("b")), ["current_date", "source"], "left")
            .join(size.withColumnRenamed("n", "before"), ["day", "source", "version"], "left")
            .join(size.select(F.col("day").alias("current_date"), "source", "version", F.col("n").alias("now")), ["current_date", "source", "version"], "left")
            .join(common, ["day", "source", "version"], "left")
        )
        ok = F.coalesce(F.col("a") & F.col("b"), F.lit(False))
        d = lambda x: F.when(ok, x.cast("decimal(38,0)"))
        before, now, both = (F.coalesce(c, F.lit(0)) for c in ("before", "now", "common"))
        return rows.select(
            F.col("day").alias("previous_date"), "current_date", "source", F.col("version").alias("ip_version"), F.when(ok, "compared").otherwise("unknown_missing_input").alias("status"), d(before).alias("previous_addresses"),
            d(now).alias("current_addresses"), d(now - both).alias("added_addresses"), d(before - both).alias("removed_addresses"), d(both).alias("unchanged_addresses"), d(now - before).alias("net_change"),
        )

    def fixed_registry(self, registry: DataFrame) -> DataFrame:
        """Keys in scope by the earliest registry map that a usable day has, against those by each day's own."""
        first = registry.select("day").distinct().join(self.usable.select("day").distinct(), "day", "left_semi").agg(F.min("day").alias("fixed_registry_date"))
        base = registry.join(F.broadcast(first), F.col("day") == F.col("fixed_registry_date"), "left_semi").select("version", "bits")
        nets = self.members.select("version", "bits").distinct()
        met = containing(nets, base, []).select("version", "bits").unionByName(containing(base, nets, []).select("version", F.col("holder").alias("bits"))).distinct()
        fixed = self.members.join(met, ["version", "bits"], "left_semi").groupBy("day", "source").agg(F.count(F.lit(1)).alias("f"))
        dated = self.flagged.where("in_any").groupBy("day", "source").agg(F.count(F.lit(1)).alias("d"))
        rows = self.frame.join(F.broadcast(first)).join(self.usable.withColumn("u", F.lit(True)), ["day", "source"], "left").join(fixed, ["day", "source"], "left").join(dated, ["day", "source"], "left")
        f = F.when(F.col("u") & F.col("fixed_registry_date").isNotNull(), F.coalesce("f", F.lit(0)))
        d = F.when(F.col("evidence"), F.coalesce("d", F.lit(0)))
        return rows.select("day", "source", "fixed_registry_date", f.alias("fixed_any_match"), d.alias("dated_any_match"), (d - f).alias("difference"))

    def complete_days(self) -> DataFrame:
        """Days on which every source is usable and the registry known."""
        known = self.usable.where("evidence").join(F.broadcast(self.sources.select("source").distinct()), "source", "left_semi").groupBy("day").agg(F.count_distinct("source").alias("n"))
        return known.join(F.broadcast(self.sources.agg(F.count_distinct("source").alias("n"))), "n", "left_semi").select("day")

    def coverage(self, selected: DataFrame) -> DataFrame:
        """Every day and source with the state of its snapshot. selected: (source_name, day, raw_status, blocked)."""
        have = selected.select(F.col("source_name").alias("source"), "day", "raw_status", "blocked", F.lit(True).alias("have"))
        rows = self.frame.join(have, ["day", "source"], "left").join(self.usable.select("day", "source", "evidence", F.lit(True).alias("u")), ["day", "source"], "left")
        yes = lambda c: F.coalesce(c, F.lit(False))
        return rows.select(
            "day", "source", yes("have").alias("normalized_snapshot_available"), yes("u").alias("snapshot_usable"), yes("evidence").alias("dated_evidence"), F.coalesce("raw_status", F.lit("missing")).alias("raw_status"),
            F.when(yes("have"), F.coalesce("blocked", F.lit(""))).otherwise("no_normalized_snapshot").alias("reason"),
        )


#: Histories of a source that one task multiplies, about, and those of one product.
HISTORIES, BLOCK = 200_000, 2048
_PAIR_COUNTS = "source string, previous_date date, current_date date, " + ", ".join(f"{k}_{s} long" for s in ("all", "full", "any") for k in "cel")


def _multiplied(key: tuple, places: pa.Table, histories: pa.Table) -> pa.Table:
    """The counts of every two days of a source; they stay exact, as they are under 2^53."""
    days = places.sort_by("place").column("day").combine_chunks()
    n = len(days)
    sums = {pair: np.zeros((n, n)) for pair in (("all", "all"), ("full", "full"), ("all", "full"), ("any", "any"), ("all", "any"))}
    for at in range(0, histories.num_rows, BLOCK):
        part = histories.slice(at, BLOCK)
        bits = {}
        for s in ("all", "full", "any"):
            lists = part.column(f"in_{s}").combine_chunks()
            bits[s] = np.zeros((len(lists), n))
            bits[s][np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = 1
        weight = part.column("w").to_numpy()[:, None]
        for x, y in sums:
            sums[x, y] += (bits[x] * weight).T @ bits[y]
    first, second = np.triu_indices(n, 1)
    none = np.zeros(len(first), dtype=np.int64)
    counts = [sums["all", "all"][first, second].astype(np.int64), none, none]
    for s in ("full", "any"):
        both, one = sums[s, s][first, second], sums["all", s]
        counts += [x.astype(np.int64) for x in (both, one[first, second] - both, one[second, first] - both)]
    rows = pa.table([pa.repeat(key[0], len(first)), days.take(pa.array(first)), days.take(pa.array(second)), *map(pa.array, counts)], names=[c.split()[0] for c in _PAIR_COUNTS.split(", ")])
    return pa.Table.from_batches(rows.to_batches(max_chunksize=100_000), rows.schema)


def large_changes(compared: DataFrame, least_percent: float = 40.0) -> DataFrame:
    """Rows of the whole feed whose count moved by so many percent: to be looked at before they are explained."""
    return compared.where((F.col("scope") == "GLOBAL_IP_CIDR") & (F.abs("percent_change") >= least_percent))
