"""Connected components of an edge table by alternating stars.

Each round joins every node's larger neighbours to its least neighbour (large
star), then its smaller neighbours (small star), after Kiveris et al.,
"Connected Components in MapReduce and Beyond", 2014.  The edges never leave the
executors and a logarithmic number of rounds is enough in practice.

A round runs in as many tasks as its edges fill, so that few edges do not make
thousands of tiny files.  Nodes with more than 1/HOT_SHARE of all edges (there are
at most 2 * HOT_SHARE) are told their least neighbour by a broadcast of that
bound, so that the neighbours of a hub are never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftledger.llm.common import use_checkpoints

#: Edges to a task, and graphs from which hubs are looked for.
TASK_EDGES, HUB_EDGES = 100_000, 1_000_000
#: A hub has more than one in so many of all edges.
HOT_SHARE = 1000


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def _with_least(pairs: DataFrame, n: int, hub_edges: int) -> DataFrame:
    """(u, v, m) for the pairs (u, v), where m is the least of u and all v paired with it."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    if n < hub_edges:
        return pairs.join(least.drop("c"), "u")
    hub = F.broadcast(least.where(F.col("c") > n // HOT_SHARE).drop("c"))
    others = least.where(F.col("c") <= n // HOT_SHARE).drop("c")
    return pairs.join(hub, "u").unionByName(pairs.join(hub, "u", "left_anti").join(others, "u"))


def connected(edges: DataFrame, most_rounds: int = 60, task_edges: int = TASK_EDGES, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Loops and rows with a null are left out; a node without other edges has no row.
    """
    use_checkpoints(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen = _print_of(now)
    for _ in range(most_rounds):
        n = seen[0]
        tasks = -(-max(1, n) // task_edges)
        now = now.coalesce(tasks)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        large = _with_least(both, 2 * n, hub_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        low = _with_least(large, n, hub_edges).coalesce(tasks)
        # every node keeps an edge to its least neighbour, and its other smaller neighbours get one to it
        small = low.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        now = small.coalesce(tasks).distinct().coalesce(tasks).checkpoint()
        before, seen = seen, _print_of(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
