"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.llm.common import discard, stored


def _star(edges: DataFrame, large: bool, hub: int) -> DataFrame:
    """One star step over edges (u, v). Large: larger neighbours go to the least one; small: the rest do.

    Nodes with more than `hub` edges meet their own edges by broadcast, the others by the node.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    hubs = F.broadcast(least.filter(F.col("n") > hub).select("u", "m"))
    joined = both.join(hubs, "u").unionByName(both.join(hubs, "u", "left_anti").join(least.filter(F.col("n") <= hub).select("u", "m"), "u"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, least_hub: int = 1000) -> DataFrame:
    """(node, component): the least node reachable, for every node of edges (u, v), integers.

    Each round is written to the shared folder, so it survives lost executors and plans stay short; the
    round before is deleted then. Rounds go on until none changes an edge, which takes a number of them in
    the order of the logarithm squared of the nodes. Self-loops and repeated edges are harmless; nodes of
    self-loops only are not returned. A hub has more than a thousand edges and a 1024th of all, so there are
    2048 at most.
    """
    now = stored(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).filter("u <> v").distinct().select("u", "v"), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen, settled = mark(now), False
    while seen[0] and not settled:
        hub = max(least_hub, seen[0] // 1024)
        after = stored(_star(_star(now, True, hub), False, hub), "edges")
        discard(now)
        found = mark(after)
        now, settled, seen = after, found == seen, found
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
