"""Connected components of a link table by alternating large and small stars, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Workspace


def _signature(links: DataFrame) -> tuple:
    """Row count and an order-free digest: what tells that a round changed nothing."""
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31)).alias("h"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["h"], row["x"]


def components(links: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root) for each node that has a link; root is the smallest node it reaches.

    ``links`` has longs ``u`` and ``v``, in either order; loops and repeats do no harm. Minima are pre-aggregated, and the joins
    read written tables on both sides, so that a node with a third of all links is split among tasks. Each round writes its links.
    """
    links = ws.write(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links0", narrow=True)
    k, before = 0, _signature(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"least{k}", narrow=True)
        large = ws.write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large{k}", narrow=True)
        least2 = ws.write(large.groupBy("u").agg(F.min("v").alias("m")), f"least2{k}", narrow=True)
        near = large.join(least2, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least2.select("u", F.col("m").alias("v"))).distinct()
        after = ws.write(small, f"links{k + 1}", narrow=True)
        for name in (f"links{k}", f"least{k}", f"large{k}", f"least2{k}"):
            ws.drop(name)
        links, k, last, before = after, k + 1, before, _signature(after)
        if before == last:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
