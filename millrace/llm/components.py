"""Connected components by alternating stars, distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, settle


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (r[0], r[1])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node links to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours link to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    across = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionByName(across).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node that each linked node reaches.

    Each round rewrites the links as stars round smaller centres (both halves aggregate before
    they join, and a hot centre's join is one that Spark splits); it ends when a round changes
    nothing, after about the logarithm of the largest component. Every round starts from a
    written table. Nodes without a link are not listed; null ends and loops are left out.
    """
    now = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    now = materialise(now.where("a is not null and b is not null and a <> b").distinct(), "links")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        after = materialise(_small_star(_large_star(now)), "links")
        release(now)
        settle(edges.sparkSession)
        now, (before, state) = after, (state, _state(after))
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    low = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(low)
