"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, component: its smallest reachable node) for every node of the undirected edges (a, b).

    Every round points each node's larger neighbours, then each node's smaller ones, to the smallest node in sight, until nothing
    changes; rounds grow with the logarithm of the longest chain. Minima are written before they are joined back, so that the
    join's large partitions (of a node with very many links) can be split.
    """
    at = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{path}/edges-0")
    mark, n = None, 0
    while True:
        n += 1
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{path}/large-{n}")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        at = materialize(large, f"{path}/edges-{n}a")
        least = materialize(at.groupBy("u").agg(F.min("v").alias("m")), f"{path}/small-{n}")
        small = at.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        at = materialize(small.distinct(), f"{path}/edges-{n}b")
        now = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    found = at.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
