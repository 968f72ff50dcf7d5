"""Graphs as tables of edges: connected components and communities by label propagation.

A task first contracts the edges that it holds to stars, so what is shuffled grows with the nodes. Rounds of larger and smaller
neighbours then join the stars of different tasks; once few edges are left, one task ends it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that one task contracts at the end, nodes that a task holds at a time (some 150 bytes each), and rows of a task in rounds of labels.
LAST_EDGES, HELD_NODES, TASK_ROWS = 500_000, 250_000, 500_000


def _stars(batches):
    """Of the edges (u, v) in a task, an edge from each node to the smallest that it is linked to here; see HELD_NODES."""
    import numpy as np
    import pandas as pd

    parent: dict = {}
    get = parent.get

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def held():
        u = np.fromiter(parent, np.int64, len(parent))
        v = np.fromiter(map(root, u.tolist()), np.int64, len(u))
        return pd.DataFrame({"u": u[u != v], "v": v[u != v]})

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            x, y = get(u), get(v)
            if x == y and x is not None:  # under one node already
                continue
            x, y = root(u), root(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > HELD_NODES:
            yield held()
            parent.clear()
    yield held()


def components(edges: DataFrame, write) -> DataFrame:
    """node and component (its smallest reachable node) of every node of the undirected edges (u, v; longs).

    Edges of a node to itself name nodes without links. ``write`` materialises a step (a function of DataFrame and name).
    """
    known = edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    alone = known.where("u = v").select(F.col("u").alias("node")).distinct()
    at, n, before = write(known.where("u <> v").mapInPandas(_stars, "u long, v long"), "stars-0"), 0, None
    while True:
        size = at.count()
        if size <= LAST_EDGES:
            at = write(at.coalesce(1).mapInPandas(_stars, at.schema), "stars")
            break
        n += 1
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"larger-{n}")
        larger = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        at = write(larger.mapInPandas(_stars, larger.schema).distinct(), f"stars-{n}a")
        least = write(at.groupBy("u").agg(F.min("v").alias("m")), f"smaller-{n}")
        smaller = at.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        at = write(smaller.mapInPandas(_stars, smaller.schema).distinct(), f"stars-{n}b")
        now = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    linked = at.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    every = linked.unionByName(roots)
    lone = alone.join(every.select("node"), "node", "left_anti")
    return every.unionByName(lone.select("node", F.col("node").alias("component")))


def label_propagation(edges: DataFrame, write, rounds: int = 10) -> DataFrame:
    """node and community after at most ``rounds`` rounds over the undirected edges (u, v), fewer once no label changes.

    In a round every node takes the label that most of its neighbours had (several edges between two nodes count once; of equally
    frequent ones its own label if it is among them, else the smallest). Nodes start with themselves. To keep two halves of a graph from swapping
    labels for ever, nodes of even and of odd digest take turns.
    """
    known = edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    ways = known.where("u <> v").unionByName(known.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    ways = write(ways, "ways")
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ways.count() // TASK_ROWS))
    nodes = known.select(F.col("u").alias("node")).unionByName(known.select(F.col("v").alias("node"))).distinct()
    at = write(nodes.withColumn("community", F.col("node")), "labels-0")
    for n in range(1, 2 * rounds + 1):
        met = ways.repartition(tasks, "v").join(at.select(F.col("node").alias("v"), "community").repartition(tasks, "v"), "v")
        votes = met.select("u", "community").repartition(tasks, "u").groupBy("u", "community").agg(F.count("*").alias("n"))
        own = votes.join(at.select(F.col("node").alias("u"), F.col("community").alias("own")).repartition(tasks, "u"), "u")
        best = own.groupBy(F.col("u").alias("node")).agg(F.max(F.struct("n", (F.col("community") == F.col("own")).alias("keep"), (-F.col("community")).alias("c")))["c"].alias("c"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == n % 2
        moved = at.join(best, "node", "left").select("node", F.when(turn & F.col("c").isNotNull(), -F.col("c")).otherwise(F.col("community")).alias("community"), F.col("community").alias("was"))
        moved = write(moved, f"labels-{n}")
        changed, at = moved.where("community <> was").limit(1).count(), moved.drop("was")
        if n > 1 and not changed and quiet:
            break
        quiet = not changed
    return at


def community_sizes(labels: DataFrame) -> DataFrame:
    """community and n (its nodes) of labels (node, community)."""
    return labels.groupBy("community").agg(F.count("*").alias("n"))
