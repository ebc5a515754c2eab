"""Weighted graphs as edge tables (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.plans.runtime import cut


def transitions(df: DataFrame, group: Column, chunk: Column, order: list[str], node: str) -> DataFrame:
    """(src, dst, n): how often `dst` comes directly after `src` within a group.

    chunk: an expression that never falls along the order, such as a short stretch of time. Rows are ordered within a chunk, and only the first
    and the last row of each chunk meet by group, so that a group may hold any share of the rows. A null node breaks the chain; a null group is one.
    """
    rows = df.select(group.alias("_group"), chunk.alias("_chunk"), *order, F.col(node).alias("_node"))
    w = Window.partitionBy("_group", "_chunk").orderBy(*order)
    # one struct tells a row's end from a null node
    marked = rows.withColumns({"_next": F.lead(F.struct("_node")).over(w), "_first": F.lag(F.lit(1)).over(w).isNull()})
    inside = marked.where("_next is not null").select(F.col("_node").alias("src"), F.col("_next._node").alias("dst"))
    ends = marked.groupBy("_group", "_chunk").agg(F.max(F.when(F.col("_first"), F.col("_node"))).alias("a"), F.max(F.when(F.col("_next").isNull(), F.col("_node"))).alias("src"))
    across = ends.select("src", F.lead("a").over(Window.partitionBy("_group").orderBy("_chunk")).alias("dst"))
    return inside.unionByName(across).where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def probabilities(counts: DataFrame) -> DataFrame:
    """(src, dst, weight): counts as a share of their source's."""
    return counts.select("src", "dst", (F.col("n") / F.sum("n").over(Window.partitionBy("src"))).alias("weight"))


def moving_average(old: DataFrame, new: DataFrame, keep: float = 0.9) -> DataFrame:
    """old * keep + new * (1 - keep) for each edge of either side; a missing side is 0."""
    both = old.select("src", "dst", F.col("weight").alias("a")).join(new.select("src", "dst", F.col("weight").alias("b")), ["src", "dst"], "full")
    return both.select("src", "dst", (F.coalesce("a", F.lit(0.0)) * keep + F.coalesce("b", F.lit(0.0)) * (1 - keep)).alias("weight"))


def homeostatic(edges: DataFrame, target: float = 1.0, ratio: float = 0.2, least: float = 0.05) -> DataFrame:
    """Each source's weights scaled down to a sum of `target`; an edge stays if it then reaches `least` and `ratio` times the largest unscaled one."""
    w = Window.partitionBy("src")
    scaled = edges.select("src", "dst", F.col("weight"), F.sum("weight").over(w).alias("s"), F.max("weight").over(w).alias("m"))
    new = F.when(F.col("s") > target, F.col("weight") * target / F.col("s")).otherwise(F.col("weight"))
    return scaled.withColumn("new", new).where((F.col("new") >= ratio * F.col("m")) & (F.col("new") >= least)).select("src", "dst", F.col("new").alias("weight"))


def strongest(edges: DataFrame, k: int) -> DataFrame:
    """The `k` heaviest edges of each source; equal ones go by dst."""
    order = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    return edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def spread(seeds: DataFrame, edges: DataFrame, steps: int = 2, decay: float = 0.6, least: float = 1e-3) -> DataFrame:
    """(node, activation): activation of `seeds` (node, activation) passed along the edges `steps` times; paths that meet add up."""
    total = step = seeds
    for _ in range(steps):
        moved = step.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("activation") * F.col("weight") * decay).alias("a"))
        step = moved.where(F.col("a") >= least).select(F.col("dst").alias("node"), F.col("a").alias("activation"))
        total = total.unionByName(step)
    return total.groupBy("node").agg(F.sum("activation").alias("activation"))


def reached(seeds: DataFrame, edges: DataFrame, hops: int = 2, decay: float = 0.6) -> DataFrame:
    """(node, hop, activation): nodes first met after `hop` hops; each hop decays by decay^hop and visited nodes aren't met again."""
    seen, front, out = seeds.select("node"), seeds, None
    for hop in range(1, hops + 1):
        moved = front.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("activation") * F.col("weight") * decay**hop).alias("activation"))
        front = moved.withColumnRenamed("dst", "node").join(seen, "node", "left_anti")
        found = front.select("node", F.lit(hop).alias("hop"), "activation")
        out = found if out is None else out.unionByName(found)
        seen = seen.unionByName(front.select("node"))
    return out


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, label) of every node of the undirected `edges` (src, dst); label is the component's smallest node.

    Those of `nodes` (node) that no edge links are components of their own.

    Least labels spread to neighbours and then jump along the label's own label, so that long chains need few rounds; each round's
    state is cut by a reliable checkpoint. Null ends and loops link nothing.
    """
    one = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst")
    both = cut(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        step = cut(labels.join(near.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = cut(step.join(jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")))
        if not labels.where("label <> old").limit(1).count():
            found = labels.select("node", "label")
            if nodes is None:
                return found
            lone = nodes.select("node").where("node is not null").distinct().join(found, "node", "left_anti")
            return found.unionByName(lone.withColumn("label", F.col("node")))
        labels = labels.select("node", "label")


def hubs_and_authorities(edges: DataFrame, rounds: int = 50, tolerance: float = 1e-8, nodes: DataFrame | None = None) -> DataFrame:
    """(node, hub, authority) by mutual reinforcement over `edges` (src, dst, weight), each scaled to a sum of squares of 1.

    Both are renewed at once from the round before, until none changes by `tolerance` or after `rounds` rounds. Those of `nodes` (node)
    that no edge links have 0 in both.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    every = (ends if nodes is None else ends.unionByName(nodes.select("node"))).where("node is not null").distinct()
    to_dst = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight", F.lit(True).alias("inward"))
    to_src = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight", F.lit(False).alias("inward"))
    links = cut(to_dst.unionByName(to_src))
    state = cut(every.withColumns({"hub": F.lit(1.0), "authority": F.lit(1.0)}))
    for _ in range(rounds):
        given = F.when(F.col("inward"), F.col("hub")).otherwise(F.col("authority")) * F.col("weight")
        sums = links.join(state.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum(F.when(F.col("inward"), given)).alias("a"), F.sum(F.when(~F.col("inward"), given)).alias("h"))
        step = cut(state.join(sums, "node", "left").fillna(0.0, ["a", "h"]))
        length = step.agg(F.sqrt(F.sum(F.col("h") ** 2)).alias("h"), F.sqrt(F.sum(F.col("a") ** 2)).alias("a")).first()
        new = step.select("node", F.col("hub").alias("old_h"), F.col("authority").alias("old_a"), *[(F.col(c) / ((length[c] or 0.0) + 1e-12)).alias(n) for c, n in (("h", "hub"), ("a", "authority"))])
        state = new.select("node", "hub", "authority")
        if not new.where((F.abs(F.col("hub") - F.col("old_h")) >= tolerance) | (F.abs(F.col("authority") - F.col("old_a")) >= tolerance)).limit(1).count():
            break
    return state
