"""Grouping vectors into clusters of mutually similar ones.

Each partition folds its vectors into the leaves of a cluster-feature tree: (count, sum, sum of squares), which add up when
leaves merge. Leaves are reduced tree-wise, partition by partition, to one bounded set; Ward's method agglomerates those few;
one pass assigns every vector to a pile of its agglomerated cluster. Links within runs of a pile give first components, links between
these are found among all vectors (`memlake.llm.links`), so that the clusters don't depend on the trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.batches import small
from memlake.llm.cells import APART, MAX_PIVOTS, by_length, unit, without_copies
from memlake.llm.links import cosines, piled, root_links, slack
from memlake.plans.runtime import broadcast_if_small, cut, written

#: Leaves that a tree keeps at most, and trees that are merged at once.
LEAVES, FAN = 1024, 8
#: Cosine at which a vector enters a leaf, and the lower ones tried while there are too many leaves.
CLOSE = (0.75, 0.7, 0.65, 0.6)
LEAF_SCHEMA = "part long, dim int, n double, total binary, squares double"


def condense(n: np.ndarray, total: np.ndarray, squares: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves merged with a heavier leaf that is close, at ever lower cosines until at most `limit` are left.

    If too many are left at the lowest one, the lightest are forgotten: they stand for vectors that lie alone, or in clusters too small for a
    pile of their own. Vectors that no leaf stands for are compared in full.
    """
    for close in CLOSE:
        order = np.argsort(-n, kind="stable")
        n, total, squares = n[order], total[order], squares[order]
        centre = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-300)
        near = centre.astype(np.float32) @ centre.astype(np.float32).T >= close
        into = np.full(len(n), -1)
        for i in range(len(n)):
            if into[i] < 0:
                into[near[i] & (into < 0)] = i
                into[i] = i
        heads, group = np.unique(into, return_inverse=True)
        n2, squares2 = np.bincount(group, n), np.bincount(group, squares)
        total2 = np.zeros((len(heads), total.shape[1]))
        np.add.at(total2, group, total)
        n, total, squares = n2, total2, squares2
        if len(n) <= limit:
            return n, total, squares
    kept = np.argsort(-n, kind="stable")[:limit]
    return n[kept], total[kept], squares[kept]


def _leaf_rows(part: int, dim: int, n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> pa.Table:
    return pa.table(
        {"part": pa.array(np.full(len(n), part, np.int64)), "dim": pa.array(np.full(len(n), dim, np.int32)), "n": n.astype(float), "total": pa.array([t.astype(np.float64).tobytes() for t in total], pa.binary()), "squares": squares.astype(float)}
    )


def feature_leaves(vectors: DataFrame, limit: int = LEAVES) -> DataFrame:
    """Leaves of each partition's tree and vector length; at most `limit` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in small(batches, 2_000):
            for _, m in by_length(batch.column("id"), batch.column("vec")):
                u = unit(m)
                for at in range(0, len(u), 2048):
                    part = u[at : at + 2048]
                    n, total, squares = trees.get(m.shape[1], (np.empty(0), np.empty((0, m.shape[1])), np.empty(0)))
                    if len(n):  # vectors close to a leaf enter it
                        centre = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-300)
                        score = part.astype(np.float32) @ centre.astype(np.float32).T
                        leaf = score.argmax(1)
                        inside = score[np.arange(len(part)), leaf] >= CLOSE[0]
                        np.add.at(total, leaf[inside], part[inside])
                        add = np.bincount(leaf[inside], minlength=len(n))
                        n, squares, part = n + add, squares + add, part[~inside]
                    one = np.ones(len(part))
                    n, total, squares = np.concatenate([n, one]), np.concatenate([total, part]), np.concatenate([squares, one])
                    if len(n) > 2 * limit:
                        n, total, squares = condense(n, total, squares, limit)
                    trees[m.shape[1]] = n, total, squares
        for dim, leaves in trees.items():
            yield from _leaf_rows(TaskContext.get().partitionId(), dim, *condense(*leaves, limit)).to_batches()

    return vectors.mapInArrow(run, LEAF_SCHEMA)


def reduce_leaves(leaves: DataFrame, limit: int = LEAVES, fan: int = FAN) -> DataFrame:
    """The leaves of all partitions merged, `fan` trees at a time, to at most `limit` for each vector length."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        total = np.frombuffer(b"".join(table.column("total").to_pylist()), np.float64).reshape(table.num_rows, dim)
        return _leaf_rows(key[0].as_py(), dim, *condense(table.column("n").to_numpy(), total, table.column("squares").to_numpy(), limit))

    leaves = written(leaves, "leaves")
    parts = (leaves.agg(F.max("part")).first()[0] or 0) + 1
    for _ in range(max(1, ceil(log(parts, fan) - 1e-9) if parts > 1 else 1)):
        leaves = leaves.withColumn("part", F.floor(F.col("part") / fan)).groupBy("part", "dim").applyInArrow(run, LEAF_SCHEMA)
    return leaves


def ward(n: np.ndarray, centre: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (cost, a, b) of Ward's method by nearest-neighbour chains; each merge keeps the slot a."""
    n, centre = n.astype(float).copy(), centre.astype(float).copy()
    live = np.ones(len(n), bool)
    chain: list[int] = []
    merges = []
    for _ in range(len(n) - 1):
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            tip = chain[-1]
            cost = n * n[tip] / (n + n[tip]) * ((centre - centre[tip]) ** 2).sum(1)
            cost[~live] = np.inf
            cost[tip] = np.inf
            best = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[best]:
                best = chain[-2]
                break
            chain.append(best)
        chain = chain[:-2]
        a, b = min(tip, best), max(tip, best)
        merges.append((float(cost[best]), a, b))
        centre[a] = (n[a] * centre[a] + n[b] * centre[b]) / (n[a] + n[b])
        n[a] += n[b]
        live[b] = False
    return merges


def agglomerate(n: np.ndarray, total: np.ndarray, within: float = APART) -> np.ndarray:
    """Unit centroids of the Ward clusters of leaves, heaviest first; clusters whose centroids' cosine is below `within` stay apart."""
    parent = list(range(len(n)))
    size, sums = n.astype(float).copy(), total.astype(float).copy()

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for _, a, b in sorted(ward(n, total / n[:, None])):
        a, b = root(a), root(b)
        if sums[a] @ sums[b] >= within * np.sqrt((sums[a] @ sums[a]) * (sums[b] @ sums[b])):
            parent[b], size[a], sums[a] = a, size[a] + size[b], sums[a] + sums[b]
    heads = np.array([i for i in range(len(n)) if parent[i] == i])
    heads = heads[np.argsort(-size[heads], kind="stable")]
    heads = heads[(size[heads] > 1) | (np.arange(len(heads)) == 0)]
    return sums[heads] / np.maximum(np.linalg.norm(sums[heads], axis=1, keepdims=True), 1e-300)


def ward_centroids(vectors: DataFrame, limit: int = LEAVES) -> dict[int, np.ndarray]:
    """Centroids by vector length; at most `limit` leaves of each length come to the driver."""
    found = {}
    rows = reduce_leaves(feature_leaves(vectors, limit), limit).toArrow()
    dims = rows.column("dim").to_numpy()
    for dim in np.unique(dims):
        own = rows.filter(pa.array(dims == dim))
        total = np.frombuffer(b"".join(own.column("total").to_pylist()), np.float64).reshape(own.num_rows, int(dim))
        found[int(dim)] = agglomerate(own.column("n").to_numpy(), total)[:MAX_PIVOTS]
    return found


def _local_roots(ids: np.ndarray, raw: np.ndarray, least: float) -> np.ndarray:
    """The smallest id of each vector's component of the links between the vectors."""
    u = unit(raw).astype(np.float32)
    roots, margin = ids.copy(), slack(raw.shape[1])
    while True:
        before = roots.copy()
        for at in range(0, len(ids), 512):
            score = u[at : at + 512] @ u.T
            near = score >= least
            r, c = np.nonzero(np.abs(score - least) < margin)
            for k in range(0, len(r), 16_384):
                x, y = r[k : k + 16_384], c[k : k + 16_384]
                near[x, y] = cosines(raw[at + x], raw[y]) >= least
            own = roots[at : at + 512]
            low = np.minimum(np.where(near, roots[None, :], np.iinfo(np.int64).max).min(1), own)
            roots[at : at + 512] = low
            roots = np.minimum(roots, np.where(near, low[:, None], np.iinfo(np.int64).max).min(0))
        if (roots == before).all():
            return roots


def joined_roots(links: DataFrame) -> DataFrame:
    """(root, label) of local components (id, root) that share members, directly or through others; label is the smallest root.

    Minimum labels spread over the graph of the roots; the state is cut by a checkpoint in each round.
    """
    heads = links.groupBy("id").agg(F.min("root").alias("head"))
    edges = links.join(heads, "id").where(F.col("root") != F.col("head")).select("root", "head").distinct()
    edges = written(edges.unionByName(edges.select(F.col("head").alias("root"), F.col("root").alias("head"))), "edges")
    labels = edges.select("root").distinct().withColumn("label", F.col("root"))
    while True:
        near = edges.join(labels.withColumnRenamed("root", "head"), "head").groupBy("root").agg(F.min("label").alias("near"))
        # a step to the neighbours' least label, then one along the label's own label
        step = cut(labels.join(near, "root", "left").select("root", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = step.select(F.col("root").alias("label"), F.col("label").alias("far"))
        labels = cut(step.join(jump, "label", "left").select("root", "old", F.least("label", "far").alias("label")))
        if not labels.where(F.col("label") != F.col("old")).limit(1).count():
            return labels.select("root", "label")
        labels = labels.select("root", "label")


def linked_clusters(vectors: DataFrame, least: float = 0.7, smallest: int = 5) -> DataFrame:
    """(cluster_key, id): components of vectors of cosine `least` or more with `smallest` members or more, named by the smallest id.

    `vectors` is (id long, vec array<float>). Null, empty, all-zero and non-finite vectors belong to no cluster; different
    lengths aren't compared; repeated rows of an id count once; copies are members like others. No link is missed, whatever the number of
    vectors. Of a vector that many rows share two are linked to others, the rest goes where they go.
    """
    index, members = without_copies(vectors, 2)
    rows = piled(index, ward_centroids(vectors), lambda ids, m: _local_roots(ids, m, least))
    edges = root_links(rows, least)
    local = rows.where(F.col("id") != F.col("root"))
    ends = [(local, "id", "root"), (local, "root", "root"), (edges, "a", "a"), (edges, "a", "b"), (edges, "b", "b")]
    links = reduce(DataFrame.unionByName, [df.select(F.col(i).alias("id"), F.col(r).alias("root")) for df, i, r in ends])
    roots = joined_roots(links)
    own = links.groupBy("id").agg(F.min("root").alias("root"))
    labelled = own.join(broadcast_if_small(roots), "root", "left").select("id", F.coalesce("label", "root").alias("cluster_key"))
    labelled = written(labelled, "labelled")
    if members is not None:
        heads = labelled.withColumnRenamed("id", "head")
        labelled = labelled.unionByName(members.select("id", F.element_at("firsts", 1).alias("head")).join(heads, "head").select("id", "cluster_key"))
    large = labelled.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= smallest).select("cluster_key")
    return labelled.join(broadcast_if_small(large), "cluster_key").select("cluster_key", "id")


def typical_members(members: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """(cluster_key, size, rank, id, centroid_cosine) of the `k` members nearest to each cluster's centroid.

    Sums are folded per task before they meet, so a cluster may hold any share of the rows. Equal cosines (6 decimals) go by the id.
    """
    rows = written(vectors.join(members, "id").dropDuplicates(["id"]).select("cluster_key", "id", "vec"), "members")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("cluster_key").to_numpy()
            place = {int(i): int(c) for i, c in zip(batch.column("id").to_numpy(), keys)}
            for ids, m in by_length(batch.column("id"), batch.column("vec")):
                own, group = np.unique([place[int(i)] for i in ids], return_inverse=True)
                total = np.zeros((len(own), m.shape[1]))
                np.add.at(total, group, unit(m))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(group)), pa.array(list(total), pa.list_(pa.float64()))], names=["cluster_key", "n", "total"])

    sums = rows.mapInArrow(fold, "cluster_key long, n long, total array<double>")
    flat = sums.select("cluster_key", "n", F.posexplode("total")).groupBy("cluster_key", "pos").agg(F.sum("col").alias("v"), F.sum("n").alias("size"))
    centres = flat.groupBy("cluster_key").agg(F.max("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("centre"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    scored = rows.join(broadcast_if_small(centres, 20_000), "cluster_key").withColumn("centroid_cosine", F.round(dot("vec", "centre") / F.sqrt(dot("vec", "vec") * dot("centre", "centre")), 6))
    order = Window.partitionBy("cluster_key").orderBy(F.col("centroid_cosine").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("cluster_key", "size", "rank", "id", "centroid_cosine")
