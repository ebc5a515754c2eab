"""A stated set of query vectors against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of one pass over the rows, and those and the rows that are multiplied at once.
QUERIES, TILE, ROWS = 20_000, 2_000, 1_000


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit rows of the usable vectors of one length."""
    keep = pc.and_(pc.is_valid(batch.column("id")), pc.equal(pc.list_value_length(batch.column("vec")), width)).fill_null(False)
    own = batch.filter(keep)
    flat = own.column("vec").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
    m = flat.reshape(-1, width)
    good = np.isfinite(m).all(1) & (m != 0).any(1)
    m = m[good] / np.abs(m[good]).max(1, initial=0, keepdims=True)
    return own.column("id").to_numpy(zero_copy_only=False)[good].astype(np.int64), m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _tiles(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of queries, ids of rows, cosines at 6 decimals) of bounded parts of the product."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            own, m = _matrix(batch.slice(at, ROWS), width)
            for start in range(0, len(ids) if len(own) else 0, TILE):
                yield np.arange(start, min(start + TILE, len(ids))), own, np.round(q[start : start + TILE] @ m.T, 6)


def _passes(queries: DataFrame, block: int) -> Iterator[pa.Table]:
    """The query set in hash blocks of about `block` rows."""
    parts = max(1, -(-queries.count() // block))
    for p in range(parts):
        yield queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).toArrow()


def block_search(rows: DataFrame, queries: DataFrame, k: int, width: int, same: bool = True, block: int = QUERIES, earlier: bool = False) -> DataFrame:
    """(query_id, id, cosine, rank): the `k` rows most similar to each query, exactly; both are (id long, vec array<float>).

    Vectors of another length than `width`, null or unusable ones don't count; with `same` a row isn't its own result, with
    `earlier` only rows of smaller ids are results. Cosines
    are rounded to 6 decimals, equal ones go by id. Each task keeps k rows of each query; those meet by query.
    """

    def search(asked: pa.Table) -> DataFrame:
        qs = [_matrix(b, width) for b in asked.to_batches()]
        ids, q = (np.concatenate(x) for x in zip(*qs)) if qs else (np.empty(0, np.int64), np.empty((0, width)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            for places, own, score in _tiles(batches, ids, q, width):
                if same:
                    score[ids[places][:, None] == own[None, :]] = -2
                if earlier:
                    score[ids[places][:, None] <= own[None, :]] = -2
                keep = score >= (np.partition(score, len(own) - k, axis=1)[:, len(own) - k, None] if len(own) > k else -1.5)
                a, b = np.nonzero(keep & (score > -1.5))
                a, b, s = np.concatenate([best[0], places[a]]), np.concatenate([best[1], own[b]]), np.concatenate([best[2], score[a, b]])
                order = np.lexsort((b, -s, a))
                a, b, s = a[order], b[order], s[order]
                top = np.arange(len(a)) - np.searchsorted(a, a, "left") < k
                best = a[top], b[top], s[top]
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "id", "cosine"])

        return rows.mapInArrow(run, "query_id long, id long, cosine double")

    found = reduce(DataFrame.unionByName, [search(t) for t in _passes(queries, block)]).distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_histogram(rows: DataFrame, queries: DataFrame, width: int, step: float = 0.05, block: int = QUERIES) -> DataFrame:
    """(bin, pairs): how many (query, other row) pairs have a cosine in each bin of `step`, counted within the tasks."""

    def count(asked: pa.Table) -> DataFrame:
        qs = [_matrix(b, width) for b in asked.to_batches()]
        ids, q = (np.concatenate(x) for x in zip(*qs)) if qs else (np.empty(0, np.int64), np.empty((0, width)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, int] = {}
            for places, own, score in _tiles(batches, ids, q, width):
                score = score[ids[places][:, None] != own[None, :]]
                for b, n in zip(*np.unique(np.floor(np.round(score / step, 6)).astype(np.int64), return_counts=True)):
                    total[int(b)] = total.get(int(b), 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["bin", "n"])

        return rows.mapInArrow(run, "bin long, n long")

    return reduce(DataFrame.unionByName, [count(t) for t in _passes(queries, block)]).groupBy("bin").agg(F.sum("n").alias("pairs"))
