"""Most similar vectors for every vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.cells import HEAVY, TABLES, assign, fit_cells, per_group, without_copies
from memlake.llm.collisions import top_neighbours
from memlake.plans.runtime import written

NEIGHBOURS = pa.schema([("id", pa.int64()), ("nbr", pa.int64()), ("cosine", pa.float64())])


def vectors_of(df: DataFrame, key: Column, vector: Column) -> DataFrame:
    """(id, vec) of the rows that have both."""
    return df.select(key.cast("long").alias("id"), vector.alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") > 0))


def nearest_vectors(vectors: DataFrame, k: int = 5, least: float = -1.0, tables: int = TABLES, heavy: int = HEAVY) -> DataFrame:
    """(id, nbr, cosine): the `k` most similar other vectors of each vector of `vectors` (id long, vec array<float>).

    Approximate: neighbours that share none of the vector's cells, or collide with it on too few lines, are missed. Cosines below `least`
    don't count; equal ones (at 9 decimals) go by the smaller id. Null, empty, all-zero and non-finite vectors have no result and
    are nobody's neighbour; vectors of different lengths aren't compared; repeated rows of an id count once; an empty
    input gives an empty result. A vector that more than `heavy` rows share is compared through its smallest ids, and every
    one of those rows gets its own result.
    """
    index, members = without_copies(vectors, k + 1, heavy)

    def work(ids: np.ndarray, m: np.ndarray, other_ids: np.ndarray, other: np.ndarray) -> pa.Table:
        found = [top_neighbours(ids, m, other_ids, other, k, least)]
        if ids is not other_ids:
            found.append(top_neighbours(other_ids, other, ids, m, k, least))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], schema=NEIGHBOURS)

    found = per_group(assign(index, fit_cells(index, max(least, 0.0), tables)), work, "id long, nbr long, cosine double")
    best = _best(found, k)
    if members is not None:
        best = written(best, "best")
        head = members.select("id", F.element_at("firsts", 1).alias("head"), "firsts")
        own = head.select("id", F.explode("firsts").alias("nbr"), F.lit(1.0).alias("cosine"))
        near = head.join(best.withColumnRenamed("id", "head"), "head").select("id", "nbr", "cosine")
        best = best.unionByName(_best(own.unionByName(near).where(F.col("id") != F.col("nbr")), k))
    return best


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each id, each neighbour once; one shuffle."""
    once = found.repartition("id").groupBy("id", "nbr").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "nbr")
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def neighbour_pairs(best: DataFrame) -> DataFrame:
    """Distinct (id_1, id_2), id_1 < id_2, of which one is among the neighbours of the other."""
    return best.select(F.least("id", "nbr").alias("id_1"), F.greatest("id", "nbr").alias("id_2")).distinct()
