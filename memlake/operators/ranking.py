"""Fusing rankings, admitting by probability, and greedy selections over a bounded list."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from memlake.functions.columns import clamp


def reciprocal(rank: Column, k: int = 60, weight: float = 1.0) -> Column:
    """weight / (k + rank); a missing rank adds nothing."""
    return F.coalesce(F.lit(weight) / (F.lit(k) + rank), F.lit(0.0))


def with_pool(df: DataFrame, pool: str, **measures: Column) -> DataFrame:
    """`df` with aggregates of each row's pool, folded on the map side and joined back, so that a pool may hold any share of the rows."""
    own = df.groupBy(F.col(pool).alias("_pool")).agg(*[m.alias(k) for k, m in measures.items()])
    return df.join(own, F.col(pool).eqNullSafe(F.col("_pool"))).drop("_pool")


def pool_z(df: DataFrame, pool: str, x: str) -> DataFrame:
    """`df` with `z`: x's deviation from the pool's mean in (population) deviations of 0.02 at least, between -4 and 6; 0 in pools of fewer than 3 values."""
    rows = with_pool(df, pool, _mean=F.avg(x), _spread=F.stddev_pop(x), _n=F.count(x))
    z = (F.col(x) - F.col("_mean")) / F.greatest(F.lit(0.02), F.col("_spread"))
    return rows.withColumn("z", F.when(F.col("_n") >= 3, clamp(z, -4.0, 6.0)).otherwise(0.0)).drop("_mean", "_spread", "_n")


def admitted(df: DataFrame, pool: str, probability: str, least: float, best: float) -> DataFrame:
    """Rows of at least `least`, of pools whose best row reaches `best`; other pools are left empty."""
    return with_pool(df, pool, _best=F.max(probability)).where((F.col("_best") >= best) & (F.col(probability) >= least)).drop("_best")


def tied_rank(df: DataFrame, pool: str, value: str, name: str, fine: int = 1_024) -> DataFrame:
    """`df` with the rank of each row in its pool by falling `value`: equal values share a rank, the next one skips; null for null, NaN is highest.

    Rows are ordered within a pool's buckets of 1 / `fine`; the ranks begin after the number of rows in higher buckets, so that no pool is ordered
    in one task, unless its values are all in one bucket.
    """
    x = F.col(value)
    bucket = F.when(F.isnan(x), F.lit((1 << 62) + 1)).when(x.isNotNull(), F.floor(F.greatest(F.lit(-4e15), F.least(F.lit(4e15), x.cast("double"))) * fine))
    rows = df.withColumn("_bucket", bucket)
    counts = rows.where("_bucket is not null").groupBy(F.col(pool).alias("_pool"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    higher = Window.partitionBy("_pool").orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pool", "_b", F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_above"))
    met = rows.join(offsets, F.col(pool).eqNullSafe(F.col("_pool")) & (F.col("_bucket") == F.col("_b")), "left")
    own = F.rank().over(Window.partitionBy(pool, "_bucket").orderBy(x.desc()))
    return met.withColumn(name, F.when(F.col("_bucket").isNotNull(), F.col("_above") + own)).drop("_bucket", "_pool", "_b", "_above")


def diverse(df: DataFrame, pool: str, kind: str, order: list[Column], cap: int = 2) -> DataFrame:
    """The first `cap` rows of each kind in each pool."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(pool, kind).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")


def packed(sizes: Column, budget: int) -> Column:
    """Places (from 1) of the items that fit a budget when taken in order; one that doesn't fit is skipped, the first always fits."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["at"] == 0) | (s["used"] + x <= budget)
        return F.struct(
            F.when(fits, s["used"] + x).otherwise(s["used"]).alias("used"), F.when(fits, F.array_append(s["taken"], (s["at"] + 1).cast("int"))).otherwise(s["taken"]).alias("taken"), (s["at"] + 1).alias("at")
        )

    return F.aggregate(sizes, start, step)["taken"]


def mmr(df: DataFrame, pool: str, item: str, score: str, vector: str, k: int = 5, relevance: float = 0.72) -> DataFrame:
    """(pool, item, place): items of each pool chosen one by one by relevance * score - (1 - relevance) * similarity to those chosen.

    Each pool must be a bounded list, such as a ranking's head: the choice depends on the order and needs the pool at once. Equal values go by item.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item, ignore_index=True)
        m = np.stack(pdf[vector].map(np.asarray)).astype(float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        near, left, out = np.zeros(len(m)), np.ones(len(m), bool), []
        for _ in range(min(k, len(m))):
            value = np.where(left, relevance * pdf[score].to_numpy() - (1 - relevance) * near, -np.inf)
            i = int(np.round(value, 9).argmax())
            out.append(i)
            left[i] = False
            near = np.maximum(near, m @ m[i])
        return pd.DataFrame({pool: pdf[pool].iloc[0], item: pdf[item].iloc[out], "place": range(1, len(out) + 1)})

    return df.groupBy(pool).applyInPandas(choose, f"{pool} long, {item} long, place int")


def apart(df: DataFrame, pool: str, item: str, score: str, vector: str, most: float = 0.92) -> DataFrame:
    """(pool, item, place): items of each pool, best first, without those as similar as `most` to one that was kept; equal scores go by item.

    Each pool must be a bounded list, as in `mmr`.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, item], ascending=[False, True], ignore_index=True)
        m = np.stack(pdf[vector].map(np.asarray)).astype(float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        kept: list[int] = []
        for i in range(len(m)):
            if not kept or np.round(m[kept] @ m[i], 9).max() < most:
                kept.append(i)
        return pd.DataFrame({pool: pdf[pool].iloc[0], item: pdf[item].iloc[kept], "place": range(1, len(kept) + 1)})

    return df.groupBy(pool).applyInPandas(choose, f"{pool} long, {item} long, place int")


def _common(x: list, y: list) -> int:
    if x is None or y is None:
        return 0
    places: dict = {}
    for i, v in enumerate(y):
        places[v] = places.get(v, 0) | (1 << i)
    row = full = (1 << len(y)) - 1
    for v in x:
        met = row & places.get(v, 0)
        row = ((row + met) | (row - met)) & full
    return len(y) - row.bit_count()


@F.pandas_udf(IntegerType())
def _common_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_common(x, y) for x, y in zip(a, b)], dtype="int32")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two lists, a line of the table as one number's bits; 0 for an empty or null list."""
    return _common_lengths(a, b)
