"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.plans.runtime import BROADCAST_ROWS, written

#: Buckets for each doubling of the score.
FINE = 32
#: Rows of the table that gives groups without a threshold of their own a common one.
SHARED = 1 << 16


def score_bucket(score: Column) -> Column:
    """An integer that never falls as the score rises; logarithmic, so that it needs no minimum or maximum first."""
    steps = lambda x: F.floor(F.log2(F.least(x, F.lit(1.7e308))) * FINE).cast("int") + F.lit(1_100 * FINE)
    return F.when(score > 0, steps(score)).when(score < 0, -steps(-score)).otherwise(0)


def latest_rows(df: DataFrame, keys: list[str], version: str, keep: list[str]) -> DataFrame:
    """One row of each key, that of the latest version (a null one is the oldest); equal versions are settled by the values kept."""
    newest = F.max(F.struct(F.col(version), *[F.col(c) for c in keep])).alias("newest")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"newest.{c}").alias(c) for c in keep])


def group_floors(rows: DataFrame, group: str, n: int) -> DataFrame:
    """(_group, _floor, _all): the lowest bucket that leaves `n` of a group's rows at or above it, null for groups of fewer, and the group's rows."""
    histogram = rows.groupBy(F.col(group).alias("_group"), "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy("_group").orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = histogram.withColumn("_above", F.sum("_n").over(above))
    return reached.groupBy("_group").agg(F.max(F.when(F.col("_above") >= n, F.col("_bucket"))).alias("_floor"), F.sum("_n").alias("_all"))


def above_floors(rows: DataFrame, group: str, n: int, broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` (with `_bucket`) without those below a bound that leaves each group its `n` best; the bounds meet the rows by broadcasts of bounded size.

    A group of more rows than the whole count divided by `broadcast` has its own floor: there are fewer than `broadcast` such groups,
    whatever the input. All other groups share the lowest floor of those with the same hash (none if one of them has fewer than `n` rows).
    """
    floors = written(group_floors(rows, group, n), "floors")
    total = floors.agg(F.sum("_all")).first()[0] or 0
    large = F.col("_all") > total // broadcast
    none = F.lit(-(1 << 31))
    own = floors.where(large).select("_group", F.coalesce("_floor", none).alias("_own"))
    met = rows.join(F.broadcast(own), F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    least = F.col("_own")
    if floors.where(~large).limit(1).count():
        slot = lambda c: F.pmod(F.xxhash64(c), F.lit(min(SHARED, broadcast)))
        shared = floors.where(~large).groupBy(slot("_group").alias("_slot")).agg(F.min(F.coalesce("_floor", none)).alias("_shared"))
        met = met.withColumn("_slot", slot(group)).join(F.broadcast(shared), "_slot", "left").drop("_slot")  # at most SHARED rows
        least = F.coalesce(least, F.col("_shared"))
    return met.where(least.isNull() | (F.col("_bucket") >= least)).select(rows.columns)


def top_n(items: DataFrame, group: str, score: str, ties: list[Column], n: int = 5) -> DataFrame:
    """The `n` rows of `items` with the highest `score` in each `group`, with their `rank`; equal scores go by `ties`.

    Rows whose score is null or NaN never count; infinite ones do. A null group is a group of its own. Repeated rows are rows of their
    own. A group of fewer than `n` rows comes out whole; an empty input gives an empty result.

    A histogram of each group's scores, folded on the map side, tells the lowest bucket that still leaves `n` rows at or above it.
    Rows below are dropped before the shuffle that ranks; a bucket that holds the n-th row is kept whole, so the result is exact.
    """
    rows = items.where(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("_bucket", score_bucket(F.col(score)))
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), *ties)
    # a rank below a constant is limited within each map task first, so a bucket of many equal scores doesn't meet in one task whole
    return above_floors(rows, group, n).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("_bucket")


def latest_candidates(candidates: DataFrame) -> DataFrame:
    """The latest row of each (retrieval_id, candidate_kind, candidate_id); written once, as two branches read it."""
    return written(latest_rows(candidates, ["retrieval_id", "candidate_kind", "candidate_id"], "loaded_at", ["rrf_score", "selected_position"]), "latest")
