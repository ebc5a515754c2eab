"""Logs in which the latest row of a key wins, and what was delivered, assessed or left open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`, which should be total; a null key is a key. The rank is limited before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `df` whose keys `other` lacks."""
    return df.join(other, keys, "left_anti")


def complete(parents: DataFrame, children: DataFrame, key: str, failed: Column) -> DataFrame:
    """Parents that have children of which none failed (EXISTS and NOT EXISTS as semi and anti join)."""
    return parents.join(children, key, "left_semi").join(children.where(failed), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of both; where both have a key, the new row's values unless null."""
    a = old.select(*keys, *[F.col(v).alias(f"_old_{v}") for v in values])
    b = new.select(*keys, *[F.col(v).alias(f"_new_{v}") for v in values])
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(f"_new_{v}", f"_old_{v}").alias(v) for v in values])


def add_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and those distinct rows of `new` whose keys it lacks (insert or ignore); null keys are equal to none."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))
