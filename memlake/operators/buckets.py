"""Counts over time buckets on a grid without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.columns import bucket


def grid(counts: DataFrame, width: int) -> DataFrame:
    """Every bucket from the first to the last of `counts`."""
    ends = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.lit(width))).alias("bucket"))


def bucketed(df: DataFrame, ts: Column, width: int, measures: dict[str, Column]) -> DataFrame:
    """The measures of each bucket of `width` seconds; empty buckets between the first and the last have 0. Null times don't count."""
    counts = df.withColumn("bucket", bucket(ts, width)).where("bucket is not null").groupBy("bucket").agg(*[m.alias(k) for k, m in measures.items()])
    return grid(counts, width).join(counts, "bucket", "left").select("bucket", *[F.coalesce(k, F.lit(0)).alias(k) for k in measures])
