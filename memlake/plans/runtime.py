"""Cutting lineage into shared storage, and broadcasts behind a size check."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond it Spark plans a shuffle join.
BROADCAST_ROWS = 200_000


#: Tables that `written` has left in the shared folder.
_left: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`; a temporary one only for a local master that names none."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="spark-memlake-"))
        found = sc.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in shared storage; for small iterative state."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as a compressed table in the shared checkpoint folder and read back.

    Used where several branches read a costly intermediate: it survives the loss of executors and isn't computed twice.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/memlake-{name}-{uuid.uuid4().hex}"
    _left.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def appended(frames: Iterable[DataFrame], spark: SparkSession, schema: str, name: str) -> DataFrame:
    """All rows of `frames`, each written before the next is asked for, as one table like that of `written`."""
    path = f"{checkpoint_dir(spark)}/memlake-{name}-{uuid.uuid4().hex}"
    _left.append(path)
    spark.createDataFrame([], schema).write.parquet(path)
    for df in frames:
        df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the tables that `written` left; to be called once the results that read them are stored. Their number."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), len(_left)
    while _left:
        path = jvm.org.apache.hadoop.fs.Path(_left.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows (a limited count proves it), else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
