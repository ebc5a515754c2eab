"""Structured Streaming over append-only logs of parquet files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.latest import latest_wins
from memlake.plans.runtime import checkpoint_dir


def read_log(spark: SparkSession, path: str, files: int | None = 8) -> DataFrame:
    """A stream of the rows of a parquet table, a folder or one file, `files` files a batch (None: all that are available).

    The schema is that of the files there now. Files that the folder gains later are read by later batches.
    """
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = stream if files is None else stream.option("maxFilesPerTrigger", files)
    fs, at = _fs(spark, path)
    if fs.getFileStatus(at).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))


def _fs(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def closed_sessions(events: DataFrame, key: str, at: str, gap: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """(key, started, ended, n): sessions that a pause of `gap` ended; each comes out once, when the watermark of `delay` has passed its end.

    Events later than the watermark are dropped, so a closed log whose files aren't in the order of time has to be read as one batch;
    null times belong to no session.
    """
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    found = rows.groupBy(key, F.session_window("_at", gap)).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def windowed(events: DataFrame, at: str, width: str, kinds: str) -> DataFrame:
    """(start, kind, n): counts of each tumbling window of `width` and kind, over all rows however late (complete output)."""
    return events.groupBy(F.window(F.col(at).cast("timestamp"), width), F.col(kinds).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def drained(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """What the stream has written once it has read all that is available now.

    folder: where the state and the result are kept; a call with the same folder goes on where the last one, or the one that failed, stopped. A new
    folder in the shared checkpoint folder if None.
    """
    spark = stream.sparkSession
    base = folder or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    else:

        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        stream.writeStream.foreachBatch(replace).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


#: Batches whose changes are kept apart before they are folded into a new base.
FOLDED = 8


def latest_snapshot(stream: DataFrame, keys: list[str], order: list[Column], folder: str | None = None, folded: int = FOLDED) -> DataFrame:
    """The latest row of each key once all that is available now has been read.

    A row that arrives late counts by `order`, not by its arrival, and none is dropped. Each batch writes its own latest rows as a change; every
    `folded` batches the changes are folded into a new base, so that a batch rarely rewrites the whole. All that the next batch needs is in
    `folder`, as in `drained`: a batch that is run again writes the same files again, and a call with the same folder goes on.
    """
    spark = stream.sparkSession
    base = folder or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def upto(number: int) -> DataFrame | None:
        """The latest rows of the last base and the changes since, up to a batch."""
        bases = [n for n in _finished(spark, base, "base") if n <= number]
        last = max(bases, default=-1)
        paths = [f"{base}/base-{last}"] * bool(bases) + [f"{base}/change-{n}" for n in _finished(spark, base, "change") if last < n <= number]
        return latest_wins(spark.read.schema(stream.schema).parquet(*paths), keys, order) if paths else None

    def fold(batch: DataFrame, number: int) -> None:
        latest_wins(batch, keys, order).write.mode("overwrite").parquet(f"{base}/change-{number}")
        if number % folded == folded - 1:
            upto(number).write.mode("overwrite").parquet(f"{base}/base-{number}")

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    found = upto(1 << 62)
    return spark.createDataFrame([], stream.schema) if found is None else found


def _finished(spark: SparkSession, base: str, kind: str) -> list[int]:
    """Numbers of the tables `kind`-number under `base` that were written to the end."""
    fs, at = _fs(spark, base)
    if not fs.exists(at):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.rsplit("-", 1)[1]) for n in names if n.startswith(f"{kind}-") and fs.exists(path(f"{base}/{n}/_SUCCESS")))
