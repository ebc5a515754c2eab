"""Windows over the sentences of long texts, and pages bounded by size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.plans.runtime import written

SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?](?!\s|$)[^.!?\n]*)*(?:[.!?]+|\n|$)\s*", re.S)


def sentence_windows(texts: DataFrame, most: int = 1_024) -> DataFrame:
    """(id, start, stop): stretches of whole sentences of at most `most` characters, each beginning with the last sentence of the one before.

    `texts` is (id, text). The overlap is left out where it wouldn't fit; a longer sentence is a window of its own. The windows cover the
    whole text; a null or empty one has none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"]):
                ends = sorted({m.end() for m in SENTENCE.finditer(text or "") if m.end()} | ({len(text)} if text else set()))
                begin, last = 0, 0  # of the open window, and of its last sentence
                for k, end in enumerate(ends):
                    start = ends[k - 1] if k else 0
                    if start > begin and end - begin > most:
                        out.append((i, begin, start))
                        begin = last if end - last <= most else start
                    last = start
                if ends:
                    out.append((i, begin, ends[-1]))
            yield pd.DataFrame(out, columns=["id", "start", "stop"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.where("text is not null").mapInPandas(run, f"id {kind}, start int, stop int")


def _spanning(ordered: DataFrame) -> DataFrame:
    """Rows of the groups that lie in several of the range partitions `part`; as these are contiguous, the groups are fewer than the partitions."""
    spans = ordered.groupBy(F.col("g").alias("_g")).agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("_g")
    return ordered.join(F.broadcast(spans), F.col("g").eqNullSafe(F.col("_g")), "left_semi")


def _begun(ordered: DataFrame, begins: DataFrame) -> DataFrame:
    """`ordered` with what `begins` (g, part, ...) says of each stretch of a spanning group, null for others; fewer than two stretches a partition."""
    own = begins.withColumnsRenamed({"g": "_g", "part": "_part"})
    return ordered.join(F.broadcast(own), F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part")), "left").drop("_g", "_part")


def budget_pages(rows: DataFrame, group: str, item: str, size: str, budget: int) -> DataFrame:
    """(group, item, page): items in order, each on the open page while it fits `budget` (at least 1), else on a new one.

    An item larger than the budget has a page of its own; null sizes count 0, null items come first; items should be unique within a group. The group
    is text, the item a long. A group may span any number of tasks: rows are ordered by range, each task tells for every possible fill of the
    page that is open when its stretch of a group begins how many pages it closes and what fill it leaves (budget + 1 states), these
    few states are chained, and a second pass numbers the pages.
    """
    ordered = rows.select(F.col(group).alias("g"), F.col(item).cast("long").alias("i"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("s"))
    ordered = ordered.repartitionByRange("g", "i").sortWithinPartitions("g", "i").withColumn("part", F.spark_partition_id())
    ordered = written(ordered, "ordered")

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", na_position="first")
        closed, fill = _run(pdf["s"].to_numpy(), np.arange(budget + 1), budget)[:2]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "part": [pdf["part"].iloc[0]], "closed": [closed.tolist()], "fill": [fill.tolist()]})

    stretches = _spanning(ordered).groupBy("g", "part").applyInPandas(states, "g string, part int, closed array<long>, fill array<long>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        page, fill, out = 0, 0, []
        for part, closed, left in sorted(zip(pdf["part"], pdf["closed"], pdf["fill"]), key=lambda r: r[0]):
            out.append((pdf["g"].iloc[0], part, page, fill))
            page, fill = page + int(closed[fill]), int(left[fill])
        return pd.DataFrame(out, columns=["g", "part", "page", "fill"])

    begins = stretches.groupBy("g").applyInPandas(chain, "g string, part int, page long, fill long")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", na_position="first")
        pages = _run(pdf["s"].to_numpy(), np.array([pdf["fill"].iloc[0]]), budget)[2]
        return pd.DataFrame({group: pdf["g"], item: pdf["i"], "page": pdf["page"].iloc[0] + pages})

    met = _begun(ordered, begins).select("g", "part", "i", "s", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("fill", F.lit(0)).alias("fill"))
    return met.groupBy("g", "part").applyInPandas(number, f"{group} string, {item} long, page long")


def leader_runs(rows: DataFrame, group: str, at: str, item: str, width: int) -> DataFrame:
    """(group, item, run): rows in order of `at` (whole seconds) and item, in runs of at most `width` seconds from a run's first row.

    The group is text, `at` and the item are longs; items should be unique; rows without a time have no run. As in `budget_pages` a group may span any number of tasks: each
    tells how many runs it opens and how old its last run is for every possible age (width + 1 states, or none) of the run that is open before it.
    """
    ordered = rows.select(F.col(group).alias("g"), F.col(at).cast("long").alias("at"), F.col(item).cast("long").alias("i")).where("at is not null")
    ordered = written(ordered.repartitionByRange("g", "at", "i").sortWithinPartitions("g", "at", "i").withColumn("part", F.spark_partition_id()), "ordered")

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["at"].to_numpy())
        opened, age = _ages(times, np.arange(width + 1), width)[:2]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "part": [pdf["part"].iloc[0]], "first": [times[0]], "last": [times[-1]], "opened": [opened.tolist()], "age": [age.tolist()]})

    stretches = _spanning(ordered).groupBy("g", "part").applyInPandas(states, "g string, part int, first long, last long, opened array<long>, age array<long>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        run, age, last, out = 0, 0, None, []
        for r in pdf.sort_values("part").itertuples():
            age = 0 if last is None else age + r.first - last
            if age > width:
                run, age = run + 1, 0
            out.append((r.g, r.part, run, age))
            run, age, last = run + int(r.opened[age]), int(r.age[age]), r.last
        return pd.DataFrame(out, columns=["g", "part", "run", "age"])

    begins = stretches.groupBy("g").applyInPandas(chain, "g string, part int, run long, age long")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "i"])
        return pd.DataFrame({group: pdf["g"], item: pdf["i"], "run": pdf["run"].iloc[0] + _ages(pdf["at"].to_numpy(), np.array([pdf["age"].iloc[0]]), width)[2]})

    met = _begun(ordered, begins).select("g", "part", "at", "i", F.coalesce("run", F.lit(0)).alias("run"), F.coalesce("age", F.lit(0)).alias("age"))
    return met.groupBy("g", "part").applyInPandas(number, f"{group} string, {item} long, run long")


def _ages(times: np.ndarray, ages: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs opened after the first row and the age of the last one, for each age of the run at the first row, and the run of each row for the first of these."""
    before, own = np.zeros(len(ages), np.int64), np.arange(len(ages))
    age, opened, runs = ages.astype(np.int64), np.zeros(len(ages), np.int64), np.zeros(len(times), np.int64)
    for at, gap in enumerate(np.diff(times).tolist(), 1):
        age = age + gap
        over = age > width
        opened += over
        age[over] = 0
        runs[at] = before[0] + opened[own[0]]
        if len(age) > 1 and at % 16 == 15:
            before += opened[own]
            age, same = np.unique(age, return_inverse=True)
            own, opened = same[own], np.zeros(len(age), np.int64)
    return before + opened[own], age[own], runs


def _run(sizes: np.ndarray, fills: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pages closed and the fill left for each fill to begin with, and the page of each item for the first of these.

    An open page of fill 0 holds nothing and is never closed for an item. Fills that have become equal go on as one.
    """
    before, own = np.zeros(len(fills), np.int64), np.arange(len(fills))
    fill, closed, pages = np.minimum(fills, budget).astype(np.int64), np.zeros(len(fills), np.int64), np.empty(len(sizes), np.int64)
    for at, size in enumerate(np.minimum(sizes, budget).tolist()):
        over = (fill > 0) & (fill + size > budget)
        closed += over
        fill = np.where(over, size, fill + size)
        pages[at] = before[0] + closed[own[0]]
        if len(fill) > 1 and at % 16 == 15:
            before += closed[own]
            fill, same = np.unique(fill, return_inverse=True)
            own, closed = same[own], np.zeros(len(fill), np.int64)
    return before + closed[own], fill[own], pages
