"""Means, distances, axes and bindings of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from memlake.functions.columns import dot


#: Groups whose sums a task holds before it hands them on.
HELD = 10_000


def _folded(batches: Iterator[pa.RecordBatch], unit: bool) -> Iterator[tuple[object, int, np.ndarray, float]]:
    """(group, n, sum, sum of squares) of a task's vectors, a group and length each; handed on whenever many are held."""
    sums: dict = {}
    for batch in batches:
        own = batch.filter(pc.is_valid(batch.column("v")))
        lengths = pc.list_value_length(own.column("v")).to_numpy(zero_copy_only=False)
        for width in np.unique(lengths[lengths > 0]):
            part = own.filter(pa.array(lengths == width))
            m = part.column("v").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
            good = np.isfinite(m).all(1) & ((m != 0).any(1) if unit else True)
            m = m[good]
            if unit:
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
            groups = part.column("g").filter(pa.array(good)).dictionary_encode()
            at = groups.indices.fill_null(len(groups.dictionary)).to_numpy(zero_copy_only=False)
            names = [*groups.dictionary.to_pylist(), None]
            total, square, n = np.zeros((len(names), width)), np.bincount(at, np.einsum("ij,ij->i", m, m), len(names)), np.bincount(at, minlength=len(names))
            np.add.at(total, at, m)
            for i in np.flatnonzero(n):
                old = sums.get((names[i], width), (0, 0.0, 0.0))
                sums[names[i], width] = old[0] + int(n[i]), old[1] + total[i], old[2] + float(square[i])
        if len(sums) > HELD:
            yield from ((g, *x) for (g, _), x in sums.items())
            sums = {}
    yield from ((g, *x) for (g, _), x in sums.items())


def mean_vectors(df: DataFrame, group: str, vector: str, unit: bool = False) -> DataFrame:
    """(group, centroid, n, variance): the plain mean, or with `unit` that of the vectors scaled to length 1, of each group.

    variance is the mean squared distance to the centroid. Tasks fold their vectors, so a group may hold any share of the rows. A group whose
    vectors have several lengths has a row for each. Null and empty vectors, those with nulls, NaN or infinities and, with `unit`, those of
    length zero don't count; a null group is one.
    """
    kind = df.schema[group].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(_folded(batches, unit)):
            g, n, total, square = zip(*batch)
            yield pa.RecordBatch.from_arrays([pa.array(g, key), pa.array(n, pa.int64()), pa.array(list(total), pa.list_(pa.float64())), pa.array(square, pa.float64())], names=["g", "n", "total", "square"])

    def add(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        lists = table.column("total").combine_chunks()
        total = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1).sum(0)
        mean = total / n.sum()
        variance = max(0.0, table.column("square").to_numpy().sum() / n.sum() - mean @ mean)
        return pa.table({group: table.column("g").slice(0, 1), "centroid": pa.array([mean], pa.list_(pa.float64())), "n": pa.array([n.sum()], pa.int64()), "variance": pa.array([variance], pa.float64())})

    rows = df.select(F.col(group).alias("g"), F.col(vector).alias("v"))
    key = to_arrow_type(df.schema[group].dataType)
    parts = rows.mapInArrow(fold, f"g {kind}, n long, total array<double>, square double").withColumn("width", F.size("total"))
    return parts.groupBy("g", "width").applyInArrow(add, f"{group} {kind}, centroid array<double>, n long, variance double")


def batches_of(rows: Iterator, size: int = 1_000) -> Iterator[list]:
    """Lists of at most `size` of the rows."""
    while part := list(islice(rows, size)):
        yield part


def mean_pair_distance(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, distance): the mean of 1 - cosine over all pairs of a group, from the sum of its unit vectors: no pair is made."""
    means = mean_vectors(df, group, vector, unit=True).where("n > 1")
    total = dot(F.col("centroid"), F.col("centroid")) * F.col("n") * F.col("n")
    return means.select(group, (F.lit(1.0) - (total - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("distance"))


def principal_axes(df: DataFrame, group: str, vector: str, width: int, k: int = 4) -> DataFrame:
    """(group, axis, strength, direction): singular values and axes of each group's centred vectors of length `width`.

    Each axis is a unit vector whose largest component is positive. Tasks fold their rows into width x width moment matrices, which add up; only
    those, one for each group and task, meet.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for g, own in pdf[pdf[vector].map(lambda v: v is not None and len(v) == width)].groupby(group):
                m = np.stack(own[vector].map(np.asarray)).astype(float)
                m = m[np.isfinite(m).all(1)]
                n, s, q = sums.get(g, (0, 0, 0))
                sums[g] = n + len(m), s + m.sum(0), q + m.T @ m
        for g, (n, s, q) in sums.items():
            yield pd.DataFrame({group: [g], "n": [n], "s": [s], "q": [q.ravel()]})

    kind = df.schema[group].dataType.simpleString()
    parts = df.select(group, vector).mapInPandas(fold, f"{group} {kind}, n long, s array<double>, q array<double>")

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s, q = pdf["n"].sum(), np.sum(pdf["s"].map(np.asarray).tolist(), 0), np.sum(pdf["q"].map(np.asarray).tolist(), 0).reshape(width, width)
        values, vectors = np.linalg.eigh(q - np.outer(s, s) / max(1, n))
        values, vectors = np.sqrt(np.maximum(0, values))[::-1][:k], vectors.T[::-1][:k]
        vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
        return pd.DataFrame({group: pdf[group].iloc[0], "axis": range(1, len(values) + 1), "strength": values, "direction": list(vectors)})

    return parts.groupBy(group).applyInPandas(axes, f"{group} {kind}, axis int, strength double, direction array<double>")


def bind(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Circular convolution of rows."""
    return np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), n=a.shape[-1])


def unbind(c: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The approximate other factor of a binding with `a`."""
    return np.fft.irfft(np.fft.rfft(c) * np.conj(np.fft.rfft(a)), n=a.shape[-1])


def role_vector(seed: int, width: int) -> np.ndarray:
    """A fixed random vector whose spectrum has modulus 1, so that unbinding is exact."""
    phases = np.exp(2j * np.pi * np.random.Generator(np.random.PCG64(seed)).random(width // 2 + 1))
    phases[0] = 1
    if width % 2 == 0:
        phases[-1] = 1
    return np.fft.irfft(phases, n=width)


def bound_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """`df` with `composite`, the sum of left and right bound to two roles, and `recovered`, the cosine of left with what its role gives back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("x"))
            keep = pc.and_(pc.equal(sizes, pc.list_value_length(batch.column("y"))), pc.greater(sizes, 0)).fill_null(False)
            own = batch.filter(keep)
            widths = pc.list_value_length(own.column("x")).to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                part = own.filter(pa.array(widths == width))
                x, y = (part.column(c).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("x", "y"))
                one, two = role_vector(1, width), role_vector(2, width)
                c = bind(x, one) + bind(y, two)
                back = unbind(c, one)
                length = np.maximum(1e-12, np.linalg.norm(back, axis=1) * np.linalg.norm(x, axis=1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").cast(pa.int64()), pa.array(list(c), pa.list_(pa.float64())), pa.array(np.einsum("ij,ij->i", back, x) / length)], names=["id", "composite", "recovered"]
                )

    return df.select("id", F.col(left).alias("x"), F.col(right).alias("y")).mapInArrow(run, "id long, composite array<double>, recovered double")
