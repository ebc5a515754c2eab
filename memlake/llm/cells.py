"""Cells of near vectors, the unit of work of the search for nearest vectors. Some pairs share no cell; for all pairs there is `memlake.llm.links`.

Pivots come from a bounded sample; every vector is indexed. The pivots of the first table stand for dense clusters of bounded
size. A vector that is near to one of them has its neighbours in the same cell and enters only the cells of such pivots; any
other vector, those of large clusters too, also enters the cells of its PROBES nearest pivots in each of some further tables.

The further tables' pivots are drawn as densely as the vectors lie, and as many as keep cells at about CELL vectors, so that work grows in
proportion to the input. As two neighbours share a cell less often the more cells there are, the number of tables grows with them: it
is set so that the expected loss is at most LOSS, measured on the pivots themselves with sampled vectors and neighbours made for them. Few vectors are compared in full.

A cell that the sample shows to be larger than a block all the same (many vectors in the same direction) is split into blocks, and
each pair of its blocks is a group of its own, so that no task gets an unbounded group and no pair of a cell is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.batches import small
from memlake.plans.runtime import BROADCAST_ROWS, written

#: Vectors that pivots are fitted on at most (twice this number is the hard bound), whatever the input's size.
SAMPLE = 16_384
#: Vectors that a cell should have, and the most pivots of a set; where more cells are needed, a second set divides them.
CELL, MAX_PIVOTS = 3_000, 4_096
#: Vectors in one block of a split cell; also the largest cluster that makes a cell of its own.
BLOCK = 12_288
#: Cells that a vector outside of the first table's clusters enters in each further table. If no more than FEWEST cells are wanted there is
#: one cell for all these vectors, in as many blocks: they are compared in full.
PROBES, FEWEST = 2, 4
#: Share of neighbours outside of the first table's clusters that may be expected to share no cell, and the sampled vectors it is measured
#: with. Real neighbours lie where vectors are dense and share cells more often than the made ones.
LOSS, TRIED = 0.08, 2_048
#: Sample vectors at least this similar to a pivot become no pivot themselves, so that a dense cluster keeps one cell.
APART = 0.6
#: A vector stays in the first table if it is this similar to its pivot; there it also enters all cells of pivots at least
#: as similar as NEAR.
OWN, NEAR = 0.62, 0.5
#: Copies of one vector beyond which only their smallest ids are compared.
HEAVY = 64
#: The fewest and the most further tables.
TABLES, MAX_TABLES = 2, 16

CELL_SCHEMA = "g long, side byte, id long, vec binary"


def usable_vector(v: Column) -> Column:
    """Whether the array `v` is free of nulls, NaN and infinities and not all zero; as `usable` in Spark."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def without_copies(vectors: DataFrame, keep: int, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame | None]:
    """`vectors` (id, vec) without the copies of vectors that more than `heavy` rows share word for word, but for their `keep` smallest ids.

    Also (id, firsts) of the ids left out, firsts being those smallest ids in order; None if there are none. Copies of an unusable
    vector are no class: they stay in `vectors`, and whoever reads these drops them.
    """
    digest = F.xxhash64("vec")
    many = vectors.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy).select("digest")
    shared = vectors.select(digest.alias("digest"), "id", "vec").join(many, "digest", "left_semi")
    ids = shared.select("digest", "id", usable_vector(F.col("vec")).alias("usable")).distinct()
    # a rank below a constant is limited within each task before the shuffle
    ranked = ids.withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).where(F.col("r") <= keep)
    # the test comes after the ranking, so that it runs on the shared vectors alone and not on all
    classes = ranked.groupBy("digest").agg(F.array_sort(F.collect_list("id")).alias("firsts"), F.bool_and("usable").alias("usable"))
    firsts = written(classes.where("usable").drop("usable"), "firsts")
    classes = firsts.count()
    if not classes:
        return vectors, None
    digests = vectors.withColumn("digest", digest).join(F.broadcast(firsts) if classes <= BROADCAST_ROWS else firsts, "digest", "left")
    spare = F.col("firsts").isNotNull() & ~F.array_contains("firsts", F.col("id"))
    return digests.where(~spare).select("id", "vec"), digests.where(spare).select("id", "firsts").distinct()


def usable(matrix: np.ndarray) -> np.ndarray:
    """Rows free of NaN and infinities and not all zero."""
    return np.isfinite(matrix).all(1) & (matrix != 0).any(1)


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    wide = matrix.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)  # else tiny values would vanish when squared
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the usable vectors of each actual length in an Arrow batch."""
    keep = pc.and_(pc.is_valid(ids), pc.is_valid(vectors))
    ids, vectors = ids.filter(keep), vectors.filter(keep)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        if n == 0:
            continue
        at = pa.array(np.flatnonzero(lengths == n))
        own = vectors.take(at)
        values = own.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, n)
        good = usable(values)
        if good.any():
            yield ids.take(at).to_numpy(zero_copy_only=False)[good].astype(np.int64), values[good]


def leaders(units: np.ndarray, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of vectors that no earlier leader is as similar to as `apart`, and how many vectors each covers."""
    single = units.astype(np.float32)
    free, found, covers = np.ones(len(units), bool), [], []
    for start in range(0, len(units), 512):
        near = single[start : start + 512] @ single.T >= apart
        for i in range(start, start + len(near)):
            if free[i]:
                own = near[i - start]
                own[i] = True
                found.append(i)
                covers.append(int((own & free).sum()))
                free &= ~own
    return np.array(found, int), np.array(covers, int)


@dataclass
class Table:
    """Unit rows `main` and, if more cells are needed than these can make, `second`: a cell is a pair of one of each."""

    main: np.ndarray
    second: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.main) * (1 if self.second is None else len(self.second))

    def near(self, units: np.ndarray) -> np.ndarray:
        """The PROBES nearest cells of each row."""
        score = units @ self.main.T
        found = np.argpartition(-score, PROBES - 1, axis=1)[:, :PROBES] if len(self.main) > PROBES else np.tile(np.arange(len(self.main)), (len(units), 1))
        return found if self.second is None else found * len(self.second) + (units @ self.second.T).argmax(1)[:, None]


@dataclass
class Cells:
    """Of each vector length: `first`, unit rows that stand for clusters; `tables`, the further ones; for each table, the first one at
    place 0, `splits`, the number of blocks of its cells, and `bases`, the number of a cell's first group."""

    first: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, list[Table]] = field(default_factory=dict)
    splits: dict[int, list[np.ndarray]] = field(default_factory=dict)
    bases: dict[int, list[np.ndarray]] = field(default_factory=dict)
    rare_splits: int = 1

    def number(self) -> Cells:
        """Gives each pair of blocks of each cell its group number, `bases` being a cell's first."""
        start = 0
        for n in sorted(self.first):
            self.bases[n] = []
            for split in self.splits[n]:
                sizes = split * (split + 1) // 2
                self.bases[n].append(start + np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                start += int(sizes.sum())
        return self


def sampled_units(vectors: DataFrame, sample: int = SAMPLE) -> tuple[int, dict[int, np.ndarray]]:
    """Rows of `vectors` (id, vec), and unit vectors of a sample that hashes choose, by length."""
    total = vectors.count()
    base = 1 << 30
    share = base if total <= sample else max(1, base * sample // total)
    rows = vectors.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(base)) < share).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(2 * sample).toArrow()
    found: dict[int, list[np.ndarray]] = {}
    for batch in rows.to_batches():
        for _, m in by_length(batch.column("id"), batch.column("vec")):
            found.setdefault(m.shape[1], []).append(unit(m))
    return total, {n: np.concatenate(ms) for n, ms in found.items()}


def fit_cells(vectors: DataFrame, near: float = 0.7, tables: int = TABLES, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> Cells:
    """Cells for `vectors` (id, vec), fitted on a sample of at most 2 * `sample` vectors.

    near: the cosine from which on vectors count as neighbours; tables: the fewest further tables.
    """
    total, units = sampled_units(vectors, sample)
    drawn = sum(map(len, units.values()))
    cells = Cells(rare_splits=max(1, -(-3 * total // max(1, min(total, sample) * block))) if total > sample else 1)
    for n, u in units.items():
        rows = total * len(u) / max(1, drawn)
        single = u.astype(np.float32)
        if near < NEAR:  # neighbours may lie outside of a vector's cluster
            chosen = u[:0]
        else:
            at, covers = leaders(u, APART)
            chosen = u[at[np.argsort(-covers, kind="stable")[: min((covers > 1).sum(), MAX_PIVOTS)]]]
        chosen = chosen.astype(np.float32)
        scores = single @ chosen.T
        if len(chosen):  # large clusters are left to the further tables
            share = np.bincount(scores.argmax(1)[owned(scores)], minlength=len(chosen)) / len(u)
            chosen, scores = chosen[share * rows <= block], scores[:, share * rows <= block]
        free = single[~owned(scores)]
        cells.first[n], cells.tables[n] = chosen, _tables(free if len(free) else single, rows * len(free) / len(u), near, tables, cell)
        counts = [(scores >= NEAR).sum(0)] + [np.bincount(t.near(free).ravel(), minlength=len(t)) for t in cells.tables[n]]
        cells.splits[n] = [np.maximum(1, np.ceil(c / len(u) * rows / block)).astype(int) for c in counts]
        if len(cells.tables[n]) == len(cells.tables[n][0]) == 1:
            cells.splits[n][1] = np.maximum(FEWEST, cells.splits[n][1])
    return cells.number()


def _tables(free: np.ndarray, rows: float, near: float, least: int, cell: int) -> list[Table]:
    """As many tables over the unit rows `free`, a sample of `rows` vectors, as neighbours of cosine halfway from `near` to 1 need."""
    want = ceil(rows * PROBES / cell)
    if want <= FEWEST:
        return [Table(free[:1])]
    free = free[np.random.default_rng(3).permutation(len(free))]
    kept = min(TRIED, -(-len(free) // 4))  # these measure the loss and are no pivots
    tried, free = free[:kept], free[kept if len(free) > kept else 0 :]
    other = _made_neighbours(tried, (1 + near) / 2)
    main = min(want, MAX_PIVOTS, len(free))
    found: list[Table] = []
    lost = 1.0
    while len(found) < least or (lost > LOSS and len(found) < MAX_TABLES):
        drawn = free[np.random.default_rng(len(found) + 1).permutation(len(free))]
        second = drawn[main : main + -(-want // main)] if want > MAX_PIVOTS else None
        found.append(Table(drawn[:main], second if second is not None and len(second) > 1 else None))
        a, b = found[-1].near(tried), found[-1].near(other)
        met = (a[:, :, None] == b[:, None, :]).any((1, 2)).mean()
        lost *= 1 - min(met, 0.999)
    return found


def _made_neighbours(units: np.ndarray, cosine: float) -> np.ndarray:
    """A unit row of the given cosine for each row, in a random direction."""
    noise = np.random.default_rng(4).standard_normal(units.shape)
    noise -= np.einsum("ij,ij->i", noise, units)[:, None] * units
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    return (cosine * units + np.sqrt(1 - cosine * cosine) * noise).astype(np.float32)


def owned(scores: np.ndarray) -> np.ndarray:
    """Rows of scores against the first table's pivots that lie in a pivot's cluster."""
    return scores.max(1, initial=-1.0) >= OWN


def _pair(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return j * (j + 1) // 2 + i


def assign(vectors: DataFrame, cells: Cells) -> DataFrame:
    """A row (g, side, id, vec) for each group that a vector of `vectors` (id, vec) enters; vec is the raw float32 bytes.

    Within a split cell a vector enters each pair of blocks that has its own block; side tells which of the two is its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2_000):
            for ids, m in by_length(batch.column("id"), batch.column("vec")):
                n = m.shape[1]
                u = unit(m).astype(np.float32)
                raw = m.tobytes()
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                known = n in cells.first
                scores = u @ cells.first[n].T if known else None
                free = np.flatnonzero(~owned(scores)) if known else None
                for t in range(len(cells.splits[n]) if known else 1):
                    if not known:  # a length that the sample hasn't met
                        inside = np.arange(len(ids))
                        split, base = np.full(len(ids), cells.rare_splits), np.full(len(ids), -(n + 1) * 1_000_000)
                    else:
                        if t == 0:
                            inside, own = np.nonzero(scores >= NEAR)
                        else:
                            own = cells.tables[n][t - 1].near(u[free])
                            inside, own = np.repeat(free, own.shape[1]), own.ravel()
                        split, base = cells.splits[n][t][own], cells.bases[n][t][own]
                    if not len(inside):
                        continue
                    block = (mixed[inside] % split.astype(np.uint64)).astype(np.int64)
                    for other in range(int(split.max(initial=1))):
                        at = np.flatnonzero(split > other)
                        low, high = np.minimum(block[at], other), np.maximum(block[at], other)
                        vec = pa.array([raw[4 * n * i : 4 * n * (i + 1)] for i in inside[at]], pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(base[at] + _pair(low, high)), pa.array((block[at] > other).astype(np.int8)), pa.array(ids[inside[at]]), vec], names=["g", "side", "id", "vec"]
                        )

    return vectors.mapInArrow(run, CELL_SCHEMA)


def per_group(assigned: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """`work(ids, matrix, other ids, other matrix)` of each group; both sides are the same arrays if the group isn't a pair of blocks."""

    def side(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, first = np.unique(table.column("id").to_numpy(), return_index=True)  # repeats of an id count once
        raw = table.column("vec").take(pa.array(first)).to_pylist()
        return ids, np.frombuffer(b"".join(raw), np.float32).reshape(len(ids), -1)

    def run(table: pa.Table) -> pa.Table:
        sides = table.column("side").to_numpy()
        left = side(table.filter(pa.array(sides == 0))) if (sides == 0).any() else None
        right = side(table.filter(pa.array(sides == 1))) if (sides == 1).any() else None
        if left is None or right is None:
            left = right = left or right
        return work(*left, *right)

    return assigned.groupBy("g").applyInArrow(run, schema)
