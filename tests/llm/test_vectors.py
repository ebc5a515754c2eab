"""Operators on vectors against brute force; nulls, unusable vectors, copies, ties, repeats, empty tables."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import cells as cells_module
from memlake.llm.cells import HEAVY, assign, by_length, fit_cells, leaders, unit
from memlake.llm.clusters import agglomerate, condense, linked_clusters, typical_members, ward, ward_centroids
from memlake.llm.collisions import WIDTH, Counter, Windows, pairs_of, top_neighbours
from memlake.llm.neardup import expand_vectors, similar_vectors
from memlake.llm.nearest import nearest_vectors, neighbour_pairs

DIRT = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [float("inf")] + [0.0] * 23), (905, [1.0] * 7), (None, [1.0] * 24)]


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def planted(seed=0, clusters=12, size=25, lone=150, d=24):
    """Unit vectors in tight clusters and alone, some scaled, some copied."""
    g = np.random.default_rng(seed)
    centres = g.standard_normal((clusters, d))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    m = np.repeat(centres, size, 0) + g.standard_normal((clusters * size, d)) * 0.08
    m = np.concatenate([m, g.standard_normal((lone, d))]).astype(np.float32)
    m[5] = m[4]
    m[6] = m[4] * 2
    m[7] = m[4] + np.float32(1e-3)
    return m


def frame(spark, m, extra=DIRT, repeat=True):
    data = [(i, v.tolist()) for i, v in enumerate(m)] + extra
    if repeat:
        data += data[:10]
    return spark.createDataFrame(data, "id long, vec array<float>").repartition(3)


def cosines(m):
    u = unit(m)
    return np.round(u @ u.T, 9)


def nearest(m, k, least):
    s, found = cosines(m), {}
    for i in range(len(m)):
        order = sorted((j for j in range(len(m)) if j != i and s[i, j] >= least), key=lambda j: (-s[i, j], j))[:k]
        found[i] = order
    return found


@pytest.mark.parametrize("least", [0.7, -1.0])
def test_nearest(spark, least):
    m = planted()
    found = defaultdict(list)
    for i, j, c in sorted(rows(nearest_vectors(frame(spark, m), 5, least)), key=lambda r: (r[0], -r[2], r[1])):
        found[i].append(j)
    want = nearest(m, 5, least)
    hit = sum(len(set(want[i]) & set(found[i])) for i in want)
    assert hit >= (0.97 if least > 0 else 0.9) * sum(map(len, want.values()))
    assert found[4] == want[4] and set(found) <= set(range(len(m)))
    assert max(map(len, found.values())) <= 5


def test_nearest_of_empty_and_unusable(spark):
    none = spark.createDataFrame([], "id long, vec array<float>")
    assert rows(nearest_vectors(none)) == []
    assert rows(nearest_vectors(spark.createDataFrame([x for x in DIRT if x[0] and x[0] < 905], "id long, vec array<float>"))) == []


def test_nearest_with_many_copies(spark):
    """A third of the rows share one vector: each still has its own result."""
    m = planted(3, clusters=4, size=20, lone=60)
    m = np.concatenate([np.repeat(m[:1], 70, 0), m])
    found = defaultdict(list)
    for i, j, _ in sorted(rows(nearest_vectors(frame(spark, m, [], False), 5, 0.7, heavy=16)), key=lambda r: (r[0], -r[2], r[1])):
        found[i].append(j)
    want = nearest(m, 5, 0.7)
    assert all(found[i] == want[i] for i in range(71))


def test_nearest_with_many_unusable_copies(spark):
    """Beyond the bound on copies, too, unusable vectors have no result and are nobody's neighbour."""
    m = planted(3, clusters=4, size=20, lone=60)
    bad = [[0.0] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [], None]
    extra = [(1_000 + 100 * k + i, v) for k, v in enumerate(bad) for i in range(HEAVY + 1)]
    clean = rows(nearest_vectors(frame(spark, m, [], False), 5, 0.7))
    assert clean and rows(nearest_vectors(frame(spark, m, extra, False), 5, 0.7)) == clean
    assert rows(nearest_vectors(frame(spark, m[:0], extra, False), 5, 0.7)) == []


def test_split_cells_lose_nothing(spark, monkeypatch):
    m = planted(5, clusters=2, size=150, lone=20)
    df = frame(spark, m, [], False)
    monkeypatch.setattr(cells_module, "BLOCK", 40)
    cells = fit_cells(df, block=40)
    assert max(s.max(initial=1) for ss in cells.splits.values() for s in ss) > 2
    groups = defaultdict(set)
    for g, _, i in rows(assign(df, cells), "g", "side", "id"):
        groups[g].add(i)
    assert max(map(len, groups.values())) < 150
    met = {frozenset((a, b)) for s in groups.values() for a in s for b in s if a < b}
    s = cosines(m)
    near = [frozenset((a, b)) for a in range(300) for b in range(a + 1, 300) if s[a, b] >= 0.8]
    assert all(p in met for p in near)


def met_pairs(assigned):
    groups = defaultdict(set)
    for g, _, i in rows(assigned, "g", "side", "id"):
        groups[g].add(i)
    return groups, {(a, b) for s in groups.values() for a in s for b in s if a < b}


def pairs_in_range(d, clusters=150, size=6, seed=11):
    """Small groups of neighbours of cosine about 0.85, and the pairs of 0.8 or more."""
    g = np.random.default_rng(seed)
    centres = g.standard_normal((clusters, d)) / np.sqrt(d)
    m = (np.repeat(centres, size, 0) + g.standard_normal((clusters * size, d)) * 0.42 / np.sqrt(d)).astype(np.float32)
    s = cosines(m)
    return m, [(int(a), int(b)) for a, b in np.argwhere(s >= 0.8) if a < b]


@pytest.mark.parametrize("pivots", [4_096, 9])
def test_many_cells_keep_neighbours_together(spark, monkeypatch, pivots):
    """Cells of a few vectors each, made by one set of pivots or by two: tables are added until the expected loss is small."""
    monkeypatch.setattr(cells_module, "MAX_PIVOTS", pivots)
    m, near = pairs_in_range(64)
    monkeypatch.setattr(cells_module, "leaders", lambda u, apart: (np.arange(len(u)), np.ones(len(u), int)))  # as when no cluster is sampled
    cells = fit_cells(frame(spark, m, [], False), 0.7, cell=40)
    tables = cells.tables[64]
    assert len(tables[0]) >= 40 and len(tables) >= 2 and (tables[0].second is not None) == (pivots == 9)
    groups, met = met_pairs(assign(frame(spark, m, [], False), cells))
    assert np.mean([p in met for p in near]) >= 1 - cells_module.LOSS
    assert len(met) < 0.5 * len(m) ** 2 / 2 and np.mean([len(s) for s in groups.values()]) < 120


def test_a_large_cluster_is_divided(spark):
    """A cluster that grows beyond a block isn't compared in full: its vectors are divided like all others."""
    g = np.random.default_rng(2)
    m = (g.standard_normal(32) + g.standard_normal((1_200, 32)) * 0.45).astype(np.float32)
    df = frame(spark, m, [], False)
    cells = fit_cells(df, 0.7, cell=100, block=300)
    assert len(cells.first[32]) == 0 and len(cells.tables[32][0]) >= 20
    groups, met = met_pairs(assign(df, cells))
    assert max(map(len, groups.values())) <= 600 and len(groups) >= 40


def test_counter():
    g = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 64, 65):
        sets = g.random((n, 3, 128)) < 0.7
        counter = Counter((3, 2))
        for one in sets:
            counter.add(np.packbits(one, axis=1, bitorder="little").view(np.uint64))
        for threshold in (1, n // 2 + 1, n):
            got = np.unpackbits(counter.at_least(threshold).view(np.uint8), axis=1, bitorder="little").view(bool)
            assert (got == (sets.sum(0) >= threshold)).all()


def test_counting_prunes():
    """Of vectors that lie apart few become candidates, although each is searched at the widest level."""
    u = unit(np.random.default_rng(4).standard_normal((3_000, 128))).astype(np.float32)
    w = Windows(u)
    bits = w.candidates(w.projected, WIDTH * np.sqrt(2 - 2 * 0.7))
    assert np.bitwise_count(bits).sum() < 0.01 * 3_000**2


def test_collisions_hold_all_close_vectors():
    m = planted(7, clusters=3, size=60, lone=300, d=64)
    u = unit(m).astype(np.float32)
    w = Windows(u)
    row, column = pairs_of(w.candidates(w.projected, WIDTH * np.sqrt(2 - 2 * 0.7)), len(u))
    found = set(zip(row.tolist(), column.tolist()))
    near = np.argwhere(u @ u.T >= 0.75)
    assert sum((a, b) in found for a, b in near.tolist()) >= 0.98 * len(near)
    assert len(found) < 0.5 * len(u) ** 2  # far ones are mostly left out
    ids = np.arange(len(u))
    got = defaultdict(list)
    for a, b, _ in zip(*(x.tolist() for x in top_neighbours(ids, m, ids, m, 3, 0.7))):
        got[a].append(b)
    want = nearest(m, 3, 0.7)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.97 * sum(map(len, want.values()))


def test_neighbour_pairs(spark):
    df = spark.createDataFrame([(2, 1, 0.9), (1, 2, 0.9), (3, 1, 0.8)], "id long, nbr long, cosine double")
    assert rows(neighbour_pairs(df)) == [(1, 2), (1, 3)]


def test_similar_vectors(spark):
    m = planted(9)
    df = frame(spark, m, DIRT + [(920, [0.0] * 24), (921, [float("nan")] * 24)])
    found = set(rows(expand_vectors(*similar_vectors(df, 0.97), df)))
    s = cosines(m)
    want = {(a, b) for a in range(len(m)) for b in range(a + 1, len(m)) if s[a, b] >= 0.97}
    assert (4, 5) in found and (4, 6) in found and (4, 7) in found
    assert found <= want and len(found) >= 0.97 * len(want)
    assert rows(expand_vectors(*similar_vectors(df.limit(0)), df.limit(0))) == []


def chains(n, length, cosine, lone, d=64, seed=23):
    """`n` chains of `length` vectors, each of the given cosine to the one before, and lone vectors; all in any order."""
    g = np.random.default_rng(seed)
    steps = [unit(g.standard_normal((n, d)))]
    for _ in range(length - 1):
        away = g.standard_normal((n, d))
        away -= np.einsum("ij,ij->i", away, steps[-1])[:, None] * steps[-1]
        steps.append(cosine * steps[-1] + np.sqrt(1 - cosine**2) * unit(away))
    m = np.concatenate([np.stack(steps, 1).reshape(-1, d), g.standard_normal((lone, d))]).astype(np.float32)
    order = g.permutation(len(m))
    place = np.empty(len(m), int)
    place[order] = np.arange(len(m))
    return m[order], place[: n * length].reshape(n, length)


def test_similar_vectors_lose_none_of_many(spark):
    """More vectors outside of clusters than were ever compared in full, all neighbours barely similar enough."""
    m, pairs = chains(12_000, 2, 0.9701, 0)
    df = frame(spark, m, [], False)
    assert set(rows(expand_vectors(*similar_vectors(df, 0.97), df))) == {(int(min(p)), int(max(p))) for p in pairs}


def components(m, least, smallest):
    s = cosines(m) >= least
    label = np.arange(len(m))
    while True:
        low = np.array([min(label[s[i]].min(), label[i]) for i in range(len(m))])
        if (low == label).all():
            break
        label = low
    names, counts = np.unique(label, return_counts=True)
    big = set(names[counts >= smallest].tolist())
    return {(int(a), i) for i, a in enumerate(label) if int(a) in big}


def test_linked_clusters(spark):
    m = planted(11)
    # a chain that no single pivot is near to
    a = np.linspace(0, 2.5, 30)
    chain = np.zeros((30, 24), np.float32)
    chain[:, 0], chain[:, 1] = np.cos(a), np.sin(a)
    m = np.concatenate([m, chain])
    found = set(rows(linked_clusters(frame(spark, m))))
    want = components(m, 0.7, 5)
    assert len(found & want) >= 0.98 * len(want) and len(found - want) <= 0.02 * len(want)
    assert rows(linked_clusters(frame(spark, m[:0], []))) == []
    few = planted(12, clusters=1, size=10, lone=0)[:4]
    assert rows(linked_clusters(frame(spark, few, [], False))) == []


def test_linked_clusters_with_many_copies(spark):
    m = planted(21, clusters=3, size=20, lone=40)
    m = np.concatenate([np.repeat(m[:1], 80, 0), np.repeat(m[-1:], 70, 0), m])
    assert set(rows(linked_clusters(frame(spark, m)))) == components(m, 0.7, 5)


def test_linked_clusters_lose_no_link_of_many(spark):
    """More vectors outside of clusters than were ever compared in full: one lost link splits a chain below the least size."""
    m, found = chains(800, 5, 0.71, 12_000, d=128)
    assert set(rows(linked_clusters(frame(spark, m, [], False)))) == {(int(min(c)), int(i)) for c in found for i in c}


def test_cluster_features_merge():
    m = unit(planted(13))
    one = np.ones(len(m))
    n, total, squares = condense(one, m, one, 400)
    assert n.sum() == len(m) and np.allclose(total.sum(0), m.sum(0)) and squares.sum() == len(m)
    half = [condense(one[k], m[k], one[k], 40) for k in (slice(0, 200), slice(200, None))]
    n, total, _ = condense(*(np.concatenate(x) for x in zip(*half)), 40)
    assert len(n) <= 40 and sorted(n)[-12] >= 24  # the clusters' leaves outweigh those of lone vectors
    centres = agglomerate(n, total)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1)


def test_ward_merges_nearest_first():
    x = np.array([[0.0], [0.1], [5.0], [5.3], [20.0]])
    order = [set(p[1:]) for p in sorted(ward(np.ones(5), x))]
    assert order[0] == {0, 1} and order[1] == {2, 3} and len(order) == 4


def test_ward_centroids_find_planted_clusters(spark):
    m = planted(15, clusters=8, size=40, lone=50)
    centres = ward_centroids(frame(spark, m), 256)[24]
    true = unit(np.stack([m[40 * c : 40 * c + 40].mean(0) for c in range(8)]))
    assert ((true @ centres.T).max(1) > 0.95).all()


def test_typical_members(spark):
    m = planted(17, clusters=3, size=30, lone=10)
    df = frame(spark, m)
    members = linked_clusters(df)
    got = rows(typical_members(members, df, 2))
    by = defaultdict(list)
    for key, i in rows(members):
        by[key].append(i)
    for key, size, rank, i, _ in got:
        own = unit(m[by[key]])
        order = sorted(zip(-np.round(own @ own.mean(0) / np.linalg.norm(own.mean(0)), 6), by[key]))
        assert size == len(by[key]) and order[rank - 1][1] == i


def test_helpers():
    import pyarrow as pa

    found = {m.shape[1]: ids.tolist() for ids, m in by_length(pa.array([1, 2, None, 4, 5]), pa.array([[1.0, 2.0], None, [1.0, 1.0], [0.0, 0.0], [3.0, None]], pa.list_(pa.float32())))}
    assert found == {2: [1]}
    at, covers = leaders(unit(np.array([[1, 0], [1, 0.1], [0, 1]], np.float32)), 0.6)
    assert at.tolist() == [0, 2] and covers.tolist() == [2, 1]


def test_clashing_names(spark):
    m = planted(19, clusters=2, size=10, lone=5)
    df = frame(spark, m, []).withColumn("g", F.lit(1)).withColumn("side", F.lit("x")).withColumn("digest", F.lit(None).cast("string"))
    assert len(rows(nearest_vectors(df.select("id", "vec"), 2, 0.7))) > 0
