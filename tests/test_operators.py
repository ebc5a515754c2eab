"""Core operators on small inputs: nulls, ties, repeats, empty tables, clashing names."""

import datetime as dt
import os

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from memlake.functions import columns
from memlake.functions.columns import cosine, ladder, stem, time_code
from memlake.operators import graph, orphans, ranking
from memlake.operators.buckets import bucketed
from memlake.operators.latest import add_missing, complete, latest_wins, upsert, without
from memlake.operators.lexical import bm25, contrastive_terms
from memlake.operators.orphans import Reference, bloom_filter, find_orphans, orphan_report, text_key
from memlake.operators.search import block_search, cosine_histogram
from memlake.operators.vectors import bind, bound_pairs, mean_pair_distance, mean_vectors, principal_axes, role_vector, unbind
from memlake.operators.windows import budget_pages, leader_runs, sentence_windows
from memlake.plans import runtime
from memlake.streaming.event_log import closed_sessions, drained, latest_snapshot, read_log, windowed

D = dt.datetime


def reference(children, parents):
    return Reference("c.k", children, F.col("k"), F.col("at"), "p", parents, F.col("id"), F.col("at"))


def test_orphans(spark):
    children = spark.createDataFrame(
        [(" A ", D(2025, 1, 5)), ("b", D(2025, 1, 1)), ("b", D(2025, 3, 1)), ("gone", D(2025, 2, 1)), ("gone", D(2025, 2, 1)), ("", D(2025, 2, 1)), (None, D(2025, 2, 1)), ("x", None), ("a", None), ("n", D(2025, 1, 1))],
        "k string, at timestamp",
    )
    parents = spark.createDataFrame([("a", D(2025, 1, 1), 1), ("B", D(2025, 2, 1), 2), ("b", D(2025, 2, 9), 2), (None, D(2025, 1, 1), 3), ("n", None, 4)], "id string, at timestamp, key int")
    gone = spark.createDataFrame([("p", "gone"), ("other", "x"), ("p", None)], "target string, key string")
    found = find_orphans([reference(children, parents)], gone)
    assert rows(found) == sorted([("c.k", "2025-01", "b", "late"), ("c.k", "2025-02", "gone", "deleted"), ("c.k", "2025-02", "", "missing"), ("c.k", None, "x", "missing")], key=repr)
    assert rows(orphan_report(found))[0][3] == 1


def test_orphans_of_empty_tables(spark):
    children = spark.createDataFrame([("a", D(2025, 1, 5))], "k string, at timestamp")
    none = spark.createDataFrame([], "id string, at timestamp")
    gone = spark.createDataFrame([], "target string, key string")
    assert rows(find_orphans([reference(children, none)], gone)) == [("c.k", "2025-01", "a", "missing")]
    assert rows(find_orphans([reference(children.limit(0), none)], gone)) == []


@pytest.mark.parametrize("parts", [1, 8])
def test_orphans_of_many_keys(spark, monkeypatch, parts):
    """A filter in several parts, or in a shuffle, proves as many orphans as one that is broadcast whole."""
    children = spark.range(2_000).select((F.col("id") * 3).cast("string").alias("k"), F.lit(D(2025, 1, 1)).alias("at"))
    parents = spark.range(3_000).select("id", F.lit(D(2024, 1, 1)).alias("at"))
    gone = spark.createDataFrame([("p", "5997")], "target string, key string")
    whole = rows(find_orphans([reference(children, parents)], gone))
    assert len(whole) == 1_000
    monkeypatch.setattr(orphans, "MAX_BLOCKS", 100)
    monkeypatch.setattr(orphans, "MAX_PARTS", parts)
    assert rows(find_orphans([reference(children, parents)], gone)) == whole
    keys = lambda df, c: df.select(F.lit("p").alias("target"), text_key(F.col(c)).alias("key"))
    found = orphans.probed(keys(children, "k"), keys(parents, "id"), 3_000)
    assert found.count() == 2_000 and found.where("not passes").count() >= 900
    assert found.where("not passes").join(keys(parents, "id"), "key", "left_semi").count() == 0


def test_bloom_filter_is_bounded(spark):
    parents = spark.range(10_000).select(F.lit("p").alias("target"), text_key(F.col("id")).alias("key"))
    assert bloom_filter(parents, 64).count() == 64


def test_latest(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (None, 1, "d"), (None, 2, "e")], "k int, v int, x string")
    assert rows(latest_wins(df, ["k"], [F.desc("v"), F.asc("x")])) == [(1, 7, "b"), (None, 2, "e")]
    assert rows(latest_wins(df.limit(0), ["k"], [F.desc("v")])) == []


def test_sets(spark):
    a, b = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double"), spark.createDataFrame([(2, 5.0), (3, 6.0), (3, 6.0), (1, None)], "k int, v double")
    assert rows(upsert(a, b.distinct(), ["k"], ["v"])) == [(1, 1.0), (2, 5.0), (3, 6.0)]
    assert rows(add_missing(a, b, ["k"])) == [(1, 1.0), (2, None), (3, 6.0)]
    assert rows(without(a, b, ["k"])) == []
    children = spark.createDataFrame([(1, True), (1, False), (2, False)], "k int, bad boolean")
    assert rows(complete(a, children, "k", F.col("bad")), "k") == [(2,)]


def test_buckets(spark):
    df = spark.createDataFrame([(5,), (7,), (31,), (None,), (-3,)], "t long")
    assert rows(bucketed(df, F.col("t"), 10, {"n": F.count(F.lit(1))})) == sorted([(-10, 1), (0, 2), (10, 0), (20, 0), (30, 1)], key=repr)
    assert rows(bucketed(df.limit(0), F.col("t"), 10, {"n": F.count(F.lit(1))})) == []
    assert [r[0] for r in spark.createDataFrame([(2_400,), (2_401,), (10**9,)], "s long").select(ladder(F.col("s"))).collect()] == [60, 120, 31_536_000]


def test_columns(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    assert [None if r[0] is None else round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, None, None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in ("running", "merging", "stories", "class", "cats", "as")], "w string").select(stem(F.col("w"))).collect()] == ["run", "merg", "story", "class", "cat", "as"]
    code = spark.createDataFrame([(12_345,)], "t long").select(time_code(F.col("t"))).first()[0]
    assert len(code) == 14 and abs(sum(x * x for x in code) - 1) < 1e-12


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "green tree"), (4, None), (5, ""), (6, "red fox red")], "doc_id long, text string")
    cues = spark.createDataFrame([(9, "RED, zebra"), (8, None), (7, "")], "cue_id long, text string")
    found = rows(bm25(docs, cues), "cue_id", "doc_id", "rank")
    assert found == [(9, 1, 1), (9, 6, 2)]
    assert rows(bm25(docs.limit(0), cues)) == [] and rows(bm25(docs, cues.limit(0))) == []


def test_bm25_in_blocks(spark):
    """Blocks of cues, ties and statistics as a loop over all documents gives them."""
    g = np.random.default_rng(6)
    word = lambda n: " ".join(f"w{int(x)}" for x in g.zipf(1.5, n) % 40)
    texts, asked = [word(int(n)) for n in g.integers(1, 30, 200)], [word(5) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    cues = spark.createDataFrame(list(enumerate(asked)), "cue_id long, text string")
    lists, n = [t.split() for t in texts], len(texts)
    mean, want = np.mean([len(x) for x in lists]), []
    for c, cue in enumerate(asked):
        scores = []
        for i, x in enumerate(lists):
            own = set(cue.split()) & set(x)
            idf = {t: max(1e-6, np.log((n - sum(t in y for y in lists) + 0.5) / (sum(t in y for y in lists) + 0.5))) for t in own}
            if own:
                scores.append((-round(sum(idf[t] * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in own), 6), i))
        want += [(c, i, r + 1) for r, (_, i) in enumerate(sorted(scores)[:10])]
    for block in (5, 100):
        assert rows(bm25(docs, cues, block=block), "cue_id", "doc_id", "rank") == sorted(want, key=repr)


def test_block_search(spark):
    g = np.random.default_rng(0)
    m = g.standard_normal((60, 8)).astype(np.float32)
    m[7] = m[3]
    data = [(i, m[i].tolist()) for i in range(60)] + [(90, None), (91, []), (92, [0.0] * 8), (93, [float("nan")] * 8), (94, [1.0] * 5)]
    df = spark.createDataFrame(data, "id long, vec array<float>")
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    want = []
    for q in (0, 3, 30):
        order = sorted((x for x in range(60) if x != q), key=lambda x: (-s[q, x], x))[:4]
        want += [(q, x, r + 1) for r, x in enumerate(order)]
    asked = df.where("id in (0, 3, 30, 92)")
    for block in (2, 100):
        assert rows(block_search(df, asked, 4, 8, block=block), "query_id", "id", "rank") == sorted(want, key=repr)
    assert cosine_histogram(df, asked, 8).agg(F.sum("pairs")).first()[0] == 3 * 59
    assert rows(block_search(df.limit(0), asked.limit(0), 4, 8)) == []


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5), (None, 4), (3, 2)] + [(i, i + 1) for i in range(20, 60)], "src long, dst long")
    found = dict(rows(graph.connected_components(e)))
    assert found[3] == 1 and found[11] == 10 and found[60] == 20 and 5 not in found and 4 not in found
    assert rows(graph.connected_components(e.limit(0))) == []
    w = spark.createDataFrame([(1, 2, 2.0), (1, 3, 1.0), (1, 4, 0.1), (2, 3, 0.5)], "src long, dst long, weight double")
    assert [(a, b, round(x, 6)) for a, b, x in rows(graph.homeostatic(w))] == [(1, 2, 0.645161), (2, 3, 0.5)]
    assert rows(graph.strongest(w, 1), "src", "dst") == [(1, 2), (2, 3)]
    seeds = spark.createDataFrame([(1, 1.0)], "node long, activation double")
    p = graph.moving_average(w.where("src = 1"), w.where("src = 2"), 0.5)
    assert rows(p) == [(1, 2, 1.0), (1, 3, 0.5), (1, 4, 0.05), (2, 3, 0.25)]
    assert {n: round(a, 6) for n, a in rows(graph.spread(seeds, w))} == {1: 1.0, 2: 1.2, 3: 0.96, 4: 0.06}
    assert [(n, h, round(a, 6)) for n, h, a in rows(graph.reached(seeds, w))] == [(2, 1, 1.2), (3, 1, 0.6), (4, 1, 0.06)]
    hubs = {n: (h, a) for n, h, a in rows(graph.hubs_and_authorities(w, 5))}
    assert hubs[1][0] > hubs[2][0] and hubs[4][0] == 0 and hubs[1][1] == 0


def test_ranking(spark):
    df = spark.createDataFrame([([5, 3, 9, 2],), ([50, 1],), ([],)], "s array<bigint>")
    assert [r[0] for r in df.select(ranking.packed(F.col("s"), 10)).collect()] == [[1, 2, 4], [1], []]
    pool = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.8, [0.0, 1.0])], "q long, i long, s double, v array<double>")
    assert rows(ranking.mmr(pool, "q", "i", "s", "v", 2), "i", "place") == [(1, 1), (3, 2)]
    words = spark.createDataFrame([(list("abcbdab"), list("bdcaba")), ([], list("ab")), (list("ab"), [])], "a array<string>, b array<string>")
    assert [r[0] for r in words.select(ranking.lcs_length(F.col("a"), F.col("b"))).collect()] == [4, 0, 0]
    z = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (2, 1.0), (2, None), (None, 4.0)], "g int, x double")
    assert [None if r[0] is None else round(r[0], 6) for r in ranking.pool_z(z, "g", "x").orderBy("g", F.col("x").asc_nulls_last()).select("z").collect()] == [0.0, -1.224745, 0.0, 1.224745, 0.0, 0.0]
    a = spark.createDataFrame([(1, 0.9), (1, 0.5), (2, 0.7), (2, None)], "g int, p double")
    assert rows(ranking.admitted(a, "g", "p", 0.6, 0.8)) == [(1, 0.9)]


def test_vectors(spark):
    g = np.random.default_rng(1)
    m = g.standard_normal((40, 6)).astype(np.float32)
    df = spark.createDataFrame([(i % 2, m[i].tolist()) for i in range(40)] + [(0, None)], "g int, v array<float>")
    one = m[::2].astype(float)
    c, n, var = next((r["centroid"], r["n"], r["variance"]) for r in mean_vectors(df, "g", "v").collect() if r["g"] == 0)
    assert np.allclose(c, one.mean(0)) and n == 20 and abs(var - ((one - one.mean(0)) ** 2).sum(1).mean()) < 1e-9
    u = one / np.linalg.norm(one, axis=1)[:, None]
    want = (1 - (u @ u.T)[np.triu_indices(20, 1)]).mean()
    assert abs(dict(rows(mean_pair_distance(df, "g", "v")))[0] - want) < 1e-9
    axes = sorted(r for r in rows(principal_axes(df, "g", "v", 6)) if r[0] == 0)
    _, want, directions = np.linalg.svd(one - one.mean(0))
    assert np.allclose([r[2] for r in axes], want[:4])
    assert all(abs(abs(np.dot(r[3], x)) - 1) < 1e-9 and max(r[3], key=abs) > 0 for r, x in zip(axes, directions))
    mixed = spark.createDataFrame([(None, [1.0, 3.0]), (None, [3.0, 3.0]), (None, [1.0]), (7, [float("nan"), 1.0]), (7, []), (7, [0.0, 0.0])], "g int, v array<float>")
    assert sorted(((r.g, r.centroid, r.n, r.variance) for r in mean_vectors(mixed, "g", "v").collect()), key=repr) == [(7, [0.0, 0.0], 1, 0.0), (None, [1.0], 1, 0.0), (None, [2.0, 3.0], 2, 1.0)]
    assert 7 not in {r.g for r in mean_vectors(mixed, "g", "v", unit=True).collect()} and rows(mean_vectors(mixed.limit(0), "g", "v")) == []
    pairs = bound_pairs(spark.createDataFrame([(1, [1.0, 2.0, 0.5], [0.0, 1.0, 1.0]), (2, [1.0], None), (3, [1.0], [1.0, 2.0]), (4, [], [])], "id long, a array<double>, b array<double>"), "a", "b")
    assert rows(pairs, "id") == [(1,)]


def test_binding():
    x, r = np.random.default_rng(2).standard_normal(64), role_vector(1, 64)
    assert np.allclose(unbind(bind(x, r), r), x)


def test_sentence_windows(spark):
    texts = ["One. Two! Three? Four.", "", None, "x" * 50, "v1.2 is out.\nNext line " + "y" * 30 + ". End", "no end"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for i, a, b in sorted(rows(sentence_windows(df, 12))):
        got.setdefault(i, []).append((a, b))
    assert set(got) == {0, 3, 4, 5} and got[3] == [(0, 50)] and got[5] == [(0, 6)]
    assert got[0] == [(0, 10), (5, 17), (10, 22)]
    for i, spans in got.items():
        assert spans[0][0] == 0 and spans[-1][1] == len(texts[i])
        assert all(a[0] < b[0] <= a[1] < b[1] for a, b in zip(spans, spans[1:]))


def greedy(sizes, budget):
    page, fill, out = 0, 0, []
    for size in sizes:
        size = min(size or 0, budget)
        if fill > 0 and fill + size > budget:
            page, fill = page + 1, 0
        fill += size
        out.append(page)
    return out


def test_pages(spark):
    """As a loop over each group gives them, over any number of tasks; no page exceeds the budget but for a lone large item."""
    g = np.random.default_rng(3)
    sizes = {"a": [5, 6, 1], "b": [30, 1, 0, 10], "c": [None, 10], "hot": g.integers(0, 9, 3_000).tolist()}
    df = spark.createDataFrame([(k, i, s) for k, own in sizes.items() for i, s in enumerate(own)], "g string, i long, s int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rows(budget_pages(df, "g", "i", "s", 10))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == sorted([(k, i, p) for k, own in sizes.items() for i, p in enumerate(greedy(own, 10))], key=repr)
    assert rows(budget_pages(df.limit(0), "g", "i", "s", 10)) == []


def test_leader_runs(spark):
    """Runs end a fixed time after their first row, over any number of tasks."""
    g = np.random.default_rng(4)
    data = [(k, i, int(t)) for k, n in (("a", 2_000), ("b", 3), ("c", 200)) for i, t in enumerate(np.cumsum(g.integers(0, 9, n)))]
    want = []
    for k in "abc":
        lead, run = None, 0
        for _, i, t in sorted((r for r in data if r[0] == k), key=lambda r: (r[2], r[1])):
            if lead is None:
                lead = t
            elif t - lead > 30:
                lead, run = t, run + 1
            want.append((k, i, run))
    df = spark.createDataFrame(data + [("a", 9_999, None)], "g string, i long, at long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows(leader_runs(df, "g", "at", "i", 30)) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows(leader_runs(df.limit(0), "g", "at", "i", 30)) == []


def test_text_columns(spark):
    one = lambda f, kind, *values: [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]
    assert one(columns.elapsed_seconds, "string", "05:07", "1:00:00", "2-03:04:05", "5", "", None, "a:10") == [307, 3_600, 183_845, None, None, None, None]
    assert one(columns.offset_time, "string", "2025-01-01T00:00:10Z", "2025-01-01 02:00:00+02:00", "2025-01-01T00:00:10", "2025-13-01T00:00:10Z", "", None) == [1_735_689_610, 1_735_689_600, None, None, None, None]
    assert one(columns.identifiers, "string", "parserGemosa snake_case_x x9 a", "", None) == [["parserGemosa", "parser", "Gemosa", "snake_case_x", "snake", "case", "x9"], [], None]
    assert one(columns.folded_tokens, "string", "Größe Recherchen", "日本語 x", "", None) == [["große", "recher"], ["x", "日本", "本語"], [], None]
    assert one(columns.facets, "string", '{"a": 1, "b": "x"}', "{broken", "", None, "[1]") == [{"a": "1", "b": "x"}, None, None, None, None]
    assert one(lambda c: columns.canonical_json(columns.facets(c)), "string", '{"b": "x", "a": "1"}', "{}", None) == ['{"a":"1","b":"x"}', "{}", None]
    maps = spark.createDataFrame([({"a": "1"}, {"a": "1", "b": "2"}), ({"a": "1"}, {"a": "2"}), ({"c": "1"}, {"a": "2"}), (None, {"a": "2"}), ({}, {})], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in maps.select(columns.compatible(F.col("x"), F.col("y"))).collect()] == [True, False, True, True, True]
    need = F.create_map(F.lit("a"), F.array(F.lit("1"), F.lit("3")))
    assert [r[0] for r in maps.select(columns.meets(need, F.col("y"))).collect()] == [True, False, False, False, False]


def test_kept_apart(spark):
    pool = spark.createDataFrame([(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.8, [1.0, 0.01]), (1, 3, 0.7, [0.0, 1.0]), (2, 4, 0.5, [1.0, 0.0])], "q long, i long, s double, v array<double>")
    assert rows(ranking.apart(pool, "q", "i", "s", "v"), "i", "place") == [(1, 1), (3, 2), (4, 1)]
    assert rows(ranking.apart(pool.limit(0), "q", "i", "s", "v")) == []


def test_earlier_rows_only(spark):
    df = spark.createDataFrame([(i, [float(i == k) + 0.1 * i for k in range(4)]) for i in range(4)], "id long, vec array<float>")
    found = rows(block_search(df, df, 2, 4, earlier=True), "query_id", "id")
    assert found == [(1, 0), (2, 0), (2, 1), (3, 1), (3, 2)] or all(a > b for a, b in found) and len(found) == 5


def test_tied_ranks(spark):
    g = np.random.default_rng(8)
    values = [None if x < -1.4 else float("nan") if x > 1.9 else float(np.round(x, 1)) for x in g.standard_normal(400)]
    data = [(i % 3 if i % 50 else None, i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "g int, i int, v double")
    high = lambda v: float("inf") if v != v else v
    want = [(i, None if v is None else 1 + sum(q == p and w is not None and high(w) > high(v) for q, _, w in data)) for p, i, v in data]
    assert rows(ranking.tied_rank(df, "g", "v", "r", 2), "i", "r") == sorted(want, key=repr)
    assert rows(ranking.tied_rank(df.limit(0), "g", "v", "r")) == []


def test_transitions(spark):
    """Chains over the borders of chunks, broken by null nodes and at the ends of groups."""
    g = np.random.default_rng(1)
    data = [(int(a), int(t), i, None if g.random() < 0.05 else int(g.integers(0, 5))) for i, (a, t) in enumerate(zip(g.integers(0, 3, 300), g.integers(0, 400, 300)))]
    want = {}
    for own in range(3):
        chain = [n for a, _, _, n in sorted((r for r in data if r[0] == own), key=lambda r: r[1:3])]
        for x, y in zip(chain, chain[1:]):
            if x is not None and y is not None:
                want[x, y] = want.get((x, y), 0) + 1
    df = spark.createDataFrame(data, "a int, t int, i int, n int")
    assert rows(graph.transitions(df, F.col("a"), F.floor(F.col("t") / 7), ["t", "i"], "n")) == sorted([(x, y, n) for (x, y), n in want.items()], key=repr)
    assert rows(graph.transitions(df.limit(0), F.col("a"), F.col("t"), ["i"], "n")) == []


def test_contrastive_terms(spark):
    docs = spark.createDataFrame([(1, "x", "fox fox den of"), (2, "x", "fox tree"), (3, "y", "tree tree"), (4, "y", None), (5, "y", "")], "doc_id long, kind string, text string")
    found = {(k, t): w for k, t, w, _ in rows(contrastive_terms(docs, "kind"))}
    assert set(found) == {("x", "fox"), ("x", "den"), ("x", "tree"), ("y", "tree")}
    assert abs(found["x", "fox"] - 3 / 5 * np.log(1 + 5 / 3)) < 1e-5 and abs(found["y", "tree"] - np.log(1 + 5 / 3)) < 1e-5


def test_folder_of_tables_is_cleaned(spark):
    df = runtime.written(spark.range(3), "some")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and runtime.clean(spark) >= 1 and not os.path.exists(path)


def test_streams_go_on(spark, tmp_path):
    """A stream that stops after some files goes on from its folder: nothing is lost, counted twice or begun anew."""
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    part = lambda r: spark.createDataFrame(r, "k int, v int, x string").coalesce(1).write.mode("append").parquet(log)
    fold = lambda: rows(latest_snapshot(read_log(spark, log, 1), ["k"], [F.desc("v"), F.desc("x")], state, folded=3))
    part([(1, 5, "a"), (2, 1, "b")])
    part([(1, 4, "late")])
    assert fold() == [(1, 5, "a"), (2, 1, "b")]
    bases = lambda: sorted(p.name for p in (tmp_path / "state").glob("base-*"))
    assert bases() == []
    for i in range(5):
        part([(i, 10 + i, "new")])
    assert fold() == [(i, 10 + i, "new") for i in range(5)] and bases() == ["base-2", "base-5"]
    assert fold() == [(i, 10 + i, "new") for i in range(5)]
    out = lambda: rows(drained(read_log(spark, log), folder=str(tmp_path / "copy")))
    assert len(out()) == 8
    part([(9, 9, "z")])
    assert len(out()) == 9 and (9, 9, "z") in out()


def test_streams(spark, tmp_path):
    log = str(tmp_path / "log.parquet")
    first = spark.createDataFrame([(1, D(2025, 1, 1, 0), "a", 1), (1, D(2025, 1, 1, 1), "b", 2), (2, D(2025, 1, 1, 2), "a", 3), (None, None, "a", 4)], "k int, at timestamp, kind string, v int")
    later = spark.createDataFrame([(1, D(2025, 1, 3, 0), "a", 0), (2, D(2024, 12, 1, 0), "late", 9), (2, D(2025, 1, 9, 0), "b", 5)], "k int, at timestamp, kind string, v int")
    first.coalesce(1).write.parquet(log)
    later.coalesce(1).write.mode("append").parquet(log)
    snapshot = latest_snapshot(read_log(spark, log, 1), ["k"], [F.desc("v")])
    assert rows(snapshot, "k", "v") == [(1, 2), (2, 9), (None, 4)]
    counts = rows(drained(windowed(read_log(spark, log, 1), "at", "1 day", "kind"), "complete"), "kind", "n")
    assert sum(n for _, n in counts) == 6
    closed = rows(drained(closed_sessions(read_log(spark, log, 8), "k", "at")), "k", "n")
    assert (1, 2) in closed and all(n >= 1 for _, n in closed)
