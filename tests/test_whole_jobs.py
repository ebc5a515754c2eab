"""Operators and queries do the whole job: nothing is left out by a threshold, a modulo, a file layout or a limit."""

import datetime as dt
import os

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from memlake.operators import graph

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def hits(nodes, edges, rounds=50):
    """The reference's loop."""
    place = {n: i for i, n in enumerate(nodes)}
    hub, authority = np.ones(len(nodes)), np.ones(len(nodes))
    for _ in range(rounds):
        a, h = np.zeros(len(nodes)), np.zeros(len(nodes))
        for s, t, w in edges:
            a[place[t]] += hub[place[s]] * w
            h[place[s]] += authority[place[t]] * w
        a, h = a / (np.linalg.norm(a) + 1e-12), h / (np.linalg.norm(h) + 1e-12)
        done = abs(a - authority).max() < 1e-8 and abs(h - hub).max() < 1e-8
        hub, authority = h, a
        if done:
            break
    return {n: (hub[i], authority[i]) for n, i in place.items()}


def test_components_keep_lone_nodes(spark):
    edges = spark.createDataFrame([(1, 2), (5, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(1,), (7,), (7,), (None,)], "node long")
    assert rows(graph.connected_components(edges, nodes)) == [(1, 1), (2, 1), (7, 7)]
    assert rows(graph.connected_components(edges.limit(0), nodes)) == [(1, 1), (7, 7)]


def test_hits_run_to_their_tolerance(spark):
    g = np.random.default_rng(0)
    edges = sorted({(int(a), int(b)): 1.0 + int(c) for a, b, c in g.integers(0, 12, (30, 3))}.items())
    edges = [(a, b, w) for (a, b), w in edges]
    nodes = [*range(12), 99]
    found = {n: (h, a) for n, h, a in rows(graph.hubs_and_authorities(spark.createDataFrame(edges, "src long, dst long, weight double"), nodes=spark.createDataFrame([(n,) for n in nodes], "node long")))}
    want = hits(nodes, edges)
    assert set(found) == set(nodes) and found[99] == (0, 0)
    assert all(np.allclose(found[n], want[n], atol=1e-7) for n in nodes)


@given
def test_hits_of_all_links(spark):
    """Links seen once count, prototypes without links are kept."""
    from memlake.plans.rank_queries import _counts

    edges = [(r.src, r.dst, float(r.n)) for r in _counts(spark, DATA).collect()]
    found = {n: (h, a) for n, h, a in rows(entry.queries()["q40_hits"](spark, DATA))}
    assert any(w == 1 for *_, w in edges) and {n for s, t, _ in edges for n in (s, t)} <= set(found)
    assert {r.id for r in spark.read.parquet(f"{DATA}/semantic_prototypes.parquet").select("id").dropna().collect()} <= set(found)
    want = hits(list(found), edges)
    assert all(np.allclose(found[n], want[n], atol=2e-6) for n in found)


@given
def test_insert_or_ignore_takes_all_links(spark):
    links = spark.read.parquet(f"{DATA}/episode_prototype_map.parquet").select("episode_id", "prototype_id").dropna()
    found = entry.queries()["q110_insert_or_ignore_late"](spark, DATA)
    assert rows(found, "episode_id", "prototype_id") == rows(links.distinct())
    assert {r.known for r in found.select("known").distinct().collect()} == {True, False}


def test_sessions_of_files_out_of_order(spark, tmp_path):
    """Twenty files, the latest events first: no session is lost or cut short."""
    import duckdb

    start = dt.datetime(2025, 1, 1)
    events = [(i, start + dt.timedelta(days=day, hours=h), i % 3) for i, (day, h) in enumerate((day, h) for day in range(20) for h in (0, 5, 10))]
    for k in range(20):
        part = spark.createDataFrame(events[3 * k : 3 * k + 3], "event_id long, ts timestamp_ntz, user_id int")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        (new,) = [f for f in (tmp_path / "events.parquet").glob("*.parquet") if not f.name.startswith("day")]
        new = new.rename(new.with_name(f"day{k:02}.parquet"))
        os.utime(new, (1_700_000_000 - 60 * k,) * 2)
    want = duckdb.connect().execute(f"WITH events AS (SELECT * FROM '{tmp_path}/events.parquet/day*.parquet') SELECT user_id, started, last, n FROM ({entry.oracle_sql()['s1_closed_sessions']})").fetchall()
    assert len(want) > 40 and rows(entry.queries()["s1_closed_sessions"](spark, str(tmp_path))) == sorted(want, key=repr)


def test_binding_of_many_labels(spark, tmp_path):
    """More labels than may be broadcast: each row still has its result."""
    n = 10_050
    vec = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("vec_id") * i + 1).cast("float"))
    spark.range(n).select(F.col("id").alias("vec_id"), F.col("id").cast("int").alias("label")).withColumn("embedding", vec).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert entry.queries()["q54_role_binding"](spark, str(tmp_path)).select("id").distinct().count() == n
