from datetime import datetime

import pytest

from millrace.operators import graph as G


def nodes(spark):
    return spark.createDataFrame([(1, [2]), (2, []), (3, [1, 2, 9])], "id int, adjacency array<int>")


@pytest.mark.parametrize(
    ("source", "steps", "want"),
    [(1, 1, {1: 0.15, 2: 0.85, 3: 0.0}), (1, 2, {1: 0.8725, 2: 0.1275, 3: 0.0}), (3, 1, {1: 0.283333, 2: 0.283333, 3: 0.433333}), (3, 2, {1: 0.122778, 2: 0.363611, 3: 0.513611})],
)
def test_pagerank(spark, source, steps, want):
    mass = G.personalized_pagerank(nodes(spark), [source, 2], steps)
    got = {r["id"]: round(r["p_0"], 6) for r in mass.collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert sum(r["p_1"] for r in mass.collect()) == pytest.approx(1.0)


def test_top_and_stats(spark):
    n = nodes(spark)
    assert tuple(G.graph_stats(n).first()) == (3, 4, 2)
    assert sorted(map(tuple, G.edges(n).collect())) == [(1, 2), (3, 1), (3, 2), (3, 9)]
    top = G.top_nodes(G.by_source(G.personalized_pagerank(n, [1, 3], 1), [1, 3]), 2).collect()
    assert sorted((r["source"], r["rank"], r["id"]) for r in top) == [(1, 1, 2), (1, 2, 1), (3, 1, 3), (3, 2, 1)]
    assert {r["id"]: r["part"] for r in G.range_partition(n, 3, 3).collect()} == {1: 1, 2: 2, 3: 0}
    assert G.partition_nodes(n, 2).rdd.getNumPartitions() == 2 and G.partition_nodes(n, 2, True).count() == 3
    assert tuple(G.graph_stats(n.limit(0)).first()) == (0, 0, 0)


def test_latest(spark):
    at = datetime(2020, 1, 2)
    df = spark.createDataFrame([(1, [2], at, "x"), (1, [2, 3], at, "x"), (1, [9], None, "x"), (2, None, None, "x"), (2, None, None, "x"), (None, [1], at, "x"), (4, [None, 5], at, "x")], "nodeid int, adjacency array<int>, loaded_at timestamp_ntz, id string")
    assert sorted((r["id"], tuple(r["adjacency"])) for r in G.latest_nodes(df).collect()) == [(1, (2, 3)), (2, ()), (4, (5,))]
    assert G.personalized_pagerank(G.latest_nodes(df.limit(0)), [1], 2).count() == 0


def test_counters(spark):
    records = spark.createDataFrame([(1, [2, 2, 9]), (1, [2]), (2, None), (None, [1]), (3, [8, 1])], "nodeid int, adjacency array<int>").selectExpr("*", "cast(null as timestamp_ntz) as loaded_at")
    got = {r["name"]: r["n"] for r in G.graph_counters(records, G.latest_nodes(records)).collect()}
    assert got == {"null_id": 1, "repeated_record": 1, "dangling": 1, "missing_receiver": 2}
    none = records.limit(0)
    assert {r["n"] for r in G.graph_counters(none, G.latest_nodes(none)).collect()} == {0}
    assert {r["id"]: r["part"] for r in G.hash_partition(nodes(spark), 2).collect()} == {1: 1, 2: 0, 3: 1}


def test_long_lists_in_pieces(spark, monkeypatch):
    hub = spark.createDataFrame([(0, list(range(1, 30)) + [1])] + [(i, [0]) for i in range(1, 30)], "id int, adjacency array<int>")
    whole = sorted(map(tuple, G.personalized_pagerank(hub, [0], 2).collect()))
    monkeypatch.setattr(G, "LIST", 4)
    assert sorted(map(tuple, G.personalized_pagerank(hub, [0], 2).collect())) == [pytest.approx(r) for r in whole]


def test_no_step(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert {tuple(r) for r in G.personalized_pagerank(nodes(spark), [3], 0).collect()} == {(1, 0.0), (2, 0.0), (3, 1.0)}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
