import heapq
import random
import tracemalloc
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing as P


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 500), max_size=20), st.integers(40, 90))
def test_patterns_hold_every_item_once(histogram, capacity):
    patterns = P.fill_patterns(histogram, capacity)
    held = Counter()
    for n, items in patterns:
        assert n > 0 and sum(length * times for length, times in items) <= capacity
        for length, times in items:
            held[length] += n * times
    assert held == histogram
    runs = P.lay_out(patterns)
    for length in histogram:
        own = [f for f, x in zip(runs.first.tolist(), runs.length.tolist(), strict=True) if x == length]
        assert own[0] == 0 and own == sorted(set(own))


def test_fills_well():
    rng = random.Random(1)
    histogram = Counter(min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(50_000))
    used = sum(n for n, _ in P.fill_patterns(histogram, 2048))
    assert used <= 1.005 * sum(k * v for k, v in histogram.items()) / 2048 + 1


def test_common_length_opens_no_container_per_item():
    assert sum(n for n, _ in P.fill_patterns({100: 10**12, 7: 3}, 512)) == 2 * 10**11


def one_by_one(histogram, capacity):
    """Loads of the containers when each item is placed by itself, the longest first, where most room is."""
    rooms = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and -rooms[0] >= length:
                heapq.heapreplace(rooms, rooms[0] + length)
                left -= 1
            else:
                held = min(left, capacity // length)
                heapq.heappush(rooms, held * length - capacity)
                left -= held
    return sorted(capacity + r for r in rooms)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=40), st.integers(40, 90))
def test_loads_are_those_of_items_placed_one_by_one(histogram, capacity):
    patterns = P.fill_patterns(histogram, capacity)
    loads = [sum(length * times for length, times in items) for n, items in patterns for _ in range(n)]
    assert sorted(loads) == one_by_one(histogram, capacity)


def test_memory_depends_on_lengths_not_on_places():
    """Half a million places for a very common short length, in containers of a thousand different rooms."""
    histogram = {length: 1 for length in range(1025, 2049)} | {1: 10**9}
    tracemalloc.start()
    patterns = P.fill_patterns(histogram, 2048)
    P.lay_out(patterns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n * t for n, items in patterns for length, t in items if length == 1) == 10**9
    assert peak < 4_000_000


def test_wrong_lengths_are_refused():
    for bad in ({0: 1}, {9: 1}):
        with pytest.raises(ValueError):
            P.fill_patterns(bad, 8)


def check(rows, sizes, capacities):
    """Every item whole or in full parts, containers not overfull, positions and starts gapless."""
    containers, items = defaultdict(list), defaultdict(list)
    for r in rows:
        items[r["profile"], r["item"]].append(r)
        if r["container"] is not None:
            containers[r["profile"], r["container"]].append(r)
    for p, cap in capacities.items():
        numbers = sorted(c for q, c in containers if q == p)
        assert numbers == list(range(len(numbers)))
        wanted = Counter((i, s or 0) for i, s in sizes)
        assert sum(1 for r in rows if r["profile"] == p) == sum(n * max(1, -(-s // cap)) for (_, s), n in wanted.items())
        for (i, s), n in wanted.items():
            own = items[p, i]
            if s == 0:
                assert [r["container"] for r in own if r["length"] == 0] == [None] * n
            else:
                assert sum(r["length"] for r in own) == s * n
                assert sum(1 for r in own if r["length"] == cap) >= n * (s // cap)
    for (p, _), own in containers.items():
        own.sort(key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at
            at += r["length"]
        assert at <= capacities[p]


@pytest.mark.parametrize("per_bucket", [1 << 18, 50])
def test_pack(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(P, "PER_BUCKET", per_bucket)
    rng = random.Random(2)
    sizes = [(i, rng.choice([None, 0, 7, 7, 7, 7, 64, 200, rng.randrange(1, 60)])) for i in range(1500)] + [(5000, 100_003)]
    df = spark.createDataFrame([(*s, "x") for s in sizes], "doc long, n long, length string").repartition(4)
    profiles = spark.createDataFrame([("a", 64), ("b", 64), ("c", 200), ("c", 200), ("bad", None), ("none", 0)], "profile string, capacity int")
    packed = P.pack(df, profiles, "doc", "n")
    check(packed.collect(), sizes, {"a": 64, "b": 64, "c": 200})
    report = {r["profile"]: r for r in P.fill_report(packed, profiles).collect()}
    assert report["c"]["containers"] >= report["c"]["least"] and report["c"]["filled"] > 0.9


def test_repeated_and_null_items(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (None, 5), (None, 5)], "doc long, n long")
    got = P.pack(df, spark.createDataFrame([("p", 10)], "profile string, capacity int"), "doc", "n").collect()
    assert sorted((r["container"], r["position"]) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc long, n long")
    profiles = spark.createDataFrame([("p", 10)], "profile string, capacity int")
    assert P.pack(df, profiles, "doc", "n").count() == 0
    assert P.pack(spark.createDataFrame([(1, 5)], "doc long, n long"), profiles.limit(0), "doc", "n").count() == 0


def test_a_capacity_of_more_lengths_than_classes(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_LENGTHS", 64)
    rng = random.Random(7)
    sizes = [(i, rng.randrange(1, 400)) for i in range(400)] + [(900, 1003), (901, 1000), (902, 999)]
    df = spark.createDataFrame(sizes, "doc long, n long").repartition(3)
    rows = P.pack(df, spark.createDataFrame([("p", 1000)], "profile string, capacity int"), "doc", "n").collect()
    containers = defaultdict(list)
    for r in rows:
        containers[r["container"]].append((r["position"], r["start"], r["length"]))
    assert sorted(containers) == list(range(len(containers)))
    for own in containers.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert all(a + n <= b for (_, a, n), (_, b, _) in zip(own, own[1:], strict=False)) and own[-1][1] + own[-1][2] <= 1000
    held = Counter()
    for r in rows:
        held[r["item"]] += r["length"]
    assert held == dict(sizes) and max(r["part"] for r in rows) == 1
    assert len(containers) <= 1.1 * sum(n for _, n in sizes) / 1000


def test_report_tells_items_from_parts(spark):
    profiles = spark.createDataFrame([("p", 10)], "profile string, capacity int")
    packed = P.pack(spark.createDataFrame([(1, 25), (2, 5), (3, 0)], "doc long, n long"), profiles, "doc", "n")
    r = P.fill_report(packed, profiles).first()
    assert (r["items"], r["parts"], r["containers"], r["tokens"], r["least"]) == (2, 4, 3, 30, 3)
