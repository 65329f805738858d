import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pairs as P
from millrace.llm import queries as Q
from millrace.llm import terms as T
from tests.llm.test_terms import SCHEMA, rows
from tests.test_text import reference_tokens


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), max_size=9), max_size=90), st.sampled_from([0, 1, 4, 12, 64]))
def test_block_equals_plain_count(records, heavy):
    items = np.array([x for r in records for x in r], np.int64)
    a, b, n = P.block_pairs(items, np.array([len(r) for r in records], np.int64), heavy)
    want = Counter(p for r in records for p in combinations(sorted(r), 2))
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == want and len(a) == len(want)


@pytest.mark.parametrize(("heavy", "block", "least", "cap", "limit"), [(256, 16384, 1, 40, 1 << 25), (4, 7, 3, 40, 1 << 25), (0, 50, 1, 5, 1 << 25), (4, 64, 2, 40, 0)])
def test_pairs_equal_brute_force(spark, monkeypatch, heavy, block, least, cap, limit):
    monkeypatch.setattr(P, "BROADCAST_BYTES", limit)
    data = rows(3)
    texts = {d: t for d, t, *_ in data if d is not None and t is not None}
    sets = [set(reference_tokens(t)[:cap]) for t in texts.values()]
    single = Counter(t for s in sets for t in s)
    both = Counter(p for s in sets for p in combinations(sorted(s), 2))
    c = T.collect_heavy(T.records(spark.createDataFrame(data, SCHEMA)))
    got = {(r["term_a"], r["term_b"]): r for r in P.pair_counts(c, cap, least, heavy, block).collect()}
    assert got.keys() == {p for p, n in both.items() if n >= least}
    for (a, b), r in got.items():
        assert (r["n"], r["c_a"], r["c_b"]) == (both[a, b], single[a], single[b])
        assert r["lift"] == pytest.approx(both[a, b] * len(sets) / (single[a] * single[b]))


def test_empty(spark):
    assert P.pair_counts(T.collect_heavy(T.records(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_all_pairs_of_long_records(spark, tmp_path):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)]
    texts = {1: " ".join(words), 2: " ".join(words[5:60]), 3: f"{words[0]} {words[69]}", 4: " ".join(words[:3] * 30 + words[66:])}
    spark.createDataFrame([(d, d, t, None) for d, t in texts.items()], "query_id long, docid int, text string, fetched_at timestamp_ntz").write.parquet(f"{tmp_path}/query_results.parquet")
    sets = [set(reference_tokens(t)) for t in texts.values()]
    single, both = Counter(t for s in sets for t in s), Counter(p for s in sets for p in combinations(sorted(s), 2))
    got = {(r["term_a"], r["term_b"]): (r["n"], r["c_a"], r["c_b"], r["lift"]) for r in Q.p3_pairs(spark, str(tmp_path)).collect()}
    assert got == {(a, b): (n, single[a], single[b], pytest.approx(n * 4 / (single[a] * single[b]), abs=1e-6)) for (a, b), n in both.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), max_size=20), min_size=1, max_size=40), st.sampled_from([0, 3, 64]), st.sampled_from([0, 1, 10, 60, 1000]), st.sampled_from([1, 5, 100]), st.sampled_from([1, 7, 500]))
def test_counter_in_bounded_pieces(records, heavy, most, block, size):
    import pyarrow as pa

    before, P.SLICE = P.SLICE, size
    try:
        batches = [pa.RecordBatch.from_arrays([pa.array([list(r) for r in records[i : i + 9]], pa.list_(pa.int64()))], names=["h"]) for i in range(0, len(records), 9)]
        out = list(P._pair_counter(heavy, block, None, most)(iter(batches)))
    finally:
        P.SLICE = before
    got = Counter()
    for batch in out:
        assert batch.num_rows <= size
        for a, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[a, b] += n
    assert got == Counter(p for r in records for p in combinations(sorted(r), 2))


def test_frequent_items_behind_the_heavy_ones(spark, monkeypatch):
    """A dictionary that is joined, items named by digest, and one in every record that has no bit column."""
    rng = random.Random(8)
    long = "a" + "x-" * 60 + "z"
    data = [(i, f"{long} w{chr(97 + i % 5)}q {' '.join('t' + chr(97 + rng.randrange(26)) + 'r' for _ in range(4))}") for i in range(200)]
    rows = spark.createDataFrame(data, "docid int, text string").repartition(4)
    c = T.collect_heavy(T.records(rows))
    want = sorted(map(tuple, P.pair_counts(c).collect()))
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(P, "HOT", 3)
    assert sorted(map(tuple, P.pair_counts(c, heavy=2, block=7).collect())) == want
    assert any(r[0] == long for r in want)


def test_a_record_of_very_many_items_goes_out_in_slices():
    n = most = 0
    for a, b, c in P.record_pairs(np.arange(20_000)[::-1], P.SLICE):
        assert len(a) == len(b) == len(c) and a[0] < b[0]
        n, most = n + len(a), max(most, len(a))
    assert n == 20_000 * 19_999 // 2 and most <= P.SLICE
