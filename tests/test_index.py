import json

import pytest

from millrace.operators import index as I
from millrace.plans.postfix import compile_postfix


def docs(spark):
    return spark.createDataFrame([(5, "a b"), (6, "A, a! c"), (9, "a"), (10, None), (11, ""), (None, "a")], "doc_id long, text string").selectExpr("*", "'clash' as term")


def test_index_gaps_roundtrip(spark):
    posts = I.postings(docs(spark), "doc_id", "text")
    a = I.build_index(posts).where("term = 'a'").first()
    assert a["df"] == 3 and [tuple(p) for p in a["postings"]] == [(5, 1), (6, 2), (9, 1)]
    gaps = I.encode_gaps(I.build_index(posts)).where("term = 'a'").first()["gaps"]
    assert [g["gap"] for g in gaps] == [5, 1, 3]
    back = I.decode_gaps(I.encode_gaps(I.build_index(posts, block=2)))
    assert sorted(map(tuple, back.collect())) == sorted((r["term"], r["doc_id"], r["tf"]) for r in posts.collect())
    two = sorted((r["block"], r["df"], [p["doc_id"] for p in r["postings"]]) for r in I.build_index(posts, block=2).where("term = 'a'").collect())
    assert two == [(0, 3, [5, 6]), (1, 3, [9])]
    assert {(r["term"], r["df"], r["cf"]) for r in I.vocabulary(posts).collect()} == {("a", 3, 4), ("b", 1, 1), ("c", 1, 1)}


def test_padding_is_skipped(spark):
    enc = spark.sql("select 'a' term, 0L block, 2L df, array(named_struct('gap', 3L, 'tf', 1), named_struct('gap', 2L, 'tf', 0)) gaps")
    assert [tuple(r) for r in I.decode_gaps(enc).collect()] == [("a", 3, 1)]


def search(spark, query):
    posts = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 2, 1), ("b", 3, 1), ("c", 3, 1)], "term string, doc_id long, tf int")
    return sorted(r[0] for r in I.boolean_search(posts, query).collect())


def test_postfix(spark):
    assert search(spark, "a b AND") == [2]
    assert search(spark, "a b AND c OR") == [2, 3]
    assert search(spark, "zz a OR") == [1, 2]
    assert search(spark, "zz") == []
    assert search(spark, "c a") == [1, 2]
    assert search(spark, "a and OR") == [1, 2]
    for bad in ("a AND", "", "AND", None):
        with pytest.raises(ValueError):
            compile_postfix(bad)


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "doc_id long") for xs in ([1, 2, 2], [2, 3]))
    assert sorted(r[0] for r in I.intersect(a, b).collect()) == [2]
    assert sorted(r[0] for r in I.unite(a, b).collect()) == [1, 2, 3]


def test_fetch_and_json(spark):
    df = spark.createDataFrame([(1, "x" * 81), (2, 'a "<b>"'), (3, None)], "doc_id long, text string")
    hits = spark.createDataFrame([(1,), (2,), (3,), (1,)], "doc_id long")
    assert {(r["doc_id"], r["text"]) for r in I.fetch(hits, df, "doc_id", "text").collect()} == {(1, "x" * 80 + "..."), (2, 'a "<b>"'), (3, None)}
    got = I.search_json(I.postings(df, "doc_id", "text"), df, "a b OR", "doc_id", "text").collect()
    assert [json.loads(r["hit"]) for r in got] == [{"docid": 2, "text": 'a "<b>"'}] and "<b>" in got[0]["hit"]


def test_stored_index(spark, tmp_path):
    posts = I.postings(docs(spark), "doc_id", "text")
    I.write_index(I.build_index(posts), f"{tmp_path}/i")
    stored = spark.read.parquet(f"{tmp_path}/i")
    assert sorted(r["doc_id"] for r in I.lookup_term(stored, "a").collect()) == [5, 6, 9]
    assert I.lookup_term(stored, "nothing").count() == 0
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,a)]" in stored.where("term = 'a'")._jdf.queryExecution().toString()
    I.write_collection(docs(spark), f"{tmp_path}/c", "doc_id", "text")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 6


def test_empty(spark):
    posts = I.postings(docs(spark).limit(0), "doc_id", "text")
    assert I.build_index(posts).count() == 0 and I.boolean_search(posts, "a").count() == 0


@pytest.mark.parametrize("wide", [True, False])
def test_blocks_go_by_rank_however_ids_are_spaced(spark, wide):
    ids = [hash((i, "x")) % (1 << 61) if wide else 200 * i for i in range(1000)]
    posts = spark.createDataFrame([(t, i, 1) for i in ids for t in (["all", f"t{i % 7}"])], "term string, doc_id long, tf int").repartition(5)
    rows = I.build_index(posts, block=64).collect()
    own = sorted((r["block"], r["df"], [p["doc_id"] for p in r["postings"]]) for r in rows if r["term"] == "all")
    assert [b for b, _, _ in own] == list(range(16)) and {len(x) for _, _, x in own[:-1]} == {64}
    assert [i for _, _, x in own for i in x] == sorted(ids) and {df for _, df, _ in own} == {1000}
    assert all(len(r["postings"]) <= 64 for r in rows) and sum(len(r["postings"]) for r in rows) == 2000


def test_bytes(spark):
    import numpy as np

    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 35, (1 << 63) - 1, (1 << 64) - 1], np.uint64)
    raw, size = I._to_bytes(values)
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 6, 9, 10] and raw[:5].tolist() == [0, 1, 127, 128, 1]
    assert (I._from_bytes(raw) == values).all() and len(I._from_bytes(raw[:0])) == 0
    posts = spark.createDataFrame([("a", -5, 1), ("a", 3, 300), ("a", 1 << 40, 2), ("b", 0, 1)], "term string, doc_id long, tf int")
    stored = I.encode_bytes(I.encode_gaps(I.build_index(posts)))
    assert sorted(map(tuple, I.decode_gaps(I.decode_bytes(stored)).collect())) == sorted(map(tuple, posts.collect()))
    assert {r["term"]: len(r["bytes"]) for r in stored.collect()} == {"a": 10 + 1 + 1 + 2 + 6 + 1, "b": 2}
    assert I.decode_bytes(stored.limit(0)).count() == 0


def test_search_of_what_is_stored(spark, tmp_path, monkeypatch):
    I.write_index(I.build_index(I.postings(docs(spark), "doc_id", "text"), 2), f"{tmp_path}/i")
    I.write_collection(docs(spark), f"{tmp_path}/c", "doc_id", "text")
    index, collection = spark.read.parquet(f"{tmp_path}/i"), spark.read.parquet(f"{tmp_path}/c")
    plan = I.postings_of(index, "a b AND")._jdf.queryExecution().toString()
    assert "[In(term, [a,b])" in plan and "ReadSchema: struct<term:string,postings" in plan
    for hot in (4096, 1):
        monkeypatch.setattr(I, "HOT", hot)
        assert sorted(map(tuple, I.search_stored(index, collection, "b c OR").collect())) == [(5, "a b"), (6, "A, a! c")]
    assert I.search_stored(index, collection, "none").count() == 0
