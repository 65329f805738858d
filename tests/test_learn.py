import math

import pytest

from millrace.operators import learn as L


def inst(spark, data):
    return spark.createDataFrame(data, "doc_id long, y double, features array<int>, score string")


def fold(data, delta=0.002):
    w = {}
    for _, y, fs, _ in sorted(data):
        p = 1 / (1 + math.exp(-sum(w.get(f, 0.0) for f in fs or [] if f is not None)))
        for f in fs or []:
            if f is not None:
                w[f] = w.get(f, 0.0) + (y - p) * delta
    return w


def test_sgd(spark):
    got = {r["feature"]: r["weight"] for r in L.sgd_train(inst(spark, [(1, 1.0, [1, 2], "x"), (2, 0.0, [2, 2, 3], "x")]), ["doc_id"]).collect()}
    assert got[1] == pytest.approx(0.001) and got[2] == pytest.approx(-0.001002, abs=1e-6) and got[3] == pytest.approx(-0.001001, abs=1e-6)


def test_sgd_equals_fold(spark):
    import random

    rng = random.Random(3)
    data = [(i, float(rng.random() < 0.5), [rng.randrange(20) for _ in range(rng.randrange(8))] or None, "x") for i in range(300)]
    df = inst(spark, data).repartition(7)
    assert {r["feature"]: r["weight"] for r in L.sgd_train(df, ["doc_id"]).collect()} == pytest.approx(fold(data))
    shards = L.sgd_train(df.selectExpr("*", "doc_id % 3 as m"), ["doc_id"], "m").collect()
    for m in range(3):
        assert {r["feature"]: r["weight"] for r in shards if r["model_id"] == m} == pytest.approx(fold([d for d in data if d[0] % 3 == m]))
    assert L.shuffled(df, 1).select("ord").distinct().count() == 300
    assert L.sgd_train(df.limit(0), ["doc_id"]).count() == 0


def test_score_and_ensemble(spark):
    model = spark.createDataFrame([(0, 1, 1.0), (1, 1, -0.4), (2, 1, -0.4), (0, 2, 0.0)], "model_id long, feature int, weight double")
    df = inst(spark, [(7, 1.0, [1, 99], "x"), (8, 0.0, [], "x"), (9, 0.0, None, "x"), (10, 0.0, [2, None], "x")])
    s = L.score(df, model)
    got = {(r["doc_id"], r["model_id"]): (r["score"], r["predicted"]) for r in s.collect()}
    assert got[7, 0] == (1.0, "spam") and got[8, 1] == (0.0, "ham") and got[10, 0] == (0.0, "ham") and len(got) == 12
    avg = {r["doc_id"]: r for r in L.ensemble_average(s).collect()}
    assert avg[7]["score"] == pytest.approx(0.2 / 3) and avg[7]["predicted"] == "spam" and avg[9]["predicted"] == "ham"
    vote = {r["doc_id"]: r for r in L.ensemble_vote(s).collect()}
    assert vote[7]["score"] == -1 and vote[7]["predicted"] == "ham" and vote[8]["score"] == -3
    assert L.score(df.limit(0), model).count() == 0


def test_roca(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0), (None, 1)], "score double, y int")
    assert L.one_minus_roca(df).first()[0] == pytest.approx(100 * (1 - 3.5 / 4))
    assert L.one_minus_roca(df.where("y = 1")).first()[0] is None


def test_reading_and_sorting_are_not_left_to_the_one_task(spark):
    df = inst(spark, [(i, float(i % 2), [i % 5], "x") for i in range(400)]).repartition(7)
    plan = L.sgd_train(df, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce 1" in plan and "Sort" not in plan and "Exchange" not in plan


def test_a_feature_of_every_document_is_no_hot_key(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    df = inst(spark, [(i, 0.0, [1, 1, 2 + i % 50], "x") for i in range(1000)]).repartition(4)
    model = spark.createDataFrame([(m, f, float(m + f)) for m in (0, 1) for f in range(60)], "model_id long, feature int, weight double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {(r["doc_id"], r["model_id"]): r["score"] for r in L.score(df, model).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(i, m): 2.0 * (m + 1) + m + 2 + i % 50 for i in range(1000) for m in (0, 1)}


def test_trained_ensemble_scores_as_folds_do(spark):
    import random

    rng = random.Random(4)
    data = [(i, float(i % 2), [rng.randrange(10) + 10 * (i % 2) for _ in range(6)], "x") for i in range(200)]
    df = inst(spark, data)
    models = [fold([d for d in data if d[0] % 3 == m]) for m in range(3)]
    scored = L.ensemble_average(L.score(df, L.sgd_train(df.selectExpr("*", "doc_id % 3 as m"), ["doc_id"], "m"))).collect()
    want = {i: sum(sum(w.get(f, 0.0) for f in fs) for w in models) / 3 for i, _, fs, _ in data}
    assert {r["doc_id"]: r["score"] for r in scored} == pytest.approx(want)
    assert all((r["predicted"] == "spam") == (r["doc_id"] % 2 == 1) for r in scored)
