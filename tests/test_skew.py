import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import skew as S
from millrace.session import written

SCHEMA = "msg_id long, iteration int, neighbor int, mass float, n string"


def messages(seed=1, n=3000):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        hot = rng.random() < 0.5
        mass = rng.choice([None, float("nan"), float("-inf"), -1.5, -2.25, -900.0, -5.0 - i / 8])
        row = (i, rng.choice([1, 2]), 7 if hot else rng.choice([None, *range(20, 90)]), mass, "x")
        out += [row] * (rng.choice([1, 1, 1, 4]))
    out += [(None, 1, 7, -1.0, "x")] * 3 + [(None, None, 7, None, "x")]
    rng.shuffle(out)
    return out


def brute(rows):
    seen, groups = {}, defaultdict(list)
    for r in rows:
        seen[repr(r) if r[0] is None else r[0]] = r
    for _, it, nb, mass, _ in seen.values():
        if nb is not None:
            groups[it, nb].append(mass)
    out = {}
    for k, ms in groups.items():
        real = [m for m in ms if m is not None and not math.isnan(m)]
        finite = [m for m in real if m > -math.inf]
        top = max(finite, default=None)
        log = top + math.log(sum(math.exp(m - top) for m in finite)) if finite else -math.inf
        c = Counter(real)
        mode = min((m for m in c if c[m] == max(c.values())), default=None)
        out[k] = (len(ms), log, len(c), mode)
    return out


def test_summary_equals_brute_force(spark):
    rows = messages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    once = S.once(df, "msg_id", "iteration", "neighbor", "mass").where("neighbor is not null")
    want = brute(rows)
    got = {(r["iteration"], r["neighbor"]): r for r in S.group_summary(once, ["iteration", "neighbor"], "mass").collect()}
    assert got.keys() == want.keys()
    for k, (n, log, distinct, mode) in want.items():
        r = got[k]
        assert (r["n"], r["n_distinct"]) == (n, distinct), k
        assert r["log_sum"] == pytest.approx(log, rel=1e-6) and (r["mode"] == mode or r["mode"] == pytest.approx(mode)), k
    weighted = S.weighted_values(once, ["iteration", "neighbor"], "mass")
    parts = {(r["iteration"], r["neighbor"]): r["log_sum"] for r in S.log_sums(weighted, ["iteration", "neighbor"], "mass").collect()}
    assert parts == pytest.approx({k: v[1] for k, v in want.items()}, rel=1e-6)
    modes = {(r["iteration"], r["neighbor"]): r["n_distinct"] for r in S.distinct_and_mode(weighted, ["iteration", "neighbor"], "mass").collect()}
    assert modes == {k: v[2] for k, v in want.items()}


def test_heavy_keys(spark):
    rows = messages(2)
    once = S.once(spark.createDataFrame(rows, SCHEMA), "msg_id", "iteration", "neighbor", "mass").where("neighbor is not null")
    want = brute(rows)
    total = Counter()
    for (it, _), v in want.items():
        total[it] += v[0]
    heavy = {k for k, v in want.items() if 100 * v[0] >= total[k[0]] and k[0] is not None}
    got = {(r["iteration"], r["neighbor"]) for r in S.heavy_keys(once, ["iteration"], ["neighbor"], "mass").collect()}
    assert got == heavy and (1, 7) in got


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.group_summary(S.once(df, "msg_id", "iteration", "neighbor", "mass"), ["iteration", "neighbor"], "mass").count() == 0


def test_percentiles_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float("nan"), float("-inf"), *[float(x) for x in range(9)]])) for _ in range(3000)] + [("empty", None), ("one", 4.0)]
    got = {r["k"]: tuple(r)[1:] for r in S.percentiles(S.weighted_values(spark.createDataFrame(rows, "k string, v double"), ["k"], "v"), ["k"], "v", [1, 50, 90, 100]).collect()}
    for k in ("a", "b", None, "one"):
        own = sorted(v for x, v in rows if x == k and v is not None and not math.isnan(v))
        assert got[k] == tuple(own[math.ceil(len(own) * p / 100) - 1] for p in (1, 50, 90, 100))
    assert "empty" not in got
    with pytest.raises(ValueError):
        S.percentiles(spark.createDataFrame([], "k string, v double, weight long"), ["k"], "v", [0])
    assert S.percentiles(spark.createDataFrame([], "k string, v double, weight long"), ["k"], "v", [50]).count() == 0


def test_join_hot_equals_a_left_join(spark):
    rows = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('k', id % 11) end as k")
    table = rows.where("k is not null and k <> 'k5'").groupBy("k").count().selectExpr("k", "count as n", "concat(k, '!') as v", "count * 2 as w")
    plain = sorted(map(tuple, rows.join(table.drop("n"), "k", "left").select("id", "k", "v", "w").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for parts in (1, 5, 4096):
            assert sorted(map(tuple, S.join_hot(rows, table, "k", "n", 1000, F.col("id"), parts).collect())) == plain
        assert sorted(map(tuple, S.join_hot(rows, table, "k", "n", 1000, F.col("id"), size=table.count()).collect())) == plain
        joined = S.join_hot(rows, written(table), "k", "n", 1000, F.col("id"), 5)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(sizes) < 2 * 1000 / len(sizes) and len(sizes) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
