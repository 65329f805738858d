import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ranking as R

SCHEMA = "source int, nodeid int, iteration int, logp float, salt int, score string, `group` int"


def rows(seed=4):
    rng = random.Random(seed)
    out = []
    for _ in range(3000):
        s = 5 if rng.random() < 0.4 else rng.choice([None, *range(40)])
        n = rng.choice([None, *range(300)])
        it = rng.choice([1, 2, 3, None])
        r = random.Random(hash((s, n, it)))
        p = r.choice([None, float("nan"), float("-inf"), float("inf"), -1.0, -2.5, -2.5, -r.random()])
        out += [(s, n, it, p, 1, "x", 9)] * rng.choice([1, 1, 3])
    return out


def brute(data, k):
    newest = {}
    for s, n, it, p, *_ in data:
        if s is not None and n is not None:
            v = -1 if it is None else it
            ok = p if p is not None and math.isfinite(p) else None
            old = newest.get((s, n))
            if old is None or v > old[0] or (v == old[0] and ok is not None and (old[1] is None or ok > old[1])):
                newest[s, n] = (v, ok)
    groups = {}
    for (s, n), (_, p) in newest.items():
        if p is not None:
            groups.setdefault(s, []).append((-p, n))
    return {(s, n, i + 1) for s, x in groups.items() for i, (_, n) in enumerate(sorted(x)[:k])}


def test_float_rank_orders_floats(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 32, 4000, dtype=np.uint32).view(np.float32)
    values = np.concatenate([values[np.isfinite(values)], np.float32([0, -0.0, 1, -1, 2, 1.9999999, 2**-126, 2**-149, 3.4028235e38, -3.4028235e38, 1e-40])])
    df = spark.createDataFrame([(float(v),) for v in values], "x float").select("x", R._float_rank(F.col("x")).alias("r"))
    got = df.orderBy("r").collect()
    assert all(a["x"] <= b["x"] and (a["r"] < b["r"]) == (a["x"] < b["x"]) for a, b in zip(got, got[1:], strict=False))
    assert all(0 < r["r"] < 1 << 32 for r in got)


@pytest.mark.parametrize(("k", "salts", "cast"), [(10, 64, "float"), (1, 3, "float"), (500, 1, "double")])
def test_top_equals_brute_force(spark, k, salts, cast):
    data = rows()
    table = spark.createDataFrame(data, SCHEMA).withColumn("logp", F.col("logp").cast(cast)).repartition(5)
    df = R.latest_scores(table, "source", "nodeid", "iteration", "logp")
    assert {(r["group"], r["item"], r["rank"]) for r in R.top_n(df, k, salts).collect()} == brute([(s, n, i, None if p is None else float(np.float32(p)), *_) for s, n, i, p, *_ in data], k)


def test_prunes_before_shuffle_and_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    top = R.top_n(R.latest_scores(df, "source", "nodeid", "iteration", "logp"), 10)
    assert top.count() == 0
    assert top._jdf.queryExecution().toString().count("WindowGroupLimit") >= 2
