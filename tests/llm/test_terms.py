import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import terms as T
from tests.test_text import reference_tokens

SCHEMA = "docid int, text string, term string, line string, n long"


def rows(seed=1):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    out = [(None, "lost", "", "", 0), (900, None, "", "", 0), (901, "", "", "", 0), (902, " \t9 ", "", "", 0), (903, "deep " * 30_000 + "sea", "", "", 0)]
    for d in range(200):
        text = " ".join([rng.choice(["The", "of,"])] + [words[min(int(rng.expovariate(0.05)), 119)] for _ in range(rng.randrange(30))])
        for _ in range(rng.choice([1, 1, 2, 40 if d == 7 else 3])):
            out.append((d, None if rng.random() < 0.2 else rng.choice(["", " ", "\t\n"]) + text + rng.choice(["", "  "]), "x", "y", 1))
    rng.shuffle(out)
    return out


def brute(data):
    return {d: Counter(reference_tokens(t)) for d, t, *_ in data if d is not None and t is not None}


@pytest.mark.parametrize("heavy", [0, 1, 5, 500])
def test_frequencies_equal_brute_force(spark, heavy):
    data = rows()
    recs = brute(data)
    c = T.collect_heavy(T.records(spark.createDataFrame(data, SCHEMA).repartition(3)), max(heavy, 1))
    if heavy == 0:
        c = c._replace(heavy=[])
    assert c.n == len(recs)
    want = {}
    for counts in recs.values():
        for t, n in counts.items():
            a = want.setdefault(t, [0, 0])
            a[0] += n
            a[1] += 1
    got = T.mark(T.term_frequencies(c), c.n).collect()
    assert {r["term"]: [r["n"], r["df"]] for r in got} == want and len(got) == len(want)
    assert {r["term"] for r in got if r["heavy"]} == set(c.heavy)
    for r in got:
        assert r["mark"] == ("rare" if r["df"] <= 2 else "common" if 10 * r["df"] >= c.n else None)


def test_scores_equal_brute_force(spark):
    data = rows(2)
    recs = brute(data)
    c = T.collect_heavy(T.records(spark.createDataFrame(data, SCHEMA)), 8)
    df = Counter(t for counts in recs.values() for t in counts)
    total = Counter()
    for counts in recs.values():
        total.update(counts)
    z = sum(sum(counts.values()) ** 0.75 for counts in recs.values())
    got = {(r["docid"], r["term"]): r for r in T.record_scores(c).collect()}
    assert len(got) == sum(map(len, recs.values()))
    for (d, t), r in got.items():
        want = max(0.0, math.log(recs[d][t] * z / (total[t] * sum(recs[d].values()) ** 0.75)))
        assert (r["tf"], r["df"]) == (recs[d][t], df[t]) and r["ppmi"] == pytest.approx(want, abs=1e-9)
    best = {}
    for d, counts in recs.items():
        s = sorted(((-round(n * math.log(len(recs) / df[t]), 6), t) for t, n in counts.items() if df[t] >= 3))
        if len(s) >= 2 and -s[0][0] >= -2 * s[1][0]:
            best[d] = s[0][1]
    flat = T.outstanding(T.record_scores(c, least_df=3, alpha=0.0, presence=True))
    assert {r["docid"]: r["term"] for r in flat.collect()} == best and best


def test_a_long_term_of_every_record_is_no_hot_key(spark):
    long = "z" + "-" * 98 + "z"
    recs = T.collect_heavy(T.records(spark.createDataFrame([(i, f"{long} w{chr(97 + i % 7)}x y{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}z") for i in range(2000)], "docid int, text string").repartition(4)), 4)
    assert long not in recs.heavy
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scores = T.record_scores(recs).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(1 for r in scores if r["term"] == long and r["df"] == 2000) == 2000
    sizes = sorted(Counter(r["part"] for r in scores).values())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_empty(spark):
    c = T.collect_heavy(T.records(spark.createDataFrame([], SCHEMA)))
    assert c.n == 0 and c.heavy == [] and T.term_frequencies(c).count() == 0
    assert T.record_scores(c).count() == 0 and T.outstanding(T.record_scores(c)).count() == 0
    only = T.collect_heavy(T.records(spark.createDataFrame([(1, None, "", "", 0), (2, " ", "", "", 0)], SCHEMA)))
    assert only.n == 1 and T.term_frequencies(only).count() == 0


def test_mark_at_the_bound(spark):
    df = spark.createDataFrame([("a", 7), ("b", 6), ("c", 2)], "term string, df long")
    assert {r["term"]: r["mark"] for r in T.mark(df, 70).collect()} == {"a": "common", "b": None, "c": "rare"}
