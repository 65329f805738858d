import pytest

from millrace.functions.text import tokens, truncated
from millrace.operators import text as T


def lines(spark, *texts):
    return spark.createDataFrame([(t, "x") for t in texts], "line string, word string")


def tok(spark, text):
    return lines(spark, text).select(tokens("line").alias("t")).first()["t"]


def test_tokens(spark):
    assert tok(spark, "The quick, brown-fox 42 father's! -- 3rd ÉCOLE naïve") == ["the", "quick", "brown-fox", "father's", "rd", "cole", "naïve"]
    assert tok(spark, "") == [] and tok(spark, None) == [] and tok(spark, " \t\f\r\n") == []
    assert tok(spark, "a b\x0bc d") == ["a b\x0bc", "d"]
    assert tok(spark, "x" * 100_000 + "9 " + "7" * 100_000) == ["x" * 100_000]


def reference_tokens(text):
    import re

    out = []
    for run in re.split("[ \t\n\r\f]+", text):
        run = re.sub(r"\A[^a-z]+|[^a-z]+\Z", "", run.lower())
        if run:
            out.append(run)
    return out


def test_tokens_equal_plain_rule(spark):
    import random

    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("abzAZ '-.,é\t\n3�ßΣ") for _ in range(rng.randrange(60)))
        assert tok(spark, text) == reference_tokens(text), repr(text)


def test_word_count_and_lookup(spark):
    c = T.word_count(lines(spark, "b a a", None, "", "a"), "line")
    assert {(r["word"], r["n"]) for r in c.collect()} == {("a", 3), ("b", 1)}
    assert [r["word"] for r in T.top_words(c, 1).collect()] == ["a"]
    assert T.lookup(c, "zz").count() == 0
    assert T.word_count(lines(spark).limit(0), "line").count() == 0


def test_followers(spark):
    got = T.follower_count(lines(spark, "perfect love perfect day", "a perfect love", None), "line").collect()
    assert [(r["word"], r["n"]) for r in got] == [("love", 2)]


def test_line_frequency(spark):
    long = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(41))
    got = {r["word"]: r["n"] for r in T.line_frequency(lines(spark, long, "", None), "line").collect()}
    assert got["*"] == 3 and got["waa"] == 1 and "wbo" not in got and len(got) == 41


def test_bigrams(spark):
    df = lines(spark, "a b a c", "a b", "z", None)
    got = {(r["left"], r["right"]): r["value"] for r in T.bigram_pairs(df, "line").collect()}
    assert got == {("a", "*"): 3.0, ("b", "*"): 1.0, ("a", "b"): 2 / 3, ("a", "c"): 1 / 3, ("b", "a"): 1.0}
    stripes = {r["left"]: r["stripe"] for r in T.bigram_stripes(df, "line").collect()}
    assert stripes["a"] == {"b": 2 / 3, "c": 1 / 3} and set(stripes) == {"a", "b"}


@pytest.mark.parametrize("threshold", [1, 2])
def test_pmi(spark, threshold):
    pairs = T.pmi_pairs(lines(spark, "a b", "a b", "a c", "d"), "line", threshold=threshold)
    got = {(r["left"], r["right"]): (round(r["pmi"], 6), r["n"]) for r in pairs.collect()}
    want = {("a", "b"): (0.124939, 2), ("b", "a"): (0.124939, 2)}
    if threshold == 1:
        want |= {("a", "c"): (0.124939, 1), ("c", "a"): (0.124939, 1)}
    assert got == want
    stripes = {r["left"]: r["stripe"] for r in T.pmi_stripes(pairs).collect()}
    assert set(stripes["a"]) == ({"b", "c"} if threshold == 1 else {"b"})
    assert [r["right"] for r in T.pmi_top(pairs, 1, "a").collect()] == ["b"]


def test_pmi_of_nothing(spark):
    assert T.pmi_pairs(lines(spark).limit(0), "line").count() == 0
    assert T.pmi_pairs(lines(spark, None, "", "one"), "line").count() == 0


def test_truncated(spark):
    df = lines(spark, "x" * 80, "y" * 81, None).select(truncated("line").alias("t"))
    assert [r["t"] for r in df.collect()] == ["x" * 80, "y" * 80 + "...", None]


def test_stripes_of_common_words_lie_in_blocks(spark):
    df = lines(spark, *[f"the w{chr(97 + i)}x" for i in range(20)], "a b")
    rows = T.bigram_stripes(df, "line", 3).collect()
    own = [r for r in rows if r["left"] == "the"]
    assert 1 < len(own) <= 7 and {r["block"] for r in own} <= set(range(7))
    assert sorted(k for r in own for k in r["stripe"]) == sorted(f"w{chr(97 + i)}x" for i in range(20))
    assert [r["block"] for r in rows if r["left"] == "a"] == [0]
    pairs = T.pmi_pairs(df, "line")
    assert sum(len(r["stripe"]) for r in T.pmi_stripes(pairs, 3).collect()) == pairs.count()
