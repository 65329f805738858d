"""Word counts, bigrams and pointwise mutual information over lines of text.

All functions take a DataFrame with one row per line and the name of its text column. A null line has no tokens but is
still a line (it counts in totals). Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions.text import adjacent_pairs, head_terms, tokens
from millrace.session import written

#: Partners of a word in one row of its stripe.
STRIPE = 1 << 16


def token_counts(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., n_tokens): tokens of each row."""
    return lines.select(*keys, F.size(tokens(text)).cast("bigint").alias("n_tokens"))


def word_count(lines: DataFrame, text: str) -> DataFrame:
    """(word, n): occurrences of every token."""
    return lines.select(F.explode(tokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top_words(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent words, ties by word."""
    return counts.orderBy(F.desc("n"), "word").limit(k)


def lookup(counts: DataFrame, word: str) -> DataFrame:
    """The row of one word; none if it does not occur."""
    return counts.where(F.col("word") == word)


def _bigrams(lines: DataFrame, text: str) -> DataFrame:
    return lines.select(F.inline(adjacent_pairs(tokens(text))))


def follower_count(lines: DataFrame, text: str, word: str = "perfect", least: int = 2) -> DataFrame:
    """(word, n): tokens right after `word` within a line, those seen at least `least` times over all lines."""
    return _bigrams(lines, text).where(F.col("left") == word).groupBy(F.col("right").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def line_frequency(lines: DataFrame, text: str, cap: int | None = 40, threshold: int = 1) -> DataFrame:
    """(word, n): lines holding the word among their first `cap` tokens; `*` is the number of lines, empty ones too."""
    found = lines.select(F.explode(head_terms(tokens(text), cap)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    return found.unionByName(lines.agg(F.lit("*").alias("word"), F.count("*").alias("n")))


def pmi_pairs(lines: DataFrame, text: str, cap: int | None = 40, threshold: int = 1) -> DataFrame:
    """(left, right, pmi, n) for every ordered pair of different words that share at least `threshold` lines.

    pmi = log10(n * N / (c(left) * c(right))), counts over distinct words among the first `cap` tokens. Pairs are
    counted once as left < right and mirrored after the threshold, which halves what is shuffled. The words of the lines
    are written once, for the single counts, the pairs and N. `cap` bounds the pairs of one line; None lifts the bound (use only where lines are short).
    """
    heads = written(lines.select(F.array_sort(head_terms(tokens(text), cap)).alias("t")))
    word = heads.select(F.explode("t").alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    total = F.lit(heads.count())
    first = heads.select("t", F.posexplode("t").alias("i", "left"))
    pairs = first.select("left", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("right")).groupBy("left", "right").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    scored = (
        pairs.join(word.select(F.col("word").alias("left"), F.col("c").alias("cl")), "left")
        .join(word.select(F.col("word").alias("right"), F.col("c").alias("cr")), "right")
        .select("left", "right", F.log10(F.col("n") * total / (F.col("cl").cast("double") * F.col("cr"))).alias("pmi"), "n")
    )
    return scored.select(F.inline(F.array(F.struct("left", "right", "pmi", "n"), F.struct(F.col("right").alias("left"), F.col("left").alias("right"), "pmi", "n"))))


def _stripes(pairs: DataFrame, value: Column, most: int) -> DataFrame:
    """(left, block, stripe) of pairs whose column `k` is the number of partners of the left word."""
    block = F.pmod(F.xxhash64("right"), F.greatest(F.expr(f"(k + {most - 1}) div {most}"), F.lit(1))).cast("int")
    entry = F.struct(F.col("right").alias("key"), value.alias("value"))
    return pairs.groupBy("left", block.alias("block")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("stripe"))


def pmi_stripes(pairs: DataFrame, most: int = STRIPE) -> DataFrame:
    """(left, block, stripe): map of right to struct(pmi, n), keys ascending, for each word with a partner.

    A word of up to `most` partners is one row of block 0; the partners of others lie in blocks of about so many, by
    the hash of the partner, so that no row and no task has all partners of a very common word.
    """
    k = pairs.groupBy("left").agg(F.count("*").alias("k"))
    return _stripes(pairs.join(k, "left"), F.struct("pmi", "n"), most)


def pmi_top(pairs: DataFrame, k: int, word: str | None = None) -> DataFrame:
    """(left, right, pmi, n, rank): the k partners of highest pmi of each word (or of one), ties by partner."""
    if word is not None:
        pairs = pairs.where(F.col("left") == word)
    rank = F.row_number().over(W.partitionBy("left").orderBy(F.desc(F.round("pmi", 9)), "right"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _ratios(lines: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(left, right, value, k) with the relative frequency and the left word's number of followers; (left, total, k)."""
    pairs = _bigrams(lines, text).groupBy("left", "right").agg(F.count("*").alias("n"))
    marginal = pairs.groupBy("left").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return pairs.join(marginal, "left").select("left", "right", (F.col("n") / F.col("total")).alias("value"), "k"), marginal


def bigram_pairs(lines: DataFrame, text: str) -> DataFrame:
    """(left, right, value): relative frequency n(left, right) / n(left, *); rows with right = `*` hold n(left, *).

    The marginal comes from the pair counts, not from the lines, so it costs one small join on the left word.
    """
    ratios, marginal = _ratios(lines, text)
    return ratios.drop("k").unionByName(marginal.select("left", F.lit("*").alias("right"), F.col("total").cast("double").alias("value")))


def bigram_stripes(lines: DataFrame, text: str, most: int = STRIPE) -> DataFrame:
    """(left, block, stripe): map of follower to relative frequency, keys ascending, without the marginal.

    A word of up to `most` followers is one row of block 0; those of others lie in blocks, as in `pmi_stripes`.
    """
    return _stripes(_ratios(lines, text)[0], F.col("value"), most)
