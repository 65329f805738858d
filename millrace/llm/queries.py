"""The registered queries of the training-data operators. Each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, packing, pairs, ranking, terms, truncation
from millrace.session import spread
from millrace.sources import load

#: Terms of a record that p3_found considers.
FIRST = 40


def _collection(spark: SparkSession, d: str, heavy: int = terms.HEAVY) -> terms.Collection:
    return terms.collect_heavy(terms.records(load(spark, d, "query_results")), heavy)


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term: occurrences, records holding it, mark."""
    c = _collection(spark, d)
    return terms.mark(terms.term_frequencies(c), c.n).select("term", "n", "df", "mark")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_terms(spark, d).where("mark is not null").select("term", "mark")


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every record with its occurrences, the records holding it, and its score."""
    return terms.record_scores(_collection(spark, d)).withColumn("ppmi", F.round("ppmi", 6))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """tf * ln(N / df) is tf times the operator's score over presence counts with evenly weighted records."""
    return terms.outstanding(terms.record_scores(_collection(spark, d), least_df=3, alpha=0.0, presence=True))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every two terms standing in the same record, however long: records with both, with each, lift."""
    return pairs.pair_counts(_collection(spark, d)).withColumn("lift", F.round("lift", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    c = _collection(spark, d)
    least = max(5, -(-c.n // 5000))  # n >= 5 and 5000 n >= N
    found = pairs.pair_counts(c, FIRST, least)
    whole = lambda x: F.col(x).cast("decimal(19,0)")  # noqa: E731 - products of counts may pass 2^63
    return found.where(whole("n") * F.lit(c.n).cast("decimal(19,0)") >= whole("c_a") * whole("c_b") * F.lit(20).cast("decimal(2,0)")).select("term_a", "term_b")


def _top(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_n(ranking.latest_scores(load(spark, d, "ppr_scores"), "source", "nodeid", "iteration", "logp"), 10)


def p5_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten best nodes of every source with score and rank."""
    return _top(spark, d).select(F.col("group").alias("source"), F.col("item").alias("nodeid"), "score", "rank")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select(F.col("group").alias("source"), F.col("item").alias("nodeid"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(spread(load(spark, d, "documents").select("doc_id", "text")), "text", ["doc_id"])


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the token ids of all documents stand for."""
    return bpe.decode_column(p6_ids(spark, d), "ids", ["doc_id"])


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = bpe.encode_column(spread(load(spark, d, "documents").select("doc_id", "text")), "text", ["doc_id"], counts_only=True)
    return packing.pack(sizes, load(spark, d, "pack_profiles"), "doc_id", "n_tokens")


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Container and position of every text for every profile; texts larger than the capacity in parts."""
    return _packed(spark, d).withColumnRenamed("item", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used and filled share of each profile."""
    return packing.fill_report(_packed(spark, d), load(spark, d, "pack_profiles"))


def p7_chars(spark: SparkSession, d: str) -> DataFrame:
    """The packing of all documents by their characters: items, parts, characters, fewest and too full containers."""
    profiles = load(spark, d, "pack_profiles")
    packed = packing.pack(load(spark, d, "documents").select("doc_id", "n_chars"), profiles, "doc_id", "n_chars")
    load_of = packed.where("container is not null").groupBy("profile", "container").agg(F.sum("length").alias("load"), F.max(F.col("start") + F.col("length")).alias("end"), F.count("*").alias("k"), F.max("position").alias("last"))
    checked = load_of.join(F.broadcast(profiles.select("profile", "capacity").distinct()), "profile").groupBy("profile").agg(F.count(F.when((F.col("load") > F.col("capacity")) | (F.col("end") != F.col("load")) | (F.col("last") + 1 != F.col("k")), 1)).alias("wrong"))
    return packing.fill_report(packed, profiles).withColumnRenamed("tokens", "chars").join(checked, "profile").select("profile", "items", "parts", "chars", "least", "wrong")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "documents").select("doc_id", "text", "source", "lang"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_texts(_documents(spark, d)).where("truncated").select(F.col("id").alias("doc_id"))


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    docs = _documents(spark, d)
    return truncation.truncation_rates(docs, truncation.truncated_texts(docs))


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of each source that the rates are of."""
    return p8_sources(spark, d).select("source", "texts")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_terms, p2_found, p2_scores, p3_found, p3_pairs, p5_found, p5_top, p6_ids, p6_roundtrip, p7_packing, p7_fill, p7_chars, p8_found, p8_sources, p8_texts)
}
