"""Terms of a collection of records: frequencies over the collection, and how typical a term is of its record."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions.text import tokens
from millrace.operators.skew import join_hot
from millrace.session import ship, written

#: At most so many terms are treated as heavy; also the size bound of everything that is broadcast for them.
HEAVY = 512
#: Frequencies tracked to find the heavy terms (the error of the sketch is total / TRACKED at most).
TRACKED = 8192
#: Terms of more bytes are never heavy, and stand by their digest in joins, which bounds the bytes that are broadcast.
HEAVY_LENGTH = 64


def records(rows: DataFrame, record: str = "docid", text: str = "text") -> DataFrame:
    """(docid, terms): one row per id that has a non-null text, however many rows it has, with its terms in order.

    All non-null texts of an id are taken to be one line but for white space at its ends; should they differ, the least
    counts. Null ids are no records. A blank text is a record without terms. An id returned by very many rows is
    reduced before the shuffle.
    """
    line = F.regexp_replace(F.col(text), r"\A[ \t\n\r\f]+|[ \t\n\r\f]+\z", "")
    one = rows.where(F.col(record).isNotNull() & F.col(text).isNotNull()).select(F.col(record).alias("docid"), line.alias("line"))
    return one.groupBy("docid").agg(F.min("line").alias("line")).select("docid", tokens("line").alias("terms"))


class Collection(NamedTuple):
    """Records written to the shared folder, their number, all occurrences, and the heavy terms."""

    records: DataFrame
    n: int
    occurrences: int
    heavy: list[str]


def collect_heavy(recs: DataFrame, heavy: int = HEAVY) -> Collection:
    """Write the records and find up to `heavy` of the most frequent terms by a mergeable frequent-items sketch.

    The sketch only decides which way a term is counted, never its counts. The driver gets one row.
    """
    stored = written(recs)
    n, occurrences = stored.agg(F.count("*"), F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0))).first()
    short = stored.select(F.explode("terms").alias("t")).where(F.octet_length("t") <= HEAVY_LENGTH)
    top = short.agg(F.expr(f"approx_top_k(t, {heavy}, {max(TRACKED, 4 * heavy)})").alias("top")).first()["top"] if occurrences else []
    least = occurrences / TRACKED
    return Collection(stored, n, occurrences, sorted(x["item"] for x in top or [] if x["item"] is not None and x["count"] > least))


def _flat(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """All terms of a batch, and the row each stands in."""
    lists = batch.column(batch.schema.get_field_index("terms"))
    return lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def _split_counter(content):
    """Count heavy terms (a broadcast list) in two local arrays, emitted at a task's end; pass the rest on counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy: list[str] = content.value
        names = pa.array(heavy, pa.string())
        occurrences, holders = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        fields = ["term", "n", "df", "heavy"]
        for batch in batches:
            terms, rows = _flat(batch)
            if not len(terms):
                continue
            terms = terms.cast(pa.string())
            slot = pc.fill_null(pc.index_in(terms, names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = slot >= 0
            occurrences += np.bincount(slot[hit], minlength=len(heavy))
            pairs = np.unique(rows[hit].astype(np.int64) * (len(heavy) + 1) + slot[hit])
            holders += np.bincount(pairs % (len(heavy) + 1), minlength=len(heavy) + 1)[: len(heavy)]
            light = terms.filter(pa.array(~hit))
            if not len(light):
                continue
            code = light.dictionary_encode()
            ids, where = code.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows[~hit].astype(np.int64)
            width = len(code.dictionary)
            df = np.bincount(np.unique(where * width + ids) % width, minlength=width)
            yield pa.RecordBatch.from_arrays([code.dictionary, pa.array(np.bincount(ids, minlength=width)), pa.array(df.astype(np.int64)), pa.array(np.zeros(width, bool))], names=fields)
        seen = np.flatnonzero(occurrences)
        if len(seen):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(seen)), pa.array(occurrences[seen]), pa.array(holders[seen]), pa.array(np.ones(len(seen), bool))], names=fields)

    return count


def term_frequencies(collection: Collection) -> DataFrame:
    """(term, n, df, heavy): occurrences of every term in the whole collection and the records holding it.

    Heavy-light aggregation: heavy terms are counted in exact arrays within each task, which emit one row per term and
    task; only the rest is shuffled, counted per batch beforehand. The tasks emit both tables as one, their union, so a
    single pass over the records and one aggregation finish it. An empty collection gives no rows.
    """
    spark = collection.records.sparkSession
    ship(spark)
    parts = collection.records.select("terms").mapInArrow(_split_counter(spark.sparkContext.broadcast(collection.heavy)), "term string, n long, df long, heavy boolean")
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.max("heavy").alias("heavy"))


def mark(frequencies: DataFrame, n_records: int, rare: int = 2, one_in: int = 10) -> DataFrame:
    """The frequencies with a `mark`: `rare` up to `rare` records, else `common` where at least one in `one_in` of all
    records holds the term, else null. Whole numbers are compared, so a term right at the bound is marked."""
    return frequencies.withColumn("mark", F.when(F.col("df") <= rare, "rare").when(one_in * F.col("df") >= n_records, "common"))


def record_scores(collection: Collection, least_df: int = 1, alpha: float = 0.75, presence: bool = False) -> DataFrame:
    """(docid, term, tf, df, ppmi): every term of every record, where at least `least_df` records hold the term.

    ppmi is the positive pointwise mutual information of term and record,
    max(0, ln(p(term, record) / (p(term) * q(record)))). The joint count is tf, or 1 with `presence`; p(term) is the
    term's marginal of it; q(record), the context, is the record's length to the power `alpha`, normalised over all
    records. With `presence` and alpha 0, where every record weighs the same, it is ln(N / df).
    A record without terms has no rows; unshared terms keep theirs unless `least_df` says otherwise.
    Group-bys and joins only. Joint counts are runs of the record's sorted terms, so they need no shuffle; they are
    written apart for heavy and other terms, so that each row is read once for the marginals, which come from them, and
    once for its join. Heavy terms (a bounded set) are joined by broadcast, the others by a shuffle that splits what is
    frequent all the same.
    """
    recs = collection.records.select("docid", "terms", F.size("terms").alias("len"))
    counted = recs.select("docid", "len", F.array_sort("terms").alias("s"))
    runs = counted.select("docid", "len", "s", F.filter(F.transform("s", lambda t, i: F.when((i == 0) | (t != F.get("s", i - 1)), i)), lambda i: i.isNotNull()).alias("at"))
    each = runs.select("docid", "len", F.inline(F.transform("at", lambda i, k: F.struct(F.get("s", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.size("s")) - i).alias("tf")))))
    is_heavy = F.col("term").isin(collection.heavy) if collection.heavy else F.lit(False)
    joint = written(each.withColumn("heavy", is_heavy), "heavy")
    count = F.lit(1) if presence else F.col("tf")
    marginal = written(joint.groupBy("heavy", "term").agg(F.count("*").alias("df"), F.sum(count).alias("n_t")).where(F.col("df") >= least_df), "heavy")
    contexts = float(recs.agg(F.sum(F.pow("len", F.lit(alpha)))).first()[0] or 1.0)
    light = marginal.where("not heavy").select(join_key(F.col("term")).alias("key"), "df", "n_t", F.col("df").alias("rows"))
    both = join_hot(joint.where("not heavy").withColumn("key", join_key(F.col("term"))), light, "key", "rows", collection.occurrences, F.col("docid")).where("df is not null").drop("key", "heavy")
    if collection.heavy:
        both = both.unionByName(joint.where("heavy").drop("heavy").join(F.broadcast(marginal.where("heavy").drop("heavy")), "term"))
    pmi = F.log(count * F.lit(contexts) / (F.col("n_t") * F.pow("len", F.lit(alpha))))
    return both.select("docid", "term", "tf", "df", F.greatest(pmi, F.lit(0.0)).alias("ppmi"))


def join_key(term: Column) -> Column:
    """The term, or, where it is long, its digest behind a sign that no term begins with."""
    return F.when(F.octet_length(term) > HEAVY_LENGTH, F.concat(F.lit("\0"), F.md5(term.cast("binary")))).otherwise(term)


def outstanding(scores: DataFrame, ratio: float = 2.0) -> DataFrame:
    """(docid, term): the term of highest tf * ppmi of each record with two terms or more, if its value (6 decimals) is
    at least `ratio` times the second's; of equal values the smaller term.

    The ranking keeps two rows per record before its shuffle.
    """
    w = W.partitionBy("docid").orderBy(F.desc("w"), "term")
    value = F.round(F.col("tf") * F.col("ppmi"), 6)
    top = scores.select("docid", "term", value.alias("w")).withColumn("r", F.row_number().over(w)).where("r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    both = top.groupBy("docid").agg(pick(1, "term").alias("term"), pick(1, "w").alias("w1"), pick(2, "w").alias("w2"))
    return both.where(F.col("w1") >= ratio * F.col("w2")).select("docid", "term")


def lift(n: Column, total: Column | int, a: Column, b: Column) -> Column:
    """n * total / (a * b): how many times as often as by chance."""
    return n * total / (a.cast("double") * b)
