"""Inverted index and Boolean retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import tokens, truncated
from millrace.operators.skew import HOT, join_hot
from millrace.plans.postfix import compile_postfix
from millrace.session import ship, written
from millrace.sources import write_keyed

#: Postings in a block; a term's list is stored in blocks, so that no row grows with the collection.
BLOCK = 1 << 14


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, doc_id, tf): occurrences of each token in each document. Rows of one id count together."""
    return (
        docs.where(F.col(doc_id).isNotNull())
        .select(F.col(doc_id).cast("bigint").alias("doc_id"), F.explode(tokens(text)).alias("term"))
        .groupBy("term", "doc_id")
        .agg(F.count("*").cast("int").alias("tf"))
    )


def vocabulary(posts: DataFrame) -> DataFrame:
    """(term, df, cf): documents holding the term, and its occurrences."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def build_index(posts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, block, df, postings): posting lists ascending by doc_id, blocks 0, 1, ... of `block` postings or fewer.

    df counts the documents of the term, in every row of it. Blocks go by rank within the term, however ids are spaced.
    A term of no more than `block` documents is one row by one aggregation, and where all are, that is the whole way. The
    lists of others are first laid out in
    ranges of (term, doc_id), so that the list of a term that stands in every document is spread over tasks; a block's
    number is the rank within its range plus what the ranges before hold.
    """
    posts = written(posts)
    df = written(posts.groupBy("term").agg(F.count("*").alias("df")))
    entry = F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings")
    total, longest = (x or 0 for x in df.agg(F.sum("df"), F.max("df")).first())
    if longest <= block:
        return posts.groupBy("term").agg(F.count("*").alias("df"), entry).select("term", F.lit(0).cast("bigint").alias("block"), "df", "postings")
    sized = join_hot(posts, df.select("term", "df", F.col("df").alias("rows")), "term", "rows", total, F.col("doc_id"))
    short = sized.where(F.col("df") <= block).groupBy("term", F.lit(0).cast("bigint").alias("block"), "df").agg(entry)
    ranged = written(sized.where(F.col("df") > block).repartitionByRange("term", "doc_id").withColumn("part", F.spark_partition_id()))
    per = ranged.groupBy("term", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("term").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(W.partitionBy("term", "part").orderBy("doc_id")) - 1 + F.col("before")
    numbered = ranged.join(per.select("term", "part", before.alias("before")), ["term", "part"]).withColumn("rank", rank)
    long = numbered.groupBy("term", F.expr(f"rank div {block}").alias("block"), "df").agg(entry)
    return short.unionByName(long)


def encode_gaps(index: DataFrame) -> DataFrame:
    """(term, block, df, gaps): each doc_id as the difference to the one before in its row, the first from 0."""
    gap = lambda p, i: F.struct((p["doc_id"] - F.when(i == 0, F.lit(0)).otherwise(F.get("postings", i - 1)["doc_id"])).alias("gap"), p["tf"].alias("tf"))
    return index.select("term", "block", "df", F.transform("postings", gap).alias("gaps"))


def decode_gaps(encoded: DataFrame) -> DataFrame:
    """(term, doc_id, tf) from gaps; entries of tf 0 are padding and skipped.

    The running sum is taken over the exploded block (block rows per term and block at most).
    """
    flat = encoded.select("term", "block", F.posexplode("gaps").alias("i", "g"))
    run = F.sum("g.gap").over(W.partitionBy("term", "block").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return flat.select("term", run.alias("doc_id"), F.col("g.tf").alias("tf")).where(F.col("tf") > 0)


def _to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers as bytes of seven bits, low ones first, the eighth set on all but a number's last; and the
    bytes each takes."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    number = np.repeat(np.arange(len(values)), size)
    place = np.arange(len(number)) - np.repeat(np.cumsum(size) - size, size)
    part = (values[number] >> (7 * place).astype(np.uint64)) & np.uint64(127)
    return (part + np.uint64(128) * (place + 1 < size[number])).astype(np.uint8), size


def _from_bytes(raw: np.ndarray) -> np.ndarray:
    """The numbers of such bytes."""
    last = raw < 128
    number = np.cumsum(last) - last
    start = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(raw) else np.zeros(0, np.int64)
    place = np.arange(len(raw)) - start[number]
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), start) if len(raw) else np.zeros(0, np.uint64)


def encode_bytes(encoded: DataFrame) -> DataFrame:
    """(term, block, df, bytes): the gaps and frequencies of each row in turn as numbers of varying length.

    A gap of a negative first id takes ten bytes, as its two's complement.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            flat, n = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            both = np.stack([flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)], 1).ravel()
            raw, size = _to_bytes(both.view(np.uint64))
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(2 * n)])]
            made = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], names=["term", "block", "df", "bytes"])

    ship(encoded.sparkSession)
    return encoded.select("term", "block", "df", F.col("gaps")).mapInArrow(run, "term string, block long, df long, bytes binary")


def decode_bytes(stored: DataFrame) -> DataFrame:
    """(term, block, df, gaps) of (term, block, df, bytes)."""

    def run(batches):
        kind = pa.struct([("gap", pa.int64()), ("tf", pa.int32())])
        for batch in batches:
            rows = [_from_bytes(np.frombuffer(b, np.uint8)).view(np.int64).reshape(-1, 2) for b in batch.column(3).to_pylist()]
            both = np.concatenate(rows) if rows else np.zeros((0, 2), np.int64)
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1].astype(np.int32))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), flat)], names=["term", "block", "df", "gaps"])

    ship(stored.sparkSession)
    return stored.select("term", "block", "df", "bytes").mapInArrow(run, "term string, block long, df long, gaps array<struct<gap:bigint,tf:int>>")


def write_index(index: DataFrame, path: str) -> None:
    """Store an index sorted by term, for lookup by pushed-down filters."""
    write_keyed(index, path, "term", "block")


def write_collection(docs: DataFrame, path: str, doc_id: str, text: str) -> None:
    """Store (doc_id, text) sorted by id, for lookup by id."""
    write_keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path, "doc_id")


def lookup_term(index: DataFrame, term: str) -> DataFrame:
    """(doc_id, tf) of one term from an index; none for an unknown term."""
    return index.where(F.col("term") == term).select(F.inline("postings"))


def postings_of(index: DataFrame, query: str) -> DataFrame:
    """(term, doc_id, tf) of the terms of a postfix query, from a stored index; the filter reaches its files."""
    terms, _ = compile_postfix(query)
    return index.where(F.col("term").isin(terms)).select("term", F.inline("postings"))


def search_stored(index: DataFrame, collection: DataFrame, query: str, width: int | None = 80) -> DataFrame:
    """(doc_id, text) of the hits of a query, from a stored index and a collection stored by id.

    Only the blocks of the query's terms are read. The hits, up to `HOT` of them, become a filter that the collection's
    files are pruned by; more are joined.
    """
    hits = written(boolean_search(postings_of(index, query), query))
    ids = [r[0] for r in hits.limit(HOT + 1).collect()]
    found = collection.where(F.col("doc_id").isin(ids)) if len(ids) <= HOT else collection
    return fetch(hits, found, "doc_id", "text", width)


def boolean_search(posts: DataFrame, query: str) -> DataFrame:
    """(doc_id): documents that satisfy a postfix query of terms, AND and OR.

    One pass: only postings of the query's terms are read (the filter reaches a Parquet index), each document's
    presence flags are aggregated and the query becomes one Boolean expression over them. Terms are taken as written;
    unknown ones match nothing. A malformed query raises ValueError; operands left below the top are ignored.
    """
    terms, condition = compile_postfix(query)
    flags = [F.max(F.col("term") == t).alias(f"has_{i}") for i, t in enumerate(terms)]
    return posts.where(F.col("term").isin(terms)).groupBy("doc_id").agg(*flags).where(condition).select("doc_id")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in both sets, each once."""
    return a.select("doc_id").intersect(b.select("doc_id"))


def unite(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in either set, each once."""
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def fetch(hits: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int | None = 80) -> DataFrame:
    """(doc_id, text) of the hits, texts cut to `width` characters plus `...` (None: whole)."""
    body = truncated(text, width) if width else F.col(text)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), body.alias("text")).join(hits.select("doc_id").distinct(), "doc_id", "left_semi")


def search_json(posts: DataFrame, docs: DataFrame, query: str, doc_id: str, text: str) -> DataFrame:
    """(doc_id, hit): each hit as the JSON object {"docid":..,"text":..}, characters not escaped for HTML."""
    return as_json(fetch(boolean_search(posts, query), docs, doc_id, text, None))


def as_json(hits: DataFrame) -> DataFrame:
    """(doc_id, hit) of (doc_id, text)."""
    return hits.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("docid"), "text"), {"ignoreNullFields": "false"}).alias("hit"))
