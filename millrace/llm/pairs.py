"""Items that appear together, by heavy-light decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import head_terms
from millrace.llm.terms import Collection, join_key, lift
from millrace.operators.skew import HOT, join_hot
from millrace.session import ship, written

#: Items with a bit column of their own.
HEAVY = 256
#: Records per block of a task; bounds the bit matrix to HEAVY * BLOCK / 8 bytes.
BLOCK = 1 << 17
#: A dictionary goes to all workers only up to so many bytes of items (then records are coded without a shuffle), else it
#: is joined by shuffle, its frequent items by broadcast.
BROADCAST_BYTES = 32 << 20
#: Pairs with an item that has no bit column which a block may hold; a record of more is a block of its own.
PAIRS = 1 << 23
#: Pairs in one piece of the output.
SLICE = 1 << 18


def _within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of all pairs inside consecutive runs of the given sizes."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    left, right = [], []
    for size in np.unique(sizes):
        if size > 1:
            i, j = np.triu_indices(size, 1)
            at = starts[sizes == size][:, None]
            left.append((at + i).ravel())
            right.append((at + j).ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def block_pairs(items: np.ndarray, sizes: np.ndarray, heavy: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair counts (a, b, n), a < b, of one block of records.

    `items` holds each record's distinct ids one after the other, `sizes` their numbers. Ids below `heavy` have a bit
    column over the block's records: pairs of two of them are popcounts of ANDed columns. Each other item probes the
    heavy columns at the records of its list. Pairs without a heavy item are counted by their hash (here: a sort of
    64-bit codes).
    """
    rows = np.repeat(np.arange(len(sizes)), sizes)
    is_heavy = items < heavy
    out = []
    used, column = np.unique(items[is_heavy], return_inverse=True)
    bits = np.zeros((len(used), len(sizes)), bool)
    bits[column, rows[is_heavy]] = True
    if len(used) > 1:
        width = -(-len(sizes) // 64) * 64
        padded = np.zeros((len(used), width), bool)
        padded[:, : len(sizes)] = bits
        words = np.packbits(padded, axis=1).view(np.uint64)
        for k in range(len(used) - 1):
            n = np.bitwise_count(words[k] & words[k + 1 :]).sum(axis=1, dtype=np.int64)
            some = np.flatnonzero(n)
            out.append((np.full(len(some), used[k]), used[k + 1 + some], n[some]))
    rare, at = items[~is_heavy], rows[~is_heavy]
    if len(rare) and len(used):
        order = np.argsort(rare, kind="stable")
        lists, start = np.unique(rare[order], return_index=True)
        probe = np.ascontiguousarray(bits.T)
        step = max(1, (1 << 24) // len(used))
        ends = np.append(start, len(rare))
        k = 0
        while k < len(lists):  # as many lists at once as fit the step, at least one
            stop = max(k + 1, int(np.searchsorted(ends, ends[k] + step, "right")) - 1)
            held = probe[at[order[ends[k] : ends[stop]]]]
            n = np.add.reduceat(held, ends[k:stop] - ends[k], axis=0, dtype=np.int64)
            i, j = np.nonzero(n)
            out.append((used[j], lists[k:stop][i], n[i, j]))
            k = stop
    if len(rare):
        sizes_r = np.bincount(at, minlength=len(sizes))
        rare = rare[np.lexsort((rare, at))]
        i, j = _within(sizes_r)
        code, n = np.unique(rare[i].astype(np.int64) << 32 | rare[j].astype(np.int64), return_counts=True)
        out.append((code >> 32, code & 0xFFFFFFFF, n))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([x[c].astype(np.int64) for x in out]) for c in range(3))


def record_pairs(items: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs (a, b, 1), a < b, of one record of distinct ids, in slices of at most `most` pairs (or of one id's)."""
    items = np.sort(items)
    left = len(items) - 1 - np.arange(len(items))
    done = np.cumsum(left)
    k = 0
    while k < len(items) - 1:
        stop = max(k + 1, int(np.searchsorted(done, done[k] - left[k] + most, "right")))
        size = left[k:stop]
        first = np.repeat(np.arange(k, stop) + 1 - (np.cumsum(size) - size), size)
        yield np.repeat(items[k:stop], size), items[first + np.arange(len(first))], np.ones(len(first), np.int64)
        k = stop


def _pair_counter(heavy: int, block: int, names=None, most: int = PAIRS):
    """Counts pairs block by block over lists of ids, or of terms that `names` (a broadcast array) numbers.

    A block ends at `block` records or `most` pairs; the pairs of a record of more go out in slices.
    """

    def ids(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if names is None:
            return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.index_in(lists.flatten().cast(pa.string()), names.value)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        record = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        return found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(record[known], minlength=len(lists))

    def out(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + SLICE].astype(np.int32)), pa.array(b[i : i + SLICE].astype(np.int32)), pa.array(n[i : i + SLICE])], names=["a", "b", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = pairs = 0
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                items, sizes = ids(batch.column(0).slice(i, block))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                rare = np.diff(np.concatenate([[0], np.cumsum(items >= heavy)])[ends])
                cost = rare * (rare - 1) // 2 + rare * (sizes - rare)
                done = np.cumsum(cost)
                k = 0
                while k < len(sizes):
                    if cost[k] > most:
                        for piece in record_pairs(items[ends[k] : ends[k + 1]], SLICE):
                            yield from out(*piece)
                        k += 1
                        continue
                    stop = int(np.searchsorted(done, done[k] - cost[k] + most - pairs, "right"))
                    if stop > k:
                        held.append((items[ends[k] : ends[stop]], sizes[k:stop]))
                        rows, pairs, k = rows + stop - k, pairs + int(cost[k:stop].sum()), stop
                    if rows >= block or k < len(sizes):
                        yield from out(*block_pairs(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), heavy))
                        held, rows, pairs = [], 0, 0
        if held:
            yield from out(*block_pairs(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), heavy))

    return count


def pair_counts(collection: Collection, cap: int | None = None, least: int = 1, heavy: int = HEAVY, block: int = BLOCK) -> DataFrame:
    """(term_a, term_b, n, c_a, c_b, lift): for each two terms of one record, term_a < term_b, the records holding both
    and each, and n * N / (c_a * c_b), for pairs with n >= `least`.

    All terms of a record are considered, or its first `cap`, each distinct one once. Terms in fewer than `least` records can be in no such pair and are left out first. The others get ids by
    falling count; records of ids are counted block by block as `block_pairs` says, and the blocks' counts summed. A
    record of one term has no pairs; an empty collection gives none.
    """
    ship(collection.records.sparkSession)
    heads = collection.records.select("docid", head_terms("terms", cap).alias("h"))
    single = heads.select(F.explode("h").alias("term")).groupBy("term").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    dictionary = _numbered(single)
    size = dictionary.agg(F.sum(F.octet_length("term") + F.lit(32))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        table = dictionary.select("id", "term").toArrow().sort_by("id")
        names = heads.sparkSession.sparkContext.broadcast(table.column("term").combine_chunks().cast(pa.string()))
        counted = heads.select("h").mapInArrow(_pair_counter(heavy, block, names), "a int, b int, n long")
    else:
        total = single.agg(F.sum("c")).first()[0]
        flat = heads.select("docid", F.explode("h").alias("term")).withColumn("key", join_key(F.col("term")))
        coded = join_hot(flat, dictionary.select(join_key(F.col("term")).alias("key"), "id", "c"), "key", "c", total, F.col("docid")).where("id is not null").select("docid", "id")
        lists = coded.groupBy("docid").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1)
        counted = lists.select("ids").mapInArrow(_pair_counter(heavy, block), "a int, b int, n long")
    counted = counted.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    named = lambda k: dictionary.select(F.col("id").alias(k), F.col("term").alias(f"t{k}"), F.col("c").alias(f"c{k}"))
    if size <= BROADCAST_BYTES:
        pairs = counted.join(F.broadcast(named("a")), "a").join(F.broadcast(named("b")), "b")
    else:  # a frequent item has pairs with most others: its rows stay where they are
        counted, is_heavy = written(counted), F.col("a") < HOT
        light = counted.where(~is_heavy).join(named("a").where(~is_heavy), "a")
        pairs = light.unionByName(counted.where(is_heavy).join(F.broadcast(named("a").where(is_heavy)), "a")).join(named("b"), "b")
    swap = F.col("ta") > F.col("tb")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(
        either("ta", "tb").alias("term_a"), either("tb", "ta").alias("term_b"), "n", either("ca", "cb").alias("c_a"), either("cb", "ca").alias("c_b"), lift(F.col("n"), collection.n, F.col("ca"), F.col("cb")).alias("lift")
    )


def _numbered(single: DataFrame) -> DataFrame:
    """(term, c, id): ids 0, 1, 2, ... by falling count, then term, without ordering all terms in one task.

    Terms are range-partitioned and written; a partition's offset is the size of those before it.
    """
    part = written(single.repartitionByRange(F.desc("c"), "term").withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in part.groupBy("part").count().collect())  # a row per partition
    offset, total = {}, 0
    for p, n in sizes:
        offset[p], total = total, total + n
    if total >= 1 << 31:
        raise ValueError("more than 2^31 different terms")
    start = part.sparkSession.createDataFrame(list(offset.items()), "part int, start long")
    at = F.row_number().over(W.partitionBy("part").orderBy(F.desc("c"), "term")) - 1
    numbered = part.withColumn("at", at).join(F.broadcast(start), "part")
    return written(numbered.select("term", "c", (F.col("start") + F.col("at")).cast("int").alias("id")))
