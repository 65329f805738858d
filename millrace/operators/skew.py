"""Per-key results without imbalance, by value-frequency compression.

Rows are counted by key *and value* before they are brought together by key. The first aggregation pre-aggregates
before its shuffle and spreads a hot key over all tasks by its values; what a key's second aggregation still has to
read are partial sums, of which each task sends one per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.session import discard, written

#: A key of at least one in so many rows is hot.
HOT = 4096
#: Width, in natural-log units, of the bands in which exponentials are summed without under- or overflow.
BAND = 256.0


def once(rows: DataFrame, identity: str, *content: str) -> DataFrame:
    """One row of `content` per identity, however often delivered.

    Deliveries of one identity are taken to agree; should they not, each column's smallest non-null value counts. A
    null identity tells nothing: such rows are one per different content. Only fixed-width columns, so that the
    aggregation stays a hash aggregation with partial counts before the shuffle.
    """
    unknown = F.col(identity).isNull()
    keys = [F.when(unknown, F.col(c)).alias(f"_k{i}") for i, c in enumerate(content)]
    return rows.select(F.col(identity).alias("_id"), *keys, *[F.col(c).alias(c) for c in content]).groupBy("_id", *[f"_k{i}" for i in range(len(content))]).agg(*[F.min(c).alias(c) for c in content]).select(*content)


def weighted_values(rows: DataFrame, keys: list[str], value: str | None) -> DataFrame:
    """(keys..., value, weight): how often each value stands with each key. Null and NaN are values of their own."""
    columns = [*keys, *([value] if value else [])]
    return rows.groupBy(*columns).agg(F.count("*").alias("weight"))


def counts(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n): rows of each key."""
    return weighted.groupBy(*keys).agg(F.sum("weight").alias("n"))


def _usable(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(value)


def distinct_and_mode(weighted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., n_distinct, mode): different values and the most frequent one, the smallest of equals.

    Null and NaN values are left out; a key with no other value has n_distinct 0 and a null mode. Both are exact: a
    (key, value) stands in one row, so distinct values are counted by counting rows.
    """
    return weighted_summary(weighted, keys, value).select(*keys, "n_distinct", "mode")


def log_sums(weighted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., log_sum): log of the summed exponentials of the values.

    Null and NaN are left out, minus infinity adds nothing; a key with nothing to add has minus infinity. Exponentials
    are summed within bands of the logarithm, whose partial sums are of like size, and the bands of a key (a handful)
    are then added relative to the highest.
    """
    return weighted_summary(weighted, keys, value).select(*keys, "log_sum")


def weighted_summary(weighted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., n, log_sum, n_distinct, mode) of (keys..., value, weight), as `counts`, `log_sums` and
    `distinct_and_mode` say; what a caller doesn't select is not computed."""
    band = F.floor(F.col(value) / BAND)
    real = _usable(value) & (F.col(value) != float("-inf"))
    best = F.when(_usable(value), F.struct(F.col("weight"), (-F.col(value)).alias("v")))
    parts = weighted.select(*keys, "weight", F.when(real, band).alias("band"), F.when(real, F.col("weight") * F.exp(F.col(value).cast("double") - band * BAND)).otherwise(0.0).alias("s"), F.when(_usable(value), 1).alias("u"), best.alias("b"))
    parts = parts.groupBy(*keys, "band").agg(F.sum("weight").alias("n"), F.sum("s").alias("s"), F.count("u").alias("u"), F.max("b").alias("b"))
    parts = parts.withColumn("top", F.max("band").over(W.partitionBy(*keys)))
    total = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("top").alias("top"), F.sum(F.col("s") * F.exp((F.coalesce("band", "top") - F.col("top")) * BAND)).alias("s"), F.sum("u").alias("n_distinct"), F.max("b").alias("b")
    )
    return total.select(*keys, "n", F.when(F.col("s") > 0, F.col("top") * BAND + F.log("s")).otherwise(float("-inf")).alias("log_sum"), "n_distinct", (-F.col("b.v")).alias("mode"))


def group_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., n, log_sum, n_distinct, mode): all of the above from one compressed table."""
    return weighted_summary(weighted_values(rows, keys, value), keys, value)


def percentiles(weighted: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """(keys..., p_<percent>...): for each percent the smallest value of the key that at least so many per cent of its
    rows do not exceed.

    Exact, from (keys..., value, weight). Null and NaN values are left out; a key without others has no row. Percents
    are whole numbers from 1 to 100. A key's different values may be very many, so they are spread over ranges of
    values: the weights of ranges (one row a key and range) tell which ranges hold the wanted ranks, and only these
    are gone through, each by itself.
    """
    if not percents or not all(0 < p <= 100 for p in percents):
        raise ValueError(f"percents from 1 to 100 are needed, not {percents}")
    usable = written(weighted.where(_usable(value)).select(*keys, F.col(value).alias("_v"), "weight"))  # ranges are found by reading it once more
    ranged = written(usable.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()))
    discard(usable)
    own = W.partitionBy(*keys)
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("weight").alias("s"))
    sums = sums.select("*", F.coalesce(F.sum("s").over(own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(own).alias("n"))
    rank = lambda p: F.ceil(F.col("n") * p / F.lit(100).cast("decimal(3,0)")).cast("long")
    wanted = F.filter(F.array(*[F.struct(F.lit(p).alias("percent"), rank(p).alias("rank")) for p in percents]), lambda x: (x["rank"] > F.col("before")) & (x["rank"] <= F.col("before") + F.col("s")))
    sums = sums.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "before", wanted.alias("wanted")).where(F.size("wanted") > 0)
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    until = F.col("before") + F.sum("weight").over(W.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    each = ranged.join(sums, same).withColumn("until", until)
    each = each.select(*keys, "_v", "until", "weight", F.explode("wanted").alias("w")).where("w.rank <= until and w.rank > until - weight")
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("w.percent") == p, F.col("_v"))).alias(f"p_{p}") for p in percents])


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, spread: Column, parts: int = HOT, size: int | None = None) -> DataFrame:
    """The rows with the columns of `table` for their key (null where it has none), no key being one task's work.

    `table` has a row per key; its column `weight` (left out of the result) is how many rows have the key, `total` how
    many rows there are. Keys of at least one in `parts` rows, of which there can be `parts` at most, come by
    broadcast; for the others, the rows are joined by key, while rows already served are spread by the hash of
    `spread`, a column that tells them apart. Where the rest of the table is small, the optimizer broadcasts it too,
    and nothing is shuffled; a table known to have no more than `parts` rows (`size`) is broadcast as a whole. Null keys
    find nothing.
    """
    columns = [c for c in table.columns if c not in (key, weight)]
    if size is not None and size <= parts:
        return rows.join(F.broadcast(table.drop(weight)), key, "left").select(*rows.columns, *columns)
    is_hot = F.col(weight) * parts >= total
    hot = table.where(is_hot).select(key, F.struct(*columns).alias("_hot"))
    rest = table.where(~is_hot).select(key, F.struct(*columns).alias("_rest"), F.lit(0).alias("_salt"))
    salt = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int"))
    first = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt)
    both = first.join(rest, [key, "_salt"], "left")
    found = F.coalesce("_hot", "_rest")
    return both.select(*[F.col(c) for c in rows.columns], *[found[c].alias(c) for c in columns])


def heavy_keys(rows: DataFrame, group: list[str], key: list[str], value: str | None, percent: int = 1) -> DataFrame:
    """(group..., key..., n, total): keys with at least `percent` % of their group's rows.

    The totals are sums over the per-key counts, joined back on the group. Without `value` the keys are counted
    directly; with it they are compressed by value first.
    """
    per_key = counts(weighted_values(rows, [*group, *key], value), [*group, *key])
    totals = per_key.groupBy(*group).agg(F.sum("n").alias("total"))
    return per_key.join(totals, group).where(100 * F.col("n") >= percent * F.col("total"))
