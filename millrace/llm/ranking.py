"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Subgroups of a group in the first stage.
SALTS = 64


def usable_score(score: Column) -> Column:
    """The score, or null where it is NaN or infinite."""
    return F.when(F.isnan(score) | (F.abs(score) == float("inf")), None).otherwise(score)


def _float_rank(score: Column) -> Column:
    """A whole number from 0 to 2^32 - 1 that orders finite single-precision floats as they are, and null below all.

    Exponent and fraction side by side, with the sign of the score; exact, as all parts are powers of two times small
    whole numbers.
    """
    size = F.abs(score.cast("double"))
    exponent = F.floor(F.log2(size))
    normal = (exponent + 126 + size * F.pow(F.lit(2.0), -exponent)) * (1 << 23)
    rank = F.when(size >= 2.0**-126, normal).otherwise(size * 2.0**149).cast("long")
    return F.coalesce(F.when(score < 0, -rank).otherwise(rank) + (1 << 31), F.lit(0).cast("long"))


def latest_scores(rows: DataFrame, group: str, item: str, version: str, score: str) -> DataFrame:
    """(group, item, score): the score of each item in its group by the row of the highest version.

    Rows of a null group or item are left out. If rows of the highest version disagree, their highest usable score
    counts; an item whose score there is null, NaN or infinite has none and is left out. A null version is older than
    any.

    For an int version and a float score, both go into one long, and a single hash aggregation (partial before its one
    shuffle) takes the score of the largest. Other types are aggregated by version first, which costs a second shuffle.
    """
    kinds = dict(rows.select(version, score).dtypes)
    usable = usable_score(F.col(score))
    seen = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("group"), F.col(item).alias("item"), F.col(version).alias("v"), usable.alias("s"))
    if kinds[version] in ("tinyint", "smallint", "int") and kinds[score] == "float":
        place = F.coalesce(F.col("v").cast("long"), F.lit(-(1 << 31))) * (1 << 32) + _float_rank(F.col("s"))
        newest = seen.select("group", "item", "s", place.alias("place")).groupBy("group", "item").agg(F.max_by("s", "place").alias("score"))
    else:
        each = seen.withColumn("v", F.coalesce(F.col("v").cast("long"), F.lit(-(1 << 62)))).groupBy("group", "item", "v").agg(F.max("s").alias("s"))
        newest = each.groupBy("group", "item").agg(F.max_by("s", "v").alias("score"))
    return newest.where("score is not null").withColumn("score", F.col("score").cast("double"))


def top_n(scored: DataFrame, n: int, salts: int = SALTS) -> DataFrame:
    """(group, item, score, rank): the n items of highest score of each group, equal scores by smaller item.

    Two-stage salted ranking: a group is hashed by item into `salts` subgroups, each ranked and cut to n (already before
    the shuffle, by the window's group limit), then the survivors, at most n * salts a group, are ranked again.
    """
    order = [F.desc("score"), F.asc("item")]
    salted = scored.select("group", "item", "score", F.pmod(F.xxhash64("item"), F.lit(salts)).cast("int").alias("salt"))
    first = salted.withColumn("r", F.row_number().over(W.partitionBy("group", "salt").orderBy(*order))).where(F.col("r") <= n)
    return first.select("group", "item", "score", F.row_number().over(W.partitionBy("group").orderBy(*order)).alias("rank")).where(F.col("rank") <= n)
