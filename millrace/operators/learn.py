"""Logistic-regression text classifier trained by sequential stochastic gradient descent, and ensembles of such models.

Instances are rows (doc_id, y, features array<int>). A feature may repeat within an instance and then counts as often.
Null features are skipped; a null feature array is an instance without features.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import exp

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions.logmath import signless_zero
from millrace.operators.skew import join_hot
from millrace.session import ship, use_checkpoints, written

DELTA = 0.002


def shuffled(instances: DataFrame, seed: int) -> DataFrame:
    """Instances with an `ord` column, a seeded digest of the id: the same order on every run and layout, and in any
    engine. Rows of a null id come first."""
    return instances.withColumn("ord", F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))))


def _sigmoid(x: float) -> float:
    return 1 / (1 + exp(-x)) if x >= 0 else exp(x) / (1 + exp(x))


def sgd_train(instances: DataFrame, order: list[str], model: str | None = None, delta: float = DELTA) -> DataFrame:
    """(model_id, feature, weight): one pass in the given order, a model for each value of the column `model`.

    The algorithm is a chain of updates, so one model is one task by definition. Reading, features and sorting are done
    by all tasks: rows are range-partitioned and sorted by the order columns and stored so; the one task then streams
    the sorted partitions in their order and keeps only the weights. With `model` (shards of the data, to train many
    models side by side for an ensemble) each shard is brought together and sorted by the task that trains on it. Rows
    of a null `model` train the model of id null. An empty table gives no rows.
    """
    spark = instances.sparkSession
    rows = instances.select((F.col(model) if model else F.lit(0)).cast("long").alias("model_id"), F.col("y").cast("double").alias("y"), "features", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    if model:
        ordered = rows.repartition("model_id").sortWithinPartitions("model_id", *keys)
    else:
        use_checkpoints(spark)
        ordered = rows.orderBy(*keys).select("model_id", "y", "features").checkpoint().coalesce(1)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, weights, any_row = None, defaultdict(float), False

        def out() -> pd.DataFrame:
            return pd.DataFrame({"model_id": pd.array([current] * len(weights), dtype="Int64"), "feature": list(weights.keys()), "weight": list(weights.values())})

        for batch in batches:
            for m, y, features in zip(batch["model_id"], batch["y"], batch["features"], strict=True):
                m = None if pd.isna(m) else int(m)
                if any_row and m != current:
                    yield out()
                    weights.clear()
                current, any_row = m, True
                if features is None:
                    continue
                own = [int(f) for f in features if not pd.isna(f)]
                step = (y - _sigmoid(sum(weights[f] for f in own if f in weights))) * delta
                for f in own:
                    weights[f] += step
        if any_row and weights:
            yield out()

    ship(spark)
    return ordered.select("model_id", "y", "features").mapInPandas(train, "model_id long, feature int, weight double")


def score(instances: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, model_id, score, predicted): summed weights per document and model, spam where the score is above 0.

    Unknown features weigh 0; documents without features score 0. `model` is (model_id, feature, weight); every
    document gets a row for each model. Features are counted per document before the join, and documents of one id
    count together. A feature of very many documents is no task's key: the models' weights come to it by broadcast.
    """
    ids = model.select("model_id").distinct()
    n = written(instances.select("doc_id", F.explode(F.coalesce("features", F.array().cast("array<int>"))).alias("feature")).where("feature is not null").groupBy("doc_id", "feature").agg(F.count("*").alias("n")))
    docs = n.groupBy("feature").agg(F.count("*").alias("docs"))
    weights = model.groupBy("feature").agg(F.collect_list(F.struct("model_id", "weight")).alias("weights")).join(docs, "feature")
    each = join_hot(n, weights, "feature", "docs", n.count(), F.col("doc_id")).where("weights is not null").select("doc_id", "n", F.inline("weights"))
    found = each.groupBy("doc_id", "model_id").agg(F.sum(F.col("n") * F.col("weight")).alias("s"))
    every = instances.select("doc_id").distinct().withColumn("model_id", F.explode(ids.agg(F.collect_list("model_id")).scalar()))
    value = signless_zero(F.coalesce("s", F.lit(0.0)))
    return every.join(found, ["doc_id", "model_id"], "left").select("doc_id", "model_id", value.alias("score"), F.when(value > 0, "spam").otherwise("ham").alias("predicted"))


def _labelled(df: DataFrame, value: Column) -> DataFrame:
    return df.select("doc_id", signless_zero(value).alias("score"), F.when(value > 0, "spam").otherwise("ham").alias("predicted"))


def ensemble_average(scores: DataFrame) -> DataFrame:
    """(doc_id, score, predicted): mean score over the models, spam where it is above 0."""
    return _labelled(scores.groupBy("doc_id").agg(F.avg("score").alias("a")), F.col("a"))


def ensemble_vote(scores: DataFrame) -> DataFrame:
    """(doc_id, score, predicted): +1 for each model scoring above 0, else -1; spam where the sum is above 0."""
    return _labelled(scores.groupBy("doc_id").agg(F.sum(F.when(F.col("score") > 0, 1.0).otherwise(-1.0)).alias("a")), F.col("a"))


def one_minus_roca(scored: DataFrame) -> DataFrame:
    """(one_minus_roca): 100 * (1 - area under the ROC curve) of (score, y), equal scores counting half.

    Distinct scores are counted first; the running sum goes over score ranges (range-partitioned blocks), never over
    all rows in one task. Null if a class is missing.
    """
    by_score = scored.where("score is not null").groupBy("score").agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    blocks = by_score.repartitionByRange("score").withColumn("block", F.spark_partition_id())
    blocks = written(blocks.select("score", "block", "pos", (F.col("n") - F.col("pos")).alias("neg")))
    per = blocks.groupBy("block").agg(F.sum("neg").alias("b"))
    before = per.withColumn("before", F.coalesce(F.sum("b").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("block", "before")
    inner = F.coalesce(F.sum("neg").over(W.partitionBy("block").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.withColumn("inner", inner).join(before, "block")
    area = F.sum(F.col("pos") * (F.col("before") + F.col("inner") + F.col("neg") / 2)) / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))
    return rows.agg((100 * (1 - area)).alias("one_minus_roca"))
