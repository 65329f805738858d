"""Streaming forms of batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import tokens


def running_word_count(stream: DataFrame, text: str = "value") -> DataFrame:
    """(word, n) over a stream of lines, for output mode `complete` or `update`. Null lines add nothing."""
    return stream.select(F.explode(tokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
