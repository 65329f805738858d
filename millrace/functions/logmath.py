"""Arithmetic on logarithms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow; minus infinity stands for zero."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(high == float("-inf"), high).otherwise(high + F.log1p(F.exp(low - high)))


def signless_zero(x: Column) -> Column:
    """x, with -0.0 turned to 0.0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x)
