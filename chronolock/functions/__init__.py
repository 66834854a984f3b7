"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def finite(c: str | Column) -> Column:
    """NaN and infinities as null: aggregates then skip them."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def fixed(c: str | Column, digits: int = 4) -> Column:
    """Rounded for comparison across engines; never minus zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def median(c: str | Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return a / F.when(b != 0, b)


def average_rank(value: str, *keys: str) -> Column:
    """Average rank of ``value`` among non-null values of each key: ties share their mean rank."""
    return F.when(F.col(value).isNotNull(), F.rank().over(W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / F.lit(2.0))


def lerp(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The line through two points at ``x``; ``y0`` where both have one x."""
    return F.when(x1 == x0, y0).otherwise(y0 + (x - x0) * (y1 - y0) / F.when(x1 != x0, x1 - x0))
