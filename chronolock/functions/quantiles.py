"""Exact quantiles of keys of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolock.functions.ranking import counted, split

#: Values of a key that one task may hold; those of larger keys are ranked over all tasks.
HELD = 1 << 21


def _ranked(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Quantiles from counted values: the two values round each place, and the line between them."""
    c = counted(rows, keys, value).withColumn("_x", F.col(value).cast("double"))
    aggs = []
    for q in shares:
        place = F.lit(float(q)) * (F.col("total") - 1)
        low = F.floor(place)
        for k, at in enumerate((low, F.least(low + 1, F.col("total") - 1))):
            aggs.append(F.max(F.when((F.col("below") <= at) & (at < F.col("below") + F.col("n")), F.col("_x"))).alias(f"_{k}_{len(aggs) // 2}"))
    wide = c.groupBy(*keys).agg(F.first("total").alias("_total"), *aggs)

    def line(k: int, q: float) -> Column:
        share = F.lit(float(q)) * (F.col("_total") - 1)
        part = share - F.floor(share)
        return F.col(f"_0_{k}") + part * (F.col(f"_1_{k}") - F.col(f"_0_{k}"))

    return wide.select(*keys, F.array(*[line(k, q) for k, q in enumerate(shares)]).alias("q"))


def several(rows: DataFrame, keys: Sequence[str], shares: Mapping[str, Sequence[float]], large: DataFrame | None = None) -> DataFrame:
    """``keys`` and, for each column in ``shares``, ``q_<column>``: its quantiles (linear between the two nearest
    values), nulls left out; keys without a value have null.

    A key is sorted within one aggregate, but for those in ``large`` (:func:`~chronolock.functions.ranking.large_keys`;
    its columns are some of ``keys``), which are ranked over ranges of values
    (:func:`chronolock.functions.ranking.counted`), with the same result."""
    keys = list(keys)
    plain = [F.percentile(c, F.array(*[F.lit(float(q)) for q in qs])).alias(f"q_{c}") for c, qs in shares.items()]
    if large is None:
        return rows.groupBy(*keys).agg(*plain)
    rest, hot = split(rows, large)
    small = rest.groupBy(*keys).agg(*plain)
    wide = hot.select(*keys).distinct()
    for c, qs in shares.items():
        one = _ranked(hot, keys, c, qs).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("q").alias(f"q_{c}"))
        wide = wide.join(one, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
    return small.unionByName(wide)


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], large: DataFrame | None = None) -> DataFrame:
    """``keys, q``: the quantiles of one column, as :func:`several` gives them."""
    return several(rows, keys, {value: shares}, large).withColumnRenamed(f"q_{value}", "q")
