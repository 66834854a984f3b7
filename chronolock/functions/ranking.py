"""Ranks and running sums of hot keys: two passes over counted values, never one window a key.

A window orders all rows of a key in one task.  Here equal values are counted first, the counts are dealt
to ranges of (key, value), each range adds up its own, and what lies before a range comes from the
totals of the ranges, of which only a key that spans several has more than one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolock.functions.lineage import settled


def _ranges(rows: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """``rows`` with ``_at``, the range of (keys, value) that a row is in; settled, so it stays."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(rows.repartitionByRange(n, *keys, value).withColumn("_at", F.spark_partition_id()))


def counted(rows: DataFrame, keys: Sequence[str], value: str, deal: Column | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """``keys, value, n, below, total``: for each distinct non-null value its rows, the rows of the key with
    smaller values, and all rows of the key; and the aggregates ``more`` of the value's rows.

    Rows of one value are counted before they move.  A key of all rows spreads over all ranges: of it each
    range has one total, so the windows over totals have as many rows as there are ranges.  Null keys
    are a key of their own.  ``deal`` cuts the ranges where values are long: it must not fall where the
    value rises."""
    return _added(_counts(rows, keys, value, more), keys, value, "n", deal)


def _added(rows: DataFrame, keys: Sequence[str], value: str, what: str, deal: Column | None = None) -> DataFrame:
    """``rows``, one for each key and value, with the sums of ``what`` below each and of the key."""
    at = _ranges(rows, keys, value if deal is None else deal)
    names = rows.columns
    inside = W.partitionBy("_at", *keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    totals = at.groupBy("_at", *keys).agg(F.sum(what).alias("_n"))
    span = W.partitionBy(*keys)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(span.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("_n").over(span))
    there = totals.select(F.col("_at").alias("_t"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before", "total")
    on = [F.col("_at") == F.col("_t"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    local = at.withColumn("_local", F.coalesce(F.sum(what).over(inside), F.lit(0)))
    return local.join(there, on).select(*names, (F.col("_local") + F.col("_before")).alias("below"), "total")


def _counts(rows: DataFrame, keys: Sequence[str], value: str, more: Sequence[Column]) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), *more)


def split(rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the keys that are not in ``large`` (some of their columns), and of those that are."""
    if large.columns == ["_all"]:  # no keys: all rows are one
        return rows.where(F.lit(False)), rows
    named = large.select(*[F.col(k).alias(f"_{k}") for k in large.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in large.columns]
    return rows.join(named, on, "left_anti"), rows.join(named, on, "left_semi")


def large_keys(rows: DataFrame, keys: Sequence[str], value: str, held: int) -> DataFrame | None:
    """The keys of more than ``held`` values; None where there are none."""
    found = rows.groupBy(*keys).agg(F.count(value).alias("_n")).where(F.col("_n") > held)
    return settled(found.select(*keys) if keys else found.select(F.lit(True).alias("_all"))) if found.limit(1).count() else None


def running(rows: DataFrame, keys: Sequence[str], value: str, what: str, large: DataFrame | None) -> DataFrame:
    """``rows``, one for each key and value, with ``below`` and ``total``: the sums of ``what`` over smaller values
    and over the key.  Only the keys in ``large`` (:func:`large_keys`) go by ranges; each other key is added
    up in one window."""
    small, hot = (rows, None) if large is None else split(rows, large)
    order = W.partitionBy(*keys).orderBy(value)
    c = small.withColumn("below", F.coalesce(F.sum(what).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum(what).over(W.partitionBy(*keys)))
    return c if hot is None else c.unionByName(_added(hot, keys, value, what))


def ranked(rows: DataFrame, keys: Sequence[str], value: str, large: DataFrame | None, more: Sequence[Column] = ()) -> DataFrame:
    """As :func:`counted`, but only the keys in ``large`` go by ranges."""
    return running(_counts(rows, keys, value, more), keys, value, "n", large)


def suffix_least(rows: DataFrame, keys: Sequence[str], value: str, what: str, large: DataFrame | None) -> DataFrame:
    """As :func:`least_from`, but only the keys in ``large`` go by ranges."""
    small, hot = (rows, None) if large is None else split(rows, large)
    c = small.withColumn("least", F.min(what).over(W.partitionBy(*keys).orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, 0)))
    return c if hot is None else c.unionByName(least_from(hot, keys, value, what))


def least_from(rows: DataFrame, keys: Sequence[str], value: str, what: str) -> DataFrame:
    """``rows`` with ``least``: the smallest ``what`` of the rows of the key with this or a larger value.

    ``rows`` has one row for each key and value."""
    at = _ranges(rows, keys, value)
    totals = at.groupBy("_at", *keys).agg(F.min(what).alias("_n"))
    after = F.min("_n").over(W.partitionBy(*keys).orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, -1))
    there = totals.withColumn("_after", after).select(F.col("_at").alias("_t"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_after")
    on = [F.col("_at") == F.col("_t"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    local = at.withColumn("_local", F.min(what).over(W.partitionBy("_at", *keys).orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, 0)))
    return local.join(there, on).withColumn("least", F.least("_local", "_after")).select(*rows.columns, "least")
