"""Which rows count, what is joined to them, and in what order they come out."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labels up to which a grid of sessions and labels is unrolled from one array.
LABELS = 100_000


def drop_discarded(traces: DataFrame, discard: DataFrame, keys: Sequence[str], flag: str = "discard") -> DataFrame:
    """samples that ``discard(keys, i, flag)`` doesn't mark; what it doesn't name stays, and what it names
    beyond a trace counts nothing."""
    marked = discard.where(F.col(flag)).select(*keys, "i").distinct()
    return traces.join(marked, [*keys, "i"], "left_anti")


def drop_empty_channels(traces: DataFrame, keys: Sequence[str], channel: str = "channel") -> DataFrame:
    """F16: channels with a value; of a key that has none at all, the first channel."""
    there = traces.groupBy(*keys, channel).agg(F.count("v").alias("_n"))
    span = W.partitionBy(*keys)  # a row for each channel
    first = (F.max("_n").over(span) == 0) & (F.col(channel) == F.min(channel).over(span))
    kept = there.withColumn("_keep", (F.col("_n") > 0) | first).where("_keep").select(*keys, channel)
    return traces.join(kept, [*keys, channel], "left_semi")


def in_window(rows: DataFrame, start: float, stop: float, time: str = "t") -> DataFrame:
    """rows from ``start`` to ``stop``, both included; a range that reaches the scan."""
    return rows.where((F.col(time) >= start) & (F.col(time) <= stop))


def in_frames(rows: DataFrame, start: float, stop: float, rate: float) -> DataFrame:
    """samples from floor(start * rate), 0 at least, up to ceil(stop * rate), not included."""
    return rows.where((F.col("i") >= max(0, math.floor(start * rate))) & (F.col("i") < math.ceil(stop * rate)))


def kept_only(rows: DataFrame, keep: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """rows of the traces in ``keep``; all without a mask."""
    return rows if keep is None else rows.join(keep.select(*keys).distinct(), list(keys), "left_semi")


def capped(traces: DataFrame, timeline: DataFrame, minutes: float, rate: float, trial: str = "trial") -> DataFrame:
    """``v`` is null from ``minutes`` on of the session's valid samples; ``timeline`` has each trial's
    ``offset`` (W12)."""
    placed = timeline.select("session_id", trial, F.col("offset").alias("_o"))
    return traces.join(placed, ["session_id", trial]).withColumn("v", F.when(F.col("_o") + F.col("i") < math.floor(minutes * 60 * rate), F.col("v"))).drop("_o")


def with_enough(rows: DataFrame, keys: Sequence[str], value: str, least: int, share: float = 0.0) -> DataFrame:
    """keys with ``least`` values or more, which are ``share`` of their rows at least: ``keys, n, finite``."""
    n = rows.groupBy(*keys).agg(F.count(value).alias("n"), (F.count(value) / F.count("*")).alias("finite"))
    return n.where((F.col("n") >= least) & (F.col("finite") >= share))


def parameter(rows: DataFrame, name: str, candidates: Sequence[Column | str], given: object = None) -> DataFrame:
    """``name``: the value given with the call, else the first of the columns that has one, and
    ``name_missing`` where none has."""
    value = F.coalesce(*([F.lit(given)] if given is not None else []), *[F.col(c) if isinstance(c, str) else c for c in candidates])
    return rows.withColumn(name, value).withColumn(f"{name}_missing", F.col(name).isNull())


def enriched(rows: DataFrame, lookup: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``columns`` of a lookup that has each key once; null where it lacks the key.  Spark
    broadcasts a lookup it has found small."""
    return rows.join(lookup.select(*on, *columns), list(on), "left")


def with_suffixes(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """An inner join; columns that both sides have get a suffix each."""
    both = [c for c in left.columns if c in right.columns and c not in on]
    a = left.select(*[F.col(c).alias(c + suffixes[0]) if c in both else F.col(c) for c in left.columns])
    b = right.select(*[F.col(c).alias(c + suffixes[1]) if c in both else F.col(c) for c in right.columns])
    return a.join(b, list(on))


def outer_totals(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two tables of totals as one, by ``key``; null keys meet."""
    b = right.withColumnRenamed(key, "_key")
    return left.join(b, F.col(key).eqNullSafe(F.col("_key")), "full_outer").withColumn(key, F.coalesce(key, "_key")).drop("_key")


def trial_summary(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trials, the share that is valid, mean length and all samples of the valid ones."""
    own = F.when(F.col("valid"), F.col("n_samples"))
    return trials.groupBy(*keys).agg(F.count("*").alias("n_trials"), F.avg(F.col("valid").cast("int")).alias("valid_fraction"), F.avg(own).alias("mean_length"), F.sum(own).alias("total"))


def counts_with_zeros(sessions: DataFrame, events: DataFrame, labels: DataFrame, label: str = "value") -> DataFrame:
    """Events of each label in each session, 0 where there are none.  ``labels`` has each label once."""
    n = events.groupBy("session_id", label).agg(F.count("*").alias("n"))
    own = sessions.select("session_id").distinct()
    if labels.limit(LABELS + 1).count() <= LABELS:  # one array, of a size that has been counted
        grid = own.join(F.broadcast(labels.agg(F.collect_set(label).alias("_all")))).select("session_id", F.explode("_all").alias(label))
    else:
        grid = own.join(labels.select(label))
    return grid.join(n, ["session_id", label], "left").select("session_id", label, F.coalesce("n", F.lit(0)).alias("n"))


def counts_by_depth(traces: DataFrame, depths: DataFrame, roi: str = "roi", depth: str = "depth") -> DataFrame:
    """Traces and samples at each depth."""
    return traces.join(depths.select(roi, depth), roi).groupBy(depth).agg(F.countDistinct(roi).alias("n_rois"), F.count("*").alias("n"))


def adaptation_split(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of sequences that fall (``rlast`` below ``r0``) and those that don't: number, and mean and standard
    error of first, last and change."""
    r = rows.withColumn("adapting", F.col("rlast") < F.col("r0")).withColumn("change", F.col("rlast") - F.col("r0"))
    sides = [(F.avg(c).alias(f"mean_{c}"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"sem_{c}")) for c in ("r0", "rlast", "change")]
    return r.groupBy(*keys, "adapting").agg(F.count("*").alias("n"), *[x for pair in sides for x in pair])


def slope_summary(slopes: DataFrame, keys: Sequence[str], slope: str = "overall", unit: float = 0.001) -> DataFrame:
    """Largest, median and mean size of a trace's slopes; the largest as log10 (null unless positive) and
    by asinh in ``unit``."""
    s = slopes.groupBy(*keys).agg(F.max(F.abs(slope)).alias("max_abs"), F.percentile(F.abs(slope), F.lit(0.5)).alias("median_abs"), F.avg(F.abs(slope)).alias("mean_abs"))
    return s.withColumn("log10_max", F.when(F.col("max_abs") > 0, F.log10("max_abs"))).withColumn("scaled", F.asinh(F.col("max_abs") / unit))


def in_order(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """L1: rows sorted by columns, nulls last, those with a leading ``-`` from the largest."""
    return rows.orderBy(*[F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in by])


def first_rows(rows: DataFrame, by: Sequence[str], n: int, keys: Sequence[str] = ()) -> DataFrame:
    """L2: the first ``n`` rows in an order (:func:`in_order`), of all or of each key."""
    if not keys:
        return in_order(rows, by).limit(n)
    order = [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in by]
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def places(rows: DataFrame, keys: Sequence[str], score: str, roi: str = "roi") -> DataFrame:
    """L3: ``place`` of each trace by its score, largest first, nulls last."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(score), roi)))
