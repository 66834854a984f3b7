"""Clock alignment: times of a display log carried to the clock of a sampled device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolock.functions.lineage import settled
from chronolock.operators.events import photodiode_state
from chronolock.operators.signals import debounce, edges, train_segments
from chronolock.operators.statistics import affine, best_shift, phase_alignment
from chronolock.operators.windows import ordinal_pairs, piecewise_warp

#: Order in which modes win ties.
MODES = ("previous", "midpoint", "current")


def rises(log: DataFrame) -> DataFrame:
    """Times at which the photodiode's state rises between frames, in three modes: at the frame that
    shows it, at the one before, or midway."""
    frames = photodiode_state(log).where("lower(value) = 'frame'")
    order = W.partitionBy("session_id").orderBy("row_idx")
    f = frames.withColumn("last_state", F.lag("photodiode_state").over(order)).withColumn("last_t", F.lag("t").over(order))
    up = f.where("photodiode_state = 1 and last_state = 0")
    at = F.array(F.struct(F.lit("previous").alias("mode"), F.col("last_t").alias("t")), F.struct(F.lit("midpoint").alias("mode"), ((F.col("last_t") + F.col("t")) / 2).alias("t")), F.struct(F.lit("current").alias("mode"), F.col("t").alias("t")))
    return up.select("session_id", F.explode(at).alias("x")).select("session_id", "x.mode", "x.t")


def best_mode(found: DataFrame, device: DataFrame) -> DataFrame:
    """Per session the mode whose rises fit the device's edges best along a line."""
    fits = None
    for n, mode in enumerate(MODES):
        one = affine(ordinal_pairs(found.where(F.col("mode") == mode), device), ["session_id"]).withColumn("mode", F.lit(mode)).withColumn("place", F.lit(n))
        fits = one if fits is None else fits.unionByName(one)
    return fits.groupBy("session_id").agg(F.min_by(F.struct("mode", "slope", "intercept", "rmse", "n"), F.struct("rmse", "place")).alias("x")).select("session_id", "x.*")


def frame_numbers(log: DataFrame) -> DataFrame:
    """Times of the frames and their numbers: column ``frame`` if the log has it, else their place."""
    frames = log.where("lower(value) = 'frame'")
    if "frame" not in log.columns:
        frames = frames.withColumn("frame", F.row_number().over(W.partitionBy("session_id").orderBy("row_idx")) - 1)
    return frames.select("session_id", "t", F.col("frame").cast("long").alias("frame"))


def _paired(own: DataFrame, device: DataFrame, reach: int) -> DataFrame:
    """Pairs ``src, dst`` of rises in the mode and at the shift whose intervals agree best."""
    shifts = None
    for n, mode in enumerate(MODES):
        one = best_shift(own.where(F.col("mode") == mode), device, reach=reach).withColumn("mode", F.lit(mode)).withColumn("place", F.lit(n))
        shifts = one if shifts is None else shifts.unionByName(one)
    best = shifts.groupBy("session_id").agg(F.min_by(F.struct("mode", "shift", "rmse"), F.struct("rmse", "place")).alias("x")).select("session_id", "x.mode", "x.shift", F.col("x.rmse").alias("interval_rmse"))
    order = W.partitionBy("session_id").orderBy("t")
    a = own.join(best, ["session_id", "mode"]).select("session_id", "mode", "interval_rmse", F.col("t").alias("src"), (F.row_number().over(order) + F.col("shift")).alias("m"))
    b = device.select("session_id", F.row_number().over(order).alias("m"), F.col("t").alias("dst"))
    return a.join(b, ["session_id", "m"]).drop("m")


def align(log: DataFrame, samples: DataFrame, reach: int = 10, least_cover: float = 0.5, warp: bool = True, period: int = 30, separation: float = 0.005, least_edges: int = 80) -> tuple[DataFrame, DataFrame]:
    """``log`` with ``t_corr`` on the device's clock and ``alignment_method``, and a record a session.

    A session whose log shows the photodiode pairs its rises with the device's at the best shift:
    ``piecewise`` times between them, or ``affine`` ones along their line without ``warp``.  Any other
    takes the line from every ``period``-th frame to the device's edges (T9): ``frames``.  Times are
    null where the device's recording covers less than ``least_cover`` of the log (``short recording``)
    or nothing pairs (``no pairs``).  The record has the line in seconds from ``log_zero`` (the first
    frame, or row) and ``device_zero``, pairs, errors, mode, phase, segment, start and durations."""
    key = "session_id"
    zero = log.groupBy(key).agg(F.coalesce(F.min(F.when(F.lower("value") == "frame", F.col("t"))), F.min("t")).alias("log_zero"), F.max("t").alias("_last"))
    there = samples.groupBy(key).agg(F.min("t").alias("device_zero"), F.max("t").alias("_stop"))
    span = zero.join(there, key, "left").select(key, "log_zero", "device_zero", (F.col("_last") - F.col("log_zero")).alias("log_s"), (F.col("_stop") - F.col("device_zero")).alias("device_s"))
    span = settled(span)
    log0 = log.join(span.select(key, "log_zero"), key).withColumn("t", F.col("t") - F.col("log_zero")).drop("log_zero")
    found = edges(samples, [key]).join(span.select(key, "device_zero"), key).select(key, (F.col("t") - F.col("device_zero")).alias("t"), "step")
    found = settled(found)
    rising, either = (debounce(x.select(key, "t"), key, separation) for x in (found.where("step = 1"), found))
    pairs = settled(_paired(rises(log0), rising, reach))
    one = affine(pairs, [key]).join(pairs.groupBy(key).agg(F.first("mode").alias("mode"), F.first("interval_rmse").alias("interval_rmse")), key)
    one = settled(one.select(key, "n", "slope", "intercept", "rmse", "interval_rmse", "mode", *[F.lit(None).cast("long").alias(c) for c in ("phase", "segment", "start")]))
    either = settled(either.join(one, key, "left_anti"))
    parts = train_segments(either, key, least=least_edges).select(key, "segment", F.col("start").alias("_a"), F.col("stop").alias("_b"))
    placed = either.join(parts, key).where(F.col("t").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    two = phase_alignment(frame_numbers(log0.join(one, key, "left_anti")), placed, period, key)
    two = two.select(key, "n", "slope", "intercept", "rmse", F.lit(None).cast("double").alias("interval_rmse"), F.lit(None).cast("string").alias("mode"), *[F.col(c).cast("long").alias(c) for c in ("phase", "segment", "start")])
    lines = one.withColumn("way", F.lit("piecewise" if warp else "affine")).unionByName(two.withColumn("way", F.lit("frames")))
    how = F.when(F.coalesce("device_s", F.lit(0.0)) < least_cover * F.col("log_s"), "short recording").otherwise(F.coalesce("way", F.lit("no pairs")))
    record = settled(span.join(lines, key, "left").withColumn("alignment_method", how).drop("way"))
    line = F.col("slope") * (F.col("t") - F.col("log_zero")) + F.col("intercept") + F.col("device_zero")
    out = log.join(record.select(key, "alignment_method", "slope", "intercept", "log_zero", "device_zero"), key, "left")
    if warp:
        own = pairs.join(one.select(key), key, "left_semi").select(key, "src", "dst")
        out = out.join(piecewise_warp(log0, own).select(key, "row_idx", "warped"), [key, "row_idx"], "left")
        line = F.when(F.col("alignment_method") == "piecewise", F.col("warped") + F.col("device_zero")).when(F.col("alignment_method") == "frames", line)
    else:
        line = F.when(F.col("alignment_method").isin("affine", "frames"), line)
    return out.withColumn("t_corr", line).select(*log.columns, "t_corr", "alignment_method"), record
