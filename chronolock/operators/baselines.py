"""Slow baselines under a signal: sliding order statistics and the lower envelope of a lattice."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolock.functions import median
from chronolock.functions.blocks import Block, by_blocks


def sliding_rank(x: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The ``rank``-th smallest (from 0) of ``x[left:right]`` for many windows at once.

    Values become dense ranks, whose bits are split from the highest down: at each level zeros move before
    ones, in order, and counts of zeros say where a window's ends go.  A window costs one step a bit,
    whatever its width."""
    values, seq = np.unique(x, return_inverse=True)
    left, right, rank = (np.asarray(a, np.int64).copy() for a in (left, right, rank))
    found = np.zeros(len(left), np.int64)
    for bit in range(max(1, int(len(values) - 1).bit_length()) - 1, -1, -1):
        one = (seq >> bit) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - one)))
        l0, r0 = zeros[left], zeros[right]
        high = rank >= r0 - l0
        found |= high.astype(np.int64) << bit
        rank = np.where(high, rank - (r0 - l0), rank)
        left, right = np.where(high, zeros[-1] + left - l0, l0), np.where(high, zeros[-1] + right - r0, r0)
        seq = np.concatenate((seq[one == 0], seq[one == 1]))
    return values[found]


def window_medians(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Medians of ``x[left:right]`` without NaN; NaN where nothing is there."""
    there = ~np.isnan(x)
    before = np.concatenate(([0], np.cumsum(there)))
    left, right = before[left], before[right]
    n, out = right - left, np.full(len(left), np.nan)
    some = n > 0
    if some.any():
        low, high = (sliding_rank(x[there], left[some], right[some], k) for k in ((n[some] - 1) // 2, n[some] // 2))
        out[some] = (low + high) / 2
    return out


def _means(x: np.ndarray, half: int) -> np.ndarray:
    """Means of full windows of ``2 half + 1``."""
    if not half:
        return x
    mid = x.mean()
    c = np.concatenate(([0.0], np.cumsum(x - mid)))
    w = 2 * half + 1
    return (c[w:] - c[:-w]) / w + mid


def rolling_median(signal: DataFrame, keys: Sequence[str], before: int, after: int, value: str = "v", made: str = "m", zeros: bool = False) -> DataFrame:
    """``made``: the median of a sample, ``before`` and ``after`` it; fewer at the ends, or zeros beyond them
    (and for nulls) as in a median filter."""

    def run(b: Block) -> list[np.ndarray]:
        x = b.column(value)
        pad = max(before, after) if zeros else 0
        if zeros:
            x = np.pad(np.nan_to_num(x), pad)
        at = np.arange(*b.own) + pad
        return [window_medians(x, np.maximum(at - before, 0), np.minimum(at + after + 1, len(x)))]

    return by_blocks(signal, keys, max(before, after), {made: "double"}, run)


def percentile_baseline(signal: DataFrame, keys: Sequence[str], half: int, q: float, smooth_half: int, eps: float = 1e-6) -> DataFrame:
    """``base``: nulls take the series' median (0 if it has none); the q-th order statistic of a moving
    window, whose ends are mirrored with the end sample; then a moving mean, whose ends are mirrored
    without it; at least ``eps``."""
    mid = signal.groupBy(*keys).agg(median("v").alias("_mid")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_mid")
    filled = signal.join(mid, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).select(*signal.columns, F.coalesce("v", "_mid", F.lit(0.0)).cast("double").alias("_filled"))
    rank = min(int((2 * half + 1) * q / 100), 2 * half)

    def run(b: Block) -> list[np.ndarray]:
        x = b.column("_filled")
        lead, tail = (half if b.starts else 0), (half if b.ends else 0)
        low, high = (0 if b.starts else b.own[0] - smooth_half), (len(x) if b.ends else b.own[1] + smooth_half)
        at = np.arange(low, high) + lead
        base = sliding_rank(np.pad(x, (lead, tail), mode="symmetric"), at - half, at + half + 1, np.full(len(at), rank))
        base = np.pad(base, (smooth_half if b.starts else 0, smooth_half if b.ends else 0), mode="reflect")
        first = b.own[0] if b.starts else 0  # of the smoothed ones, which begin at the first own or at the series' first
        return [np.maximum(_means(base, smooth_half)[first : first + b.own[1] - b.own[0]], eps)]

    return by_blocks(filled, keys, half + smooth_half, {"base": "double"}, run).drop("_filled")


def _pchip(order, x: str, y: str) -> Column:
    """The slope at a point of the monotone cubic through the points of a window: a weighted harmonic mean
    of the slopes on either side, 0 at turns; at the ends by three points, held to the shape."""

    def step(k: int) -> tuple[Column, Column]:
        """Width and slope from the k-th point ahead to the one after."""

        def at(c: str, j: int) -> Column:
            return F.lead(c, j).over(order) if j > 0 else F.lag(c, -j).over(order) if j < 0 else F.col(c)

        h = at(x, k + 1) - at(x, k)
        return h, (at(y, k + 1) - at(y, k)) / h

    (h0, m0), (h1, m1), (hb, mb), (hc, mc) = step(-1), step(0), step(1), step(-2)

    def end(h: Column, m: Column, h2: Column, m2: Column) -> Column:
        d = ((2 * h + h2) * m - h * m2) / (h + h2)
        return F.when(m2.isNull(), m).when(F.signum(d) != F.signum(m), 0.0).when((F.signum(m) != F.signum(m2)) & (F.abs(d) > 3 * F.abs(m)), 3 * m).otherwise(d)

    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    inner = F.when(m0 * m1 <= 0, 0.0).otherwise((w1 + w2) / (w1 / m0 + w2 / m1))
    return F.when(m0.isNull(), end(h1, m1, hb, mb)).when(m1.isNull(), end(h0, m0, hc, mc)).otherwise(inner)


def lower_envelope(signal: DataFrame, keys: Sequence[str], denoise: int, hull: int) -> DataFrame:
    """``keys, i, base``: the lower envelope of the series, a row for each sample from the first to the last.

    The rolling median (``denoise`` samples) is read at a lattice of points.  Every n-th of these, from each
    of n starts (n spans ``hull`` samples), makes a line through the lattice; the least of the lines counts,
    where half of them at least are there.  Then gaps are filled and smoothed by moving means, and a
    monotone cubic leads back to every sample.  Series of fewer than 4 samples have their mean.  Places are
    0, 1, 2, ...; each step sees a bounded stretch of a series."""
    keys = list(keys)
    spacing = max(4.0, denoise / 6)
    widest = max(1, math.ceil(hull / spacing))
    named = [F.col(k).alias(f"_{k}") for k in keys]
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    size = signal.groupBy(*named).agg(F.count("*").alias("_n"), F.avg("v").alias("_mean"))
    size = size.withColumn("_points", F.ceil(F.col("_n") / spacing) + 1).withColumn("_phases", F.ceil(F.least(F.lit(hull), F.floor(F.col("_n") / 4)) / spacing).cast("int"))
    size = size.withColumn("_step", (F.col("_n") - 1) / (F.col("_points") - 1))
    smooth = rolling_median(signal.select(*keys, "i", "v"), keys, denoise // 2, (denoise - 1) // 2).join(size, on).drop(*[f"_{k}" for k in keys])
    short = smooth.where("_n < 4").select(*keys, F.col("i").cast("long").alias("i"), F.col("_mean").alias("base"))
    j = F.rint(F.col("i") / F.col("_step"))
    lattice = smooth.where("_n >= 4").withColumn("j", j.cast("long")).where(F.rint(j * F.col("_step")) == F.col("i"))
    lattice = lattice.select(*keys, "j", F.col("i").cast("long").alias("t"), "m", F.col("_points").cast("long").alias("_points"), "_phases")

    def lines(b: Block) -> list[np.ndarray]:
        j, t, m = (b.column(c) for c in ("j", "t", "m"))
        n, last, first = int(b.column("_phases")[0]), int(b.column("_points")[0]) - 1, int(j[0])
        own = np.arange(*b.own)
        least, there = np.full(len(own), np.inf), np.zeros(len(own))
        for d in range(n):
            low = own + first - (own + first - d) % n  # the line's point at or before
            high = np.where(low == own + first, low, low + n)
            ok = (low >= 0) & (high <= last)
            lo, hi = np.clip(low - first, 0, len(t) - 1), np.clip(high - first, 0, len(t) - 1)
            with np.errstate(invalid="ignore", divide="ignore"):
                y = np.where(lo == hi, m[lo], m[lo] + (t[own] - t[lo]) * (m[hi] - m[lo]) / (t[hi] - t[lo]))
            ok &= ~np.isnan(y)
            least[ok] = np.minimum(least[ok], y[ok])
            there += ok
        return [np.where(there > 0, least, np.nan), there]

    drawn = by_blocks(lattice, keys, widest, {"low": "double", "there": "bigint"}, lines, "j")
    sure = F.col("there") >= F.ceil(F.col("_phases") / 2)
    enough = drawn.groupBy(*named).agg((F.count_if(sure) > 2).alias("_enough"))
    drawn = drawn.join(enough, on).withColumn("low", F.when(sure | ~F.col("_enough"), F.col("low"))).drop("_enough", *[f"_{k}" for k in keys])
    order = W.partitionBy(*keys).orderBy("j")
    # half of the moving mean: the lines' number over 2, rounded up; it differs between series only if they are short
    near = F.array(*[F.avg("low").over(order.rowsBetween(-h, h)) for h in range(1, (widest + 1) // 2 + 1)])
    pick = F.ceil(F.col("_phases") / 2).cast("int")
    for c in (F.coalesce("low", F.element_at(near, pick)), F.element_at(near, pick)):
        drawn = drawn.withColumn("low", c)
    back = W.partitionBy(*keys).orderBy(F.desc("j")).rowsBetween(W.unboundedPreceding, 0)
    own = F.when(F.col("low").isNotNull(), F.struct("t", "low"))
    drawn = drawn.withColumn("_b", F.last(own, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_a", F.last(own, ignorenulls=True).over(back))
    line = F.when(F.col("_b.t") < F.col("_a.t"), F.col("_b.low") + (F.col("t") - F.col("_b.t")) * (F.col("_a.low") - F.col("_b.low")) / (F.col("_a.t") - F.col("_b.t")))
    drawn = drawn.withColumn("f", F.coalesce("low", line, "_b.low", "_a.low"))
    cubic = drawn.withColumn("d", _pchip(order, "t", "f"))
    for c in ("t", "f", "d"):
        cubic = cubic.withColumn(f"{c}1", F.lead(c).over(order))
    each = cubic.select(*keys, "t", "f", "d", "t1", "f1", "d1", F.explode(F.sequence("t", F.coalesce(F.col("t1") - 1, "t"))).alias("i"))
    h = F.col("t1") - F.col("t")
    s = (F.col("i") - F.col("t")) / h
    at = F.col("f") * (1 + 2 * s) * (1 - s) * (1 - s) + F.col("d") * h * s * (1 - s) * (1 - s) + F.col("f1") * s * s * (3 - 2 * s) + F.col("d1") * h * s * s * (s - 1)
    return each.select(*keys, "i", F.when(h.isNull(), F.col("f")).otherwise(at).alias("base")).unionByName(short)


def savitzky_golay(signal: DataFrame, keys: Sequence[str], half: int, degree: int = 3, value: str = "v") -> DataFrame:
    """``smooth``: a polynomial of ``degree`` fitted to a sample and ``half`` on either side, at the
    sample; within ``half`` of an end, the polynomial of the first or last window.  Null where a window
    holds a null, and in series shorter than a window."""
    width = 2 * half + 1
    powers = np.vander(np.arange(-half, half + 1) / max(half, 1), degree + 1)
    hat = powers @ np.linalg.pinv(powers)  # row p: the weights of the window's samples for place p

    def run(b: Block) -> list[np.ndarray]:
        x, out = b.column(value), np.full(b.own[1] - b.own[0], np.nan)
        if len(x) < width:
            return [out]
        smooth = np.full(len(x), np.nan)
        smooth[half : len(x) - half] = np.convolve(x, hat[half][::-1], mode="valid")
        if b.starts:
            smooth[:half] = hat[:half] @ x[:width]
        if b.ends:
            smooth[len(x) - half :] = hat[half + 1 :] @ x[-width:]
        return [smooth[slice(*b.own)]]

    return by_blocks(signal, keys, 2 * half, {"smooth": "double"}, run)
