"""Sampled signals: edges, epochs, conditioning and baselines, one window per series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolock.functions import lerp, median
from chronolock.functions.blocks import Block, by_blocks
from chronolock.operators.baselines import rolling_median


def _order(keys: list[str]):
    return W.partitionBy(*keys).orderBy("i")


def median_filter(keys: list[str], half: int, value: str = "v") -> Column:
    """Median of a sample and ``half`` on either side; samples beyond the ends are 0, as in a median
    filter."""
    frame = _order(keys).rowsBetween(-half, half)
    values = F.collect_list(F.coalesce(F.col(value), F.lit(0.0))).over(frame)
    full = F.concat(values, F.array_repeat(F.lit(0.0), F.lit(2 * half + 1) - F.size(values)))
    return F.element_at(F.array_sort(full), half + 1)


def edges(signal: DataFrame, keys: list[str], half: int = 4) -> DataFrame:
    """Rises and falls of the median-filtered signal across the middle of its 5th and 95th
    percentiles; a value that is above the middle by rounding error only is not above it."""
    smooth = signal.withColumn("m", median_filter(keys, half))
    level = smooth.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.05), F.lit(0.95))).alias("p")).select(*[F.col(k).alias(f"_{k}") for k in keys], ((F.col("p")[0] + F.col("p")[1]) / 2 + 1e-12 * (F.abs(F.col("p")[0]) + F.abs(F.col("p")[1]))).alias("threshold"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    binary = smooth.join(level, on).withColumn("b", (F.col("m") > F.col("threshold")).cast("int"))
    step = F.col("b") - F.lag("b").over(_order(keys))
    return binary.withColumn("step", step).where("step <> 0").select(*keys, "i", "t", "step")


def debounce(times: DataFrame, key: str, separation: float) -> DataFrame:
    """An edge stays if it comes over ``separation`` after the last that stayed.

    Edges whose gap to the one before is larger stay whatever came before them, and each of them starts
    a burst of its own; only bursts, a few edges each, are folded."""
    order = W.partitionBy(key).orderBy("t")
    gap = times.where("t is not null").select(key, "t").withColumn("gap", F.col("t") - F.lag("t").over(order))
    bursts = gap.withColumn("burst", F.sum((F.col("gap").isNull() | (F.col("gap") > separation)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    start = F.array().cast("array<double>")
    far = lambda acc, x: (F.size(acc) == 0) | (x - F.element_at(acc, -1) > separation)
    kept = F.aggregate(F.array_sort(F.collect_list("t")), start, lambda acc, x: F.when(far(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return bursts.groupBy(key, "burst").agg(kept.alias("kept")).select(key, F.explode("kept").alias("t"))


def edge_summary(times: DataFrame, key: str) -> DataFrame:
    """Edges of a train, their median, 95th percentile and longest interval, and the display rate
    (30 frames a period)."""
    gap = times.withColumn("gap", F.lead("t").over(W.partitionBy(key).orderBy("t")) - F.col("t"))
    out = gap.groupBy(key).agg(F.count("*").alias("n_edges"), F.percentile("gap", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.max("gap").alias("longest"))
    return out.select(key, "n_edges", F.col("p")[0].alias("median_gap"), F.col("p")[1].alias("p95_gap"), "longest", (30 / F.when(F.col("p")[0] != 0, F.col("p")[0])).alias("rate_hz"))


def train_segments(times: DataFrame, key: str, factor: float = 1.5, gap_s: float = 1.5, least: int = 50) -> DataFrame:
    """Stretches of an edge train between gaps longer than ``factor`` medians and ``gap_s``; those of
    ``least`` edges stay, and always the first."""
    order = W.partitionBy(key).orderBy("t")
    gap = times.withColumn("gap", F.col("t") - F.lag("t").over(order))
    usual = gap.groupBy(key).agg(median("gap").alias("usual")).withColumnRenamed(key, "_key")
    flagged = gap.join(usual, F.col(key) == F.col("_key")).withColumn("cut", ((F.col("gap") > factor * F.col("usual")) & (F.col("gap") > gap_s)).cast("int"))
    part = flagged.withColumn("segment", F.coalesce(F.sum("cut").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    return part.groupBy(key, "segment").agg(F.count("*").alias("n_edges"), F.min("t").alias("start"), F.max("t").alias("stop")).where((F.col("n_edges") >= least) | (F.col("segment") == 0))


def _runs(signal: DataFrame, key: str) -> DataFrame:
    """Runs of true: first sample, the sample after the last, and their times."""
    order = W.partitionBy(key).orderBy("i")
    marked = signal.withColumn("next_t", F.coalesce(F.lead("t").over(order), F.col("t"))).where("b").withColumn("island", F.col("i") - F.row_number().over(order))
    return marked.groupBy(key, "island").agg(F.min("i").alias("start_idx"), (F.max("i") + 1).alias("end_idx"), F.min("t").alias("start_time"), F.max("next_t").alias("end_time")).drop("island")


def epochs(signal: DataFrame, key: str = "session_id", gap: float = 0.05, least: float = 5.0, mode: str = "trial") -> DataFrame:
    """Stretches in which a digital line (``b``) is on.  ``trial``: runs with a gap of ``gap`` or less
    are one, those shorter than ``least`` go; ``continuous``: from the first start to the last end."""
    runs = _runs(signal, key)
    if mode == "continuous":
        whole = runs.groupBy(key).agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
        return whole.withColumn("duration_s", F.col("end_time") - F.col("start_time"))
    order = W.partitionBy(key).orderBy("start_idx")
    cut = (F.col("start_time") - F.lag("end_time").over(order) > gap).cast("int")
    merged = runs.withColumn("cut", F.coalesce(cut, F.lit(0))).withColumn("part", F.sum("cut").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = merged.groupBy(key, "part").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).drop("part")
    return out.withColumn("duration_s", F.col("end_time") - F.col("start_time")).where(F.col("duration_s") >= least)


def adaptive_gap(signal: DataFrame, target: int, grid: list[float], least: float = 0.0, key: str = "session_id") -> DataFrame:
    """The smallest gap of ``grid`` for which a session has ``target`` epochs or more, null if none
    has; the grid bounds the search."""
    runs = _runs(signal, key).withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    order = W.partitionBy(key, "threshold").orderBy("start_idx")
    cut = F.coalesce((F.col("start_time") - F.lag("end_time").over(order) > F.col("threshold")).cast("int"), F.lit(0))
    merged = runs.withColumn("cut", cut).withColumn("part", F.sum("cut").over(order.rowsBetween(W.unboundedPreceding, 0)))
    counted = merged.groupBy(key, "threshold", "part").agg((F.max("end_time") - F.min("start_time")).alias("d")).groupBy(key, "threshold").agg(F.count(F.when(F.col("d") >= least, 1)).alias("n"))
    return counted.groupBy(key).agg(F.min(F.when(F.col("n") >= target, F.col("threshold"))).alias("gap"))


def shift_epochs(found: DataFrame, offsets: DataFrame, key: str = "session_id") -> DataFrame:
    """Epochs moved by their session's offset."""
    both = found.join(offsets.select(F.col(key).alias("_key"), "offset"), F.col(key) == F.col("_key")).drop("_key")
    return both.withColumn("start_time", F.col("start_time") + F.col("offset")).withColumn("end_time", F.col("end_time") + F.col("offset")).drop("offset")


def epoch_summary(found: DataFrame, key: str = "session_id") -> DataFrame:
    """Epochs of a session: number, mean and listed durations, and whether there are any."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_time", "duration_s"))), lambda x: F.round(x["duration_s"], 3).cast("string")), ";")
    return found.groupBy(key).agg(F.count("*").alias("n_epochs"), F.avg("duration_s").alias("mean_s"), listed.alias("durations")).withColumn("passed", F.col("n_epochs") > 0)


def sample_checks(signal: DataFrame, key: str = "session_id") -> DataFrame:
    """Whether sample times never fall, and the signal's range."""
    step = signal.withColumn("d", F.col("t") - F.lag("t").over(W.partitionBy(key).orderBy("i")))
    return step.groupBy(key).agg(F.coalesce(F.min("d") >= 0, F.lit(True)).alias("monotonic"), (F.max("v") - F.min("v")).alias("span"), F.max(F.col("b")).alias("ever_on"))


def rolling_mean_valid(signal: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Means of full windows of ``window`` samples, by the last sample; nulls don't count."""
    order = _order(keys)
    return signal.withColumn("mean", F.avg("v").over(order.rowsBetween(1 - window, 0))).withColumn("rn", F.row_number().over(order)).where(F.col("rn") >= window).drop("rn")


def peak_response(windows: DataFrame, keys: list[str], pre: tuple[int, int], post: tuple[int, int], window: int) -> DataFrame:
    """The largest rolling mean within ``post`` less the mean of ``pre``."""
    inside = windows.where((F.col("k") >= post[0]) & (F.col("k") < post[1])).select(*keys, F.col("k").alias("i"), "v")
    peak = rolling_mean_valid(inside, keys, window).groupBy(*keys).agg(F.max("mean").alias("peak"))
    base = windows.where((F.col("k") >= pre[0]) & (F.col("k") < pre[1])).groupBy(*keys).agg(F.avg("v").alias("base"))
    return peak.join(base, keys, "left").select(*keys, (F.col("peak") - F.col("base")).alias("response"))


def trailing_mean(keys: list[str], window: int) -> Column:
    """Mean of a sample and those before it, ``window`` at most."""
    return F.avg("v").over(_order(keys).rowsBetween(1 - window, 0))


def centered_mean(keys: list[str], half: int, value: str = "v") -> Column:
    """Mean of a sample and ``half`` on either side, fewer at the ends."""
    return F.avg(value).over(_order(keys).rowsBetween(-half, half))


def reflected_mean(signal: DataFrame, keys: list[str], half: int, value: str = "v") -> DataFrame:
    """``smooth``: the moving mean with both ends reflected (sample -j is sample j).

    A sample near an end becomes the rows it stands for: no union of the signal with its ends, whose sides
    Spark may deal to partitions differently."""
    n = signal.groupBy(*keys).agg(F.max("i").alias("last"))
    place = lambda i, own: F.struct(i.cast("long").alias("i"), F.lit(own).alias("own"))
    i, last = F.col("i"), F.col("last")
    left, right = i.between(1, half), (i < last) & (i >= last - half)
    places = F.filter(F.array(place(i, True), F.when(left, place(-i, False)), F.when(right, place(2 * last - i, False))), lambda x: x.isNotNull())
    kind = signal.schema["i"].dataType
    every = signal.join(n, keys).withColumn("_at", F.explode(places)).withColumns({"i": F.col("_at.i").cast(kind), "own": F.col("_at.own")}).drop("_at")
    return every.withColumn("smooth", centered_mean(keys, half, value)).where("own").drop("own", "last")


def floor_baseline(signal: DataFrame, keys: list[str], share: float = 0.05, least_finite: float = 0.5, eps: float = 1e-6) -> DataFrame:
    """``f0``: ``base`` raised to a share of the series' 20th percentile; null where the signal is, and
    everywhere if too little of it is there."""
    stats = signal.groupBy(*keys).agg(F.percentile("v", F.lit(0.2)).alias("p20"), (F.count("v") / F.count("*")).alias("finite"))
    f0 = F.when(F.col("v").isNotNull() & (F.col("finite") >= least_finite), F.greatest("base", F.greatest(F.lit(eps), F.lit(share) * F.col("p20"))))
    return signal.join(stats, keys).withColumn("f0", f0).drop("p20", "finite")


def hull_baseline(signal: DataFrame, keys: list[str], denoise: int, hull: int) -> DataFrame:
    """``base``: rolling median, its minimum over a window, and a moving mean."""
    m = signal.withColumn("m", F.percentile("v", F.lit(0.5)).over(_order(keys).rowsBetween(-denoise, denoise)))
    low = m.withColumn("low", F.min("m").over(_order(keys).rowsBetween(-hull, hull)))
    return low.withColumn("base", centered_mean(keys, hull, "low")).drop("m", "low")


def mask_artifacts(signal: DataFrame, keys: list[str], times: float = 20.0, before: int = 10, after: int = 9) -> DataFrame:
    """``clean``: null round steps larger than the median step by ``times`` deviations: from ``before``
    samples before the step to ``after`` after.  The first and last steps are not tested."""
    order = _order(keys)
    d = signal.withColumn("d", F.lead("v").over(order) - F.col("v")).withColumn("inner", F.lag(F.lit(1)).over(order).isNotNull() & F.lead(F.lit(1), 2).over(order).isNotNull())
    stats = d.groupBy(*keys).agg(median("d").alias("mid"), F.stddev_pop("d").alias("sd"))
    flag = ((F.abs("d") > F.col("mid") + times * F.col("sd")) & F.col("inner")).cast("int")
    marked = d.join(stats, keys).withColumn("flag", F.coalesce(flag, F.lit(0)))
    near = F.max("flag").over(order.rowsBetween(-after, before))
    return marked.withColumn("clean", F.when(near == 0, F.col("v"))).drop("d", "inner", "mid", "sd", "flag")


def zscored(signal: DataFrame, keys: list[str], value: str = "v", eps: float = 1e-12) -> DataFrame:
    """``z``; a constant series gives 0."""
    s = signal.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return signal.join(s, keys).withColumn("z", F.when(F.col("_s") > eps, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0) * F.col(value))).drop("_m", "_s")


def high_pass(signal: DataFrame, keys: list[str], half: int, value: str = "v") -> DataFrame:
    """``hp``: the series less its moving mean, as z-scores."""
    smooth = reflected_mean(signal, keys, half, value).withColumn("_r", F.col(value) - F.col("smooth")).drop("smooth")
    return zscored(smooth, keys, "_r").withColumnRenamed("z", "hp").drop("_r")


def unmix(pairs: DataFrame, keys: list[str], ridge: float = 1e-6, least_finite: float = 0.5) -> DataFrame:
    """``clean``: series ``y`` less its slope on nuisance ``x``, by least squares with a small ridge on
    the slope; left alone where too few pairs are there."""
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    one = lambda e: F.sum(F.when(both, e))
    s = pairs.groupBy(*keys).agg(F.count(F.when(both, 1)).alias("n"), F.count("*").alias("rows"), one(F.col("x")).alias("sx"), one(F.col("y")).alias("sy"), one(F.col("x") * F.col("x")).alias("sxx"), one(F.col("x") * F.col("y")).alias("sxy"))
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * (F.col("sxx") + ridge) - F.col("sx") * F.col("sx"))
    s = s.select(*keys, F.when(F.col("n") >= least_finite * F.col("rows"), slope).otherwise(0.0).alias("slope"))
    return pairs.join(s, keys).withColumn("clean", F.col("y") - F.col("slope") * F.coalesce("x", F.lit(0.0)))


def gradient(keys: list[str], value: str = "v") -> Column:
    """Half the step across each sample; the whole step at the ends."""
    order = _order(keys)
    back, ahead, own = F.lag(value).over(order), F.lead(value).over(order), F.col(value)
    return F.when(back.isNull(), ahead - own).when(ahead.isNull(), own - back).otherwise((ahead - back) / 2)


def motion_regressors(motion: DataFrame, keys: list[str]) -> DataFrame:
    """From shifts ``dx, dy``: squares, product, gradients, speed and acceleration."""
    m = motion.withColumns({"dx2": F.col("dx") * F.col("dx"), "dy2": F.col("dy") * F.col("dy"), "dxdy": F.col("dx") * F.col("dy"), "gx": gradient(keys, "dx"), "gy": gradient(keys, "dy")})
    m = m.withColumn("speed", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    return m.withColumn("acceleration", gradient(keys, "speed"))


def lags(keys: list[str], value: str, steps: list[int]) -> dict[str, Column]:
    """Columns of a series shifted by ``steps`` (before if positive), the ends repeated."""
    order = _order(keys)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    return {f"{value}_{s}": F.coalesce(F.lag(value, s).over(order), first) if s >= 0 else F.coalesce(F.lead(value, -s).over(order), last) for s in steps}


def fill_runs(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Nulls along the line between the values round them, the nearest value at the ends."""
    order = _order(keys)
    back = W.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    own = F.when(F.col("v").isNotNull(), F.struct("i", "v"))
    both = signal.withColumn("_b", F.last(own, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_a", F.last(own, ignorenulls=True).over(back))
    line = lerp(F.col("i"), F.col("_b.i"), F.col("_b.v"), F.col("_a.i"), F.col("_a.v"))
    return both.withColumn("filled", F.coalesce("v", line, "_b.v", "_a.v")).drop("_b", "_a")


def fill_stat(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Nulls take their series' median, 0 if it has none."""
    m = signal.groupBy(*keys).agg(median("v").alias("_m"))
    return signal.join(m, keys).withColumn("filled", F.coalesce("v", "_m", F.lit(0.0))).drop("_m")


def gaussian(signal: DataFrame, keys: list[str], sigma: float, value: str = "v") -> DataFrame:
    """Gaussian smoothing over 4 deviations, the nearest value beyond the ends."""
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-(j * j) / (2 * sigma * sigma)) for j in range(-radius, radius + 1)]
    order = _order(keys)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    total = F.lit(0.0)
    for j, w in zip(range(-radius, radius + 1), weights):
        x = F.col(value) if j == 0 else F.coalesce(F.lead(value, j).over(order), last) if j > 0 else F.coalesce(F.lag(value, -j).over(order), first)
        total = total + x * F.lit(w / sum(weights))
    return signal.withColumn("smooth", total)


def mirrored_gaussian(signal: DataFrame, keys: list[str], sigma: float, value: str = "v") -> DataFrame:
    """``smooth``: Gaussian smoothing over 4 deviations, the series mirrored at its ends (the end sample
    twice); in blocks."""
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma * sigma))
    weights /= weights.sum()

    def run(b: Block) -> list[np.ndarray]:
        x = np.pad(b.column(value), radius, mode="symmetric")
        return [np.convolve(x, weights, mode="valid")[slice(*b.own)]]

    return by_blocks(signal, keys, radius, {"smooth": "double"}, run)


#: Centimetres of one unit of an encoder on a wheel of radius 1, but for lengths.
TURNS = {"degrees": math.pi / 180, "radians": 1.0}
LENGTHS = {"cm": 1.0, "m": 100.0}


def running_speed(positions: DataFrame, keys: list[str], unit: str = "ticks", ticks: float = 1024.0, radius_cm: float = 8.0, kernel: int = 51, sigma: float | None = 3.0, absolute: bool = True, out: str = "cm/s", zero: str = "none", session_start: str | None = None, offset: float = 0.0) -> DataFrame:
    """``speed`` from an encoder's place ``v`` and time ``t``, and ``t`` from the given zero.

    The place goes through a median filter (``kernel`` samples, zeros beyond the ends); its gradient over that
    of time, 0 where time does not go on, is smoothed by a mirrored Gaussian.  ``unit`` is ``ticks``,
    ``degrees``, ``radians``, ``cm`` or ``m``; ``out`` is ``cm/s`` or ``m/s``; ``zero`` is ``first_sample``,
    ``session_start`` (the column so named) or ``none``."""
    if unit not in ("ticks", *TURNS, *LENGTHS) or out not in ("cm/s", "m/s") or zero not in ("first_sample", "session_start", "none"):
        raise ValueError(f"running_speed: unit {unit!r}, out {out!r} or zero {zero!r}")
    cm = LENGTHS[unit] if unit in LENGTHS else radius_cm * (2 * math.pi / ticks if unit == "ticks" else TURNS[unit])
    m = rolling_median(positions, keys, kernel // 2, kernel // 2, made="_m", zeros=True) if kernel > 1 else positions.withColumn("_m", F.col("v").cast("double"))
    dt = gradient(keys, "t")
    speed = F.coalesce(F.when(dt > 0, gradient(keys, "_m") / dt), F.lit(0.0)) * cm
    m = m.withColumn("speed", F.abs(speed) if absolute else speed).drop("_m")
    if sigma:
        m = mirrored_gaussian(m, keys, sigma, "speed").drop("speed").withColumnRenamed("smooth", "speed")
    first = F.first("t").over(_order(keys).rowsBetween(W.unboundedPreceding, 0)) if zero == "first_sample" else F.col(session_start) if zero == "session_start" else F.lit(0.0)
    return m.withColumn("t", F.col("t") - first + F.lit(offset)).withColumn("speed", F.col("speed") / (100 if out == "m/s" else 1))


def robust_z(signal: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
    """Distance from the median in scaled median deviations (1 where they vanish)."""
    mid = signal.groupBy(*keys).agg(median("v").alias("_mid"))
    apart = signal.join(mid, keys).withColumn("_d", F.abs(F.col("v") - F.col("_mid")))
    scale = apart.groupBy(*keys).agg((F.lit(1.4826) * median("_d")).alias("_s"))
    return apart.join(scale, keys).withColumn("z", (F.col("v") - F.col("_mid")) / F.when(F.col("_s") < eps, 1.0).otherwise(F.col("_s"))).drop("_mid", "_d", "_s")


def subtract_baseline(windows: DataFrame, keys: list[str], n_pre: int) -> DataFrame:
    """Windows less their mean before sample ``n_pre``, as they are if nothing is there."""
    base = F.avg(F.when(F.col("k") < n_pre, F.col("v"))).over(W.partitionBy(*keys))
    return windows.withColumn("v", F.col("v") - F.coalesce(base, F.lit(0.0)))


def cumulative_share(values: DataFrame, keys: list[str]) -> DataFrame:
    """The empirical distribution: share of values at or below each."""
    return values.withColumn("share", F.cume_dist().over(W.partitionBy(*keys).orderBy("v")))


def downsample(signal: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """Means of blocks of ``factor`` samples; a short last block goes."""
    return signal.groupBy(*keys, F.floor(F.col("i") / factor).alias("block")).agg(F.avg("v").alias("v"), F.count("*").alias("n")).where(F.col("n") == factor).drop("n")


def quantile_bin(rank0: Column, n: Column, bins: int) -> Column:
    """Bin of the r-th (from 0) of ``n`` ordered items: ceil(r * bins / (n - 1)) - 1, at least 0, by
    whole numbers."""
    d = F.greatest(n - 1, F.lit(1))
    return F.greatest(F.floor((rank0 * bins + d - 1) / d).cast("int") - 1, F.lit(0))


def time_step(signal: DataFrame, key: str = "session_id") -> DataFrame:
    """Median time between samples, 1 for a single one."""
    d = signal.withColumn("d", F.lead("t").over(W.partitionBy(key).orderBy("i")) - F.col("t"))
    return d.groupBy(key).agg(F.coalesce(median("d"), F.lit(1.0)).alias("dt"))


def guarded_ratio(df: Column, f0: Column, eps: float = 1e-8) -> Column:
    """``df / f0`` where the baseline is not almost 0."""
    return F.when(F.abs(f0) > eps, df / f0)
