"""Quality of single traces: robust statistics, scores, checks and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolock.functions import median
from chronolock.functions.lineage import settled, stored
from chronolock.functions.quantiles import HELD, quantiles, several
from chronolock.functions.ranking import large_keys
from chronolock.functions.ranking import ranked as counts_of
from chronolock.operators.baselines import savitzky_golay
from chronolock.operators.signals import fill_runs

WEIGHTS = {"valid_score": 0.15, "finite_score": 0.15, "activity_score": 0.25, "snr_score": 0.35}


def robust_stats(signal: DataFrame, keys: list[str], held: int = HELD) -> DataFrame:
    """Median, median deviation and its scaled form, percentile range 1 to 99, share that is there.
    Keys of more than ``held`` values are ranked over all tasks."""
    return _robust_stats(signal, keys, large_keys(signal, keys, "v", held))


def _robust_stats(signal: DataFrame, keys: list[str], large: DataFrame | None) -> DataFrame:
    p = quantiles(signal, keys, "v", (0.01, 0.25, 0.5, 0.75, 0.99), large).withColumn("median", F.col("q")[2]).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("q").alias("p"), "median")
    apart = signal.select(*keys, "v").join(p, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys]).withColumn("apart", F.abs(F.col("v") - F.col("median")))
    mad = quantiles(apart, keys, "apart", (0.5,), large).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("q")[0].alias("mad"))
    rest = apart.groupBy(*keys).agg((F.count("v") / F.count("*")).alias("finite"), F.first("p").alias("p"), F.first("median").alias("median"))
    out = rest.join(mad, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return out.select(*keys, "median", "mad", (F.lit(1.4826) * F.col("mad")).alias("sigma"), (F.col("p")[4] - F.col("p")[0]).alias("span"), (F.col("p")[3] - F.col("p")[1]).alias("iqr"), "finite")


def bounded(c: Column, rate: float) -> Column:
    """1 - exp(-rate x), 0 for negative x."""
    return 1 - F.exp(-F.lit(rate) * F.greatest(c, F.lit(0.0)))


def combined(scores: dict[str, float]) -> Column:
    """The weighted mean of the scores that are there."""
    up = sum((F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in scores.items()), F.lit(0.0))
    down = sum((F.lit(w) * F.col(c).isNotNull().cast("int") for c, w in scores.items()), F.lit(0.0))
    return up / F.when(down != 0, down)


def segment_residuals(signal: DataFrame, keys: list[str], segment: str = "segment", half: int = 50) -> DataFrame:
    """``smooth`` and ``residual`` of each segment of at least a window of values: nulls filled along
    the line, the segment's median taken off, a cubic fit in windows of ``half`` samples on either side."""
    each = [*keys, segment]
    named = [F.col(k).alias(f"_{k}") for k in each]
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in each]
    whole = signal.groupBy(*named).agg(F.count("v").alias("_have")).where(F.col("_have") >= 2 * half + 1).drop("_have")
    filled = fill_runs(signal.select(*each, "i", "v").join(whole, on, "left_semi"), each).select(*each, "i", F.col("filled").alias("v"))
    mid = quantiles(filled, each, "v", (0.5,)).select(*named, F.col("q")[0].alias("_mid"))
    smooth = savitzky_golay(filled, each, half).join(mid, on)
    return smooth.select(*each, "i", (F.col("smooth") - F.col("_mid")).alias("smooth"), (F.col("v") - F.col("smooth")).alias("residual"))


def trace_quality(signal: DataFrame, keys: list[str], segment: str = "segment", half: int = 50, valid: Column | None = None, held: int = HELD) -> DataFrame:
    """Robust statistics, signal to noise (scaled median deviation of the smoothed segments over that of
    their residuals, also in dB), sub-scores and the score.  ``signal`` has a ``segment``, as of a valid
    trial; ``valid`` is the share of trials that are (1 if not given)."""
    named = [F.col(k).alias(f"_{k}") for k in keys]
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    signal = settled(signal.select(*keys, segment, "i", "v"))  # read several times below
    large = large_keys(signal, keys, "v", held)
    parts = settled(segment_residuals(signal, keys, segment, half))
    both = several(parts, keys, {"smooth": (0.5,), "residual": (0.5,)}, large).select(*named, F.col("q_smooth")[0].alias("_sm"), F.col("q_residual")[0].alias("_rm"))
    apart = parts.join(both, on).select(*keys, F.abs(F.col("smooth") - F.col("_sm")).alias("smooth"), F.abs(F.col("residual") - F.col("_rm")).alias("residual"))
    sigma = several(apart, keys, {"smooth": (0.5,), "residual": (0.5,)}, large).select(*named, (F.lit(1.4826) * F.col("q_smooth")[0]).alias("level"), (F.lit(1.4826) * F.col("q_residual")[0]).alias("noise"))
    size = signal.withColumn("size", F.abs("v"))
    p99 = several(size, keys, {"size": (0.95, 0.99)}, large).select(*named, F.col("q_size")[0].alias("p95"), F.col("q_size")[1].alias("p99"))
    q = _robust_stats(signal, keys, large).join(p99, on).drop(*[f"_{k}" for k in keys]).join(sigma, on, "left").drop(*[f"_{k}" for k in keys])
    q = q.withColumn("snr", F.col("level") / F.when(F.col("noise") > 0, F.col("noise")))
    q = q.withColumn("snr_db", F.when(F.col("snr") > 0, 20 * F.log10("snr"))).withColumn("valid", F.lit(1.0) if valid is None else valid)
    q = q.withColumn("valid_score", F.least(F.sqrt("valid"), F.lit(1.0))).withColumn("finite_score", F.least("finite", F.lit(1.0))).withColumn("activity_score", bounded(F.col("p99"), 0.75)).withColumn("snr_score", bounded(F.col("snr"), 0.8))
    return q.withColumn("quality_score", combined(WEIGHTS))


def ranked(scores: DataFrame, keys: list[str], score: str = "quality_score", least: float = 0.25, finite: float = 0.90, held: int = HELD) -> DataFrame:
    """Rank from the best, percentile by average rank, and whether it is recommended; keys of more than
    ``held`` scores are ranked over all tasks.  Scores are stored first: they are read three times."""
    scores = stored(scores)
    c = counts_of(scores, keys, score, large_keys(scores, keys, score, held))
    c = c.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(score).alias("_s"), (F.col("total") - F.col("below") - F.col("n") + 1).cast("int").alias("rank"), ((F.col("below") + (F.col("n") + 1) / F.lit(2.0)) / F.col("total")).alias("percentile"))
    s = scores.join(c, [*[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col(score) == F.col("_s")], "left").drop(*[f"_{k}" for k in keys], "_s")
    return s.withColumn("recommended", F.coalesce((F.col("percentile") >= least) & (F.col("finite") >= finite), F.lit(False)))


def score_summary(scores: DataFrame, keys: list[str], score: str = "quality_score") -> DataFrame:
    """Count, mean, median, deviation, least and most."""
    return scores.groupBy(*keys).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), median(score).alias("median"), F.stddev_samp(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"))


def soma_metrics(signal: DataFrame, keys: list[str], held: int = HELD) -> DataFrame:
    """Percentiles, range (95th less 5th), largest value, signal to noise, and drift: median of the
    last third of what is there less that of the first (larger thirds first)."""
    named = [F.col(k).alias(f"_{k}") for k in keys]
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    large = large_keys(signal, keys, "v", held)
    third = signal.where("v is not null").withColumn("third", F.ntile(3).over(W.partitionBy(*keys).orderBy("i")))
    ends = quantiles(third.where("third <> 2").select(*keys, "third", "v"), [*keys, "third"], "v", (0.5,), large)
    drift = ends.groupBy(*named).agg((F.max(F.when(F.col("third") == 3, F.col("q")[0])) - F.max(F.when(F.col("third") == 1, F.col("q")[0]))).alias("drift"))
    p = quantiles(signal, keys, "v", (0.05, 0.5, 0.95), large).select(*named, F.col("q").alias("p"))
    rest = signal.groupBy(*keys).agg((F.count("v") / F.count("*")).alias("finite"), F.max(F.abs("v")).alias("peak"), F.stddev_pop("v").alias("sd"))
    out = rest.join(p, on).drop(*[f"_{k}" for k in keys]).join(drift, on, "left").select(*keys, "finite", (F.col("p")[2] - F.col("p")[0]).alias("range"), "peak", ((F.col("p")[2] - F.col("p")[1]) / F.when(F.col("sd") > 0, F.col("sd"))).alias("snr"), F.abs("drift").alias("drift"))
    return out.withColumn("drift_share", F.col("drift") / F.when(F.col("range") > 0, F.col("range")))


def threshold_checks(metrics: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """Whether each metric passes (null does not), whether all do, how many don't, and which in
    order."""
    checks = {c: F.coalesce(F.col(c) >= x, F.lit(False)) for c, x in least.items()} | {c: F.coalesce(F.col(c) <= x, F.lit(False)) for c, x in most.items()}
    out = metrics.withColumn("fail_reasons", F.concat_ws(";", *[F.when(~ok, F.lit(c)) for c, ok in checks.items()]))
    failed = sum(((~ok).cast("int") for ok in checks.values()), F.lit(0))
    return out.withColumn("n_failed", failed).withColumn("keep", F.col("n_failed") == 0)


def reason_counts(checked: DataFrame) -> DataFrame:
    """Rows for each reason."""
    return checked.where("fail_reasons <> ''").select(F.explode(F.split("fail_reasons", ";")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def coverage(events: DataFrame, inside: DataFrame) -> DataFrame:
    """Events of each family, those in epochs, and their share."""
    n = events.groupBy("session_id", "family").agg(F.count("*").alias("total"))
    m = inside.groupBy("session_id", "family").agg(F.count("*").alias("inside"))
    both = n.join(m, ["session_id", "family"], "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    return both.withColumn("share", F.col("inside") / F.col("total"))


def availability(trials: DataFrame, traces: DataFrame) -> DataFrame:
    """per session the first valid trial, channels there, and why it can't be used."""
    t = trials.groupBy("session_id").agg(F.min(F.when(F.col("valid"), F.col("trial"))).alias("first_valid"), F.count_if("valid").alias("n_valid"))
    d = traces.groupBy("session_id").agg(F.countDistinct("roi").alias("n_rois"), F.count("v").alias("n_values"))
    both = t.join(d, "session_id", "left")
    reason = F.when(F.col("n_valid") == 0, "no valid trial").when(F.coalesce("n_values", F.lit(0)) == 0, "no values").otherwise("")
    return both.withColumn("reason", reason).withColumn("usable", reason == "")
