"""Whole analyses as compositions of operators, over all sessions at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolock.functions import median
from chronolock.functions.lineage import settled, stored
from chronolock.operators import baselines as bl
from chronolock.operators import events as ev
from chronolock.operators import registry
from chronolock.operators import responses as rs
from chronolock.operators import signals as sg
from chronolock.operators import statistics as st
from chronolock.operators import windows as wn

K = ["session_id", "roi"]


def condition(traces: DataFrame, nuisance: DataFrame, keys: list[str], hp_half: int = 4, base_half: int = 20, quantile: float = 10.0) -> DataFrame:
    """Artifacts out, the high-passed nuisance unmixed, a percentile baseline with a floor, and the
    guarded ratio ``dff``.  Several steps take a statistic of each series and join it: what they read is stored, so
    that no step before is done again for each."""
    traces, nuisance = (stored(d.select(*keys, "i", "v")) for d in (traces, nuisance))
    clean = sg.mask_artifacts(traces, keys).select(*keys, "i", F.col("clean").alias("y"))
    x = sg.high_pass(nuisance, keys, hp_half).select(*keys, "i", F.col("hp").alias("x"))
    unmixed = sg.unmix(stored(clean.join(x, [*keys, "i"], "left")), keys).select(*keys, "i", F.col("clean").alias("v"))
    based = sg.floor_baseline(stored(bl.percentile_baseline(unmixed, keys, base_half, quantile, base_half // 2)), keys)
    return based.withColumn("dff", sg.guarded_ratio(F.col("v") - F.col("f0"), F.col("f0")))


def extract(log: DataFrame, traces: DataFrame, epochs: DataFrame, rate: float, spans: dict[str, tuple[float, float]]) -> dict[str, DataFrame]:
    """Windows of each family's events inside the epochs, and a status row a session; in ``<family>_cut`` the
    different windows of each stimulus once, with their number of events (``n_events``): as many events fall on one
    sample, these grow with the traces where windows grow with events times traces."""
    found = ev.classify(log)
    out: dict[str, DataFrame] = {}
    for family, (pre, post) in spans.items():
        own = wn.in_epochs(found.where(F.col("family") == family), epochs, pre, post).select("session_id", "row_idx", F.col("value").alias("stimulus"), "t")
        placed = wn.centers(own, rate).select("session_id", F.col("row_idx").alias("event_id"), "stimulus", "c")
        different = placed.groupBy("session_id", "stimulus", "c").agg(F.countDistinct("event_id").alias("n_events")).withColumn("center", F.col("c"))
        for name, events in ((family, placed), (f"{family}_cut", different)):
            out[name] = wn.event_windows(traces, events, round(pre * rate), round(post * rate)).withColumn("family", F.lit(family))
    counts = found.groupBy("session_id").agg(F.count_if(F.col("family") == "image").alias("n_images"))
    there = traces.groupBy("session_id").agg(F.count("v").alias("n_values"))
    out["status"] = registry.status(counts.join(there, "session_id", "left"), {"events": F.col("n_images") > 0, "traces": F.coalesce("n_values", F.lit(0)) > 0})
    return out


def gated(rows: DataFrame, activation: DataFrame, keys: list[str], classes: Sequence[str] = ("activated",), family: str = "image") -> DataFrame:
    """``rows`` of traces whose class in the activation table (``family, response_class``) is one of
    ``classes``, each row once however often the table names its trace."""
    named = activation.where((F.col("family") == family) & F.col("response_class").isin(*classes))
    return rows.join(named.select(*keys).distinct(), keys, "left_semi")


def tuning(values: DataFrame, keys: list[str], shuffles: int = 2000, least_trials: int = 5, least_images: int = 4, alpha: float = 0.05, method: str = "fve", traces: DataFrame | None = None, least_fve: float = 0.05, samples: list[int] | None = None) -> dict[str, DataFrame]:
    """Per image and per trace: responses, shares of variance, permutation and Kruskal-Wallis p, the
    preferred image, and whether the trace is tuned.

    ``values`` has ``stimulus, event_id, v``; ``traces`` the windows ``stimulus, event_id, k, v`` of the
    same events (or whole ones), which ``manova`` and ``hybrid`` need, of which they test ``samples``.  Tuned by ``fve``: both p under ``alpha`` and a
    share of ``least_fve`` or more; by ``manova``: its p under ``alpha``; by ``hybrid``: that p and the
    share.  What can't be tested is not tuned.  ``preferred_effect`` is the median over trials of the
    preferred image less that over all others."""
    if method not in ("fve", "manova", "hybrid"):
        raise ValueError(f"unknown method {method!r}: fve, manova or hybrid")
    if method != "fve" and traces is None:
        raise ValueError(f"method {method!r} needs traces")
    values = settled(values.select(*keys, "stimulus", "event_id", "v"))
    images = rs.per_image(values, keys)
    valid = images.where(F.col("n_trials") >= least_trials)
    enough = valid.groupBy(*keys).agg(F.count("*").alias("n_images")).where(F.col("n_images") >= least_images)
    tested = settled(valid.join(enough.select(*keys), keys, "left_semi"))
    named = tested.select(*keys, "stimulus")
    used = values.join(named, [*keys, "stimulus"], "left_semi")
    perm = st.permutation_fve(used, keys, shuffles).withColumnRenamed("p", "p_shuffle")
    h = st.kruskal(used, keys).select(*keys, "h", F.col("p").alias("p_kw"))
    best = rs.preferred(tested, keys)
    own = F.col("stimulus") == F.col("preferred")
    effect = used.join(best.select(*keys, "preferred"), keys).groupBy(*keys).agg((median(F.when(own, F.col("v"))) - median(F.when(~own, F.col("v")))).alias("preferred_effect"))
    whole = enough.join(perm, keys).join(h, keys, "left").join(best, keys, "left").join(effect, keys, "left")
    if traces is not None:
        m = st.manova(traces, keys, samples, event="event_id", only=named)
        m = m.select(*keys, F.col("n").alias("n_trials_manova"), F.col("groups").alias("n_groups_manova"), F.col("used").alias("n_samples_manova"), "wilks", F.col("f").alias("f_manova"), F.col("p").alias("p_manova"))
        whole = whole.join(m, keys, "left")
    share = F.col("fve") >= least_fve
    rule = (F.col("p_shuffle") < alpha) & (F.col("p_kw") < alpha) & share if method == "fve" else F.col("p_manova") < alpha
    whole = whole.withColumn("is_tuned", F.coalesce(rule & share if method == "hybrid" else rule, F.lit(False))).withColumn("tuning_method", F.lit(method))
    return {"tuning_per_image": images, "tuning_summary": whole}


def analyse(windows_: DataFrame, pre: tuple[int, int], post: tuple[int, int], shuffles: int = 2000, method: str = "hybrid", activation: DataFrame | None = None, classes: Sequence[str] = ("activated",), samples: list[int] | None = None) -> dict[str, DataFrame]:
    """All result tables from windows with ``session_id, roi, family, event_id, stimulus, k, v`` (or whole ones).

    Traces of the given ``classes`` are tested for tuning, by MANOVA only where ``method`` asks for it (else the
    summary has no columns of it).  An ``activation`` table (``session_id, roi,
    family, response_class``) from elsewhere takes the place of this run's own, which is then not
    made."""
    r = settled(rs.event_responses(windows_, pre, post, [*K, "family", "event_id", "stimulus"]).withColumn("v", F.col("delta_mean")))
    out: dict[str, DataFrame] = {}
    if activation is None:
        activation = settled(st.activation(r, K))
        out = {"activation_event": r.drop("v"), "activation_summary": activation}
    values = gated(r.where("family = 'image'"), activation, K, classes)
    # windows are made once more only for a method that tests them, and of those only the traces and images of values
    traces = None if method == "fve" else windows_.where("family = 'image'")
    return out | tuning(values, K, shuffles, method=method, traces=traces, samples=samples)
