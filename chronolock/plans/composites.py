"""Queries of whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolock.catalog import query, view
from chronolock.functions import fixed, ratio
from chronolock.operators import clock
from chronolock.operators.composites import K, analyse, condition, extract, tuning
from chronolock.operators.statistics import spaced
from chronolock.plans.core import POST, PRE, RESPONSES, epochs_of, responses, whole


@query("t12_tuning", f"with {RESPONSES}, m as (select session_id, roi, stimulus, count(delta_mean) as n, avg(delta_mean) as m from r group by all having count(delta_mean) >= 5), e as (select session_id, roi, count(*) as n_images, arg_max(stimulus, m) as preferred from m group by all having count(*) >= 4) select session_id, roi, n_images, preferred from e", "traces", "onsets")
def t12(spark, sf):
    values = responses(spark, sf).withColumnRenamed("delta_mean", "v")
    return tuning(values, K)["tuning_summary"].select(*K, "n_images", "preferred")


@query("t12_tuning_tests")
def t12t(spark, sf):
    got = tuning(responses(spark, sf).withColumnRenamed("delta_mean", "v"), K, method="hybrid", traces=whole(spark, sf), samples=spaced(PRE + POST))["tuning_summary"]
    return got.select(*K, "fve", "p_shuffle", "p_kw", "wilks", "p_manova", "preferred_effect", "is_tuned")


@query("t16_analysis")
def t16(spark, sf):
    w = whole(spark, sf).withColumn("family", F.lit("image"))
    classes = ("activated", "suppressed", "no_change")
    got = analyse(w, (0, PRE), (PRE, PRE + POST), classes=classes, samples=spaced(PRE + POST))
    return got["activation_summary"].join(got["tuning_summary"].select(*K, "n_images", "fve", "is_tuned"), K, "left")


#: An activation table from elsewhere: traces whose largest value is over twice their mean.
ELSEWHERE = "select session_id, roi, 'image' as family, case when max(v) > 2 * avg(v) then 'activated' else 'no_change' end as response_class from traces group by session_id, roi"


@query("t16_tuning_only", f"with {RESPONSES}, x as ({ELSEWHERE}), m as (select session_id, roi, stimulus, count(delta_mean) as n, avg(delta_mean) as m, var_pop(delta_mean) as w from r where (session_id, roi) in (select (session_id, roi) from x where response_class = 'activated') group by all having count(delta_mean) >= 5), g as (select session_id, roi, count(*) as n_images, sum(n * w) as within, sum(n) as n from m group by all having count(*) >= 4), t as (select session_id, roi, var_pop(delta_mean) as v from r join m using (session_id, roi, stimulus) group by all), e as (select session_id, roi, arg_max(stimulus, m) as preferred from m group by all) select session_id, roi, n_images, preferred, round(1 - within / n / v, 6) + 0 as fve from g join t using (session_id, roi) join e using (session_id, roi)", "traces", "onsets")
def t16o(spark, sf):
    w = whole(spark, sf).withColumn("family", F.lit("image"))
    activation = spark.sql(ELSEWHERE.replace("from traces", "from {traces}"), traces=view(spark, sf, "traces"))
    got = analyse(w, (0, PRE), (PRE, PRE + POST), method="fve", activation=activation)
    return got["tuning_summary"].select(*K, "n_images", "preferred", fixed("fve", 6).alias("fve"))


@query("t17_extraction")
def t17(spark, sf):
    log = view(spark, sf, "log")
    zero = log.groupBy("session_id").agg(F.min("t").alias("z"))
    at = log.join(zero, "session_id").withColumn("t", (F.col("t") - F.col("z")) / 1e4)
    e = epochs_of(spark, sf).join(zero, "session_id").select("session_id", *[((F.col(c) - F.col("z")) / 1e4).alias(c) for c in ("start_time", "end_time")])
    out = extract(at, view(spark, sf, "traces"), e, 2.0, {"image": (5.0, 10.0)})
    each = out["image_cut"].groupBy(*K, "stimulus", "center", "n_events").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    mean = ratio(F.sum(F.col("s") * F.col("n_events")), F.sum(F.col("n") * F.col("n_events")))
    return each.groupBy(*K, "stimulus").agg(F.sum("n_events").alias("n_events"), fixed(mean, 6).alias("mean"))


@query("t10_clock_alignment")
def t10(spark, sf):
    log = view(spark, sf, "log")
    s = log.where("value like 'Photodiode%'").select("session_id", F.col("row_idx").alias("i"), (F.col("t") * 1.0001 + 3).alias("t"), F.when(F.col("value") == "Photodiode-1", 1.0).otherwise(0.0).alias("v"))
    return clock.align(log, s)[0].groupBy("session_id", "alignment_method").agg(F.count("*").alias("n"), F.count("t_corr").alias("n_corrected"), fixed(F.avg(F.col("t_corr") - F.col("t")), 3).alias("mean_shift"))


@query("w6_best_mode")
def w6(spark, sf):
    log = view(spark, sf, "log")
    found = clock.rises(log)
    device = found.where("mode = 'midpoint'").select("session_id", (F.col("t") * 1.001 + 2).alias("t"))
    return clock.best_mode(found, device).select("session_id", "mode", "n", fixed("slope", 5).alias("slope"))


@query("w29_conditioned")
def w29(spark, sf):
    t = view(spark, sf, "traces")
    nuisance = t.withColumn("v", F.sin(F.col("i") * 0.7) * 100)
    c = condition(t, nuisance, K)
    return c.groupBy(*K).agg(F.count("*").alias("n"), F.count("dff").alias("n_dff"), fixed(F.avg("dff"), 5).alias("mean_dff"))
