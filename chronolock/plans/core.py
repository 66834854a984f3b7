"""Queries of event logs, windows and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolock.catalog import query, view
from chronolock.functions import fixed
from chronolock.operators import events as ev
from chronolock.operators import responses as rs
from chronolock.operators import windows as wn

IMAGE = "(lower(value) like '%.tif' or lower(value) like '%.tiff') and lower(value) not like '%photodiode%'"
CHANGE = "(lower(value) like '%changeflash%' or lower(value) = 'change')"
#: Windows of the queries: samples before and after an event.
PRE, POST = 10, 20


def _count(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


@query("f1_classify_events", f"select session_id, case when {IMAGE} then 'image' when {CHANGE} then 'change' when lower(value) like '%omission%' then 'omission' when lower(value) in ('frame', 'endframe', 'endflash', 'gray', 'intertrial') or lower(value) like '%photodiode%' then 'other' end as family, count(*) as n from log group by all", "log")
def f1(spark, sf):
    return _count(ev.classify(view(spark, sf, "log")), "session_id", "family")


@query("f2_classify_loosely", "select session_id, case when lower(value) like '%.tif' or lower(value) like '%.tiff' then 'image' when value = 'ChangeFlash' then 'change' when value = 'Omission' then 'omission' end as family, count(*) as n from log group by all", "log")
def f2(spark, sf):
    return _count(ev.classify_loosely(view(spark, sf, "log")), "session_id", "family")


@query("f3_event_time", "select session_id, row_idx, round(t, 3) + 0 as t_corr from log", "log")
def f3(spark, sf):
    return ev.event_time(view(spark, sf, "log")).select("session_id", "row_idx", fixed("t_corr", 3).alias("t_corr"))


@query("f8_stimulus_label", "select distinct value, regexp_replace(split_part(value, '/', -1), '(?i)\\.tiff?$', '') as label from log", "log")
def f8(spark, sf):
    return view(spark, sf, "log").select("value", ev.stimulus_label().alias("label")).distinct()


@query("f18_distinct_pairs", "select session_id, value, count(*) as n from (select distinct session_id, value, t from log) q group by all", "log")
def f18(spark, sf):
    return _count(ev.distinct_pairs(view(spark, sf, "log")), "session_id", "value")


@query("w1_photodiode_state", "select session_id, row_idx, last_value(case lower(value) when 'photodiode-1' then 1 when 'photodiode-0' then 0 end ignore nulls) over (partition by session_id order by row_idx rows unbounded preceding) as photodiode_state from log", "log")
def w1(spark, sf):
    return ev.photodiode_state(view(spark, sf, "log")).select("session_id", "row_idx", "photodiode_state")


@query("w2_time_zero", "select session_id, round(coalesce(min_by(t, row_idx) filter (lower(value) = 'frame'), min(t)), 3) + 0 as t0, round(max(t) filter (lower(value) = 'frame') - coalesce(min_by(t, row_idx) filter (lower(value) = 'frame'), min(t)), 3) + 0 as duration_s from log group by 1", "log")
def w2(spark, sf):
    return ev.time_zero(view(spark, sf, "log")).select("session_id", fixed("t0", 3).alias("t0"), fixed("duration_s", 3).alias("duration_s"))


@query("w11_ordered_images", f"select session_id, row_idx, cast(row_number() over (partition by session_id order by row_idx) - 1 as int) as event_idx from log where {IMAGE}", "log")
def w11(spark, sf):
    return ev.ordered(view(spark, sf, "log")).select("session_id", "row_idx", "event_idx")


TARGETS = f"""
images as (select * from log where {IMAGE}), changes as (select * from log where {CHANGE}),
targets as (select c.session_id, i.row_idx, min(i.t) as onset, min(i.value) as value, count(*) as n_changes from (select c.session_id, c.row_idx, (select min(i.row_idx) from images i where i.session_id = c.session_id and i.row_idx > c.row_idx) as image_row from changes c) c join images i on i.session_id = c.session_id and i.row_idx = c.image_row group by 1, 2)"""


@query("j6_change_targets", f"with {TARGETS} select session_id, row_idx, round(onset, 3) + 0 as onset, value, n_changes from targets", "log")
def j6(spark, sf):
    return ev.change_targets(view(spark, sf, "log")).select("session_id", "row_idx", fixed("onset", 3).alias("onset"), "value", "n_changes")


@query("w15_change_sequences", f"""with {TARGETS},
o as (select session_id, row_idx, row_number() over (partition by session_id order by row_idx) - 1 as e from images),
s as (select o.session_id, o.e as start, lead(o.e) over (partition by o.session_id order by o.e) as nxt, row_number() over (partition by o.session_id order by o.e) as seq_id from o join targets using (session_id, row_idx) where o.e >= 2),
l as (select session_id, max(e) as last from o group by 1),
b as (select s.*, last from s join l using (session_id))
select session_id, seq_id, 'prechange' as category, cast(p as int) as position, cast(start - 2 + p as int) as event_idx from b, (values (0), (1)) v(p)
union all select session_id, seq_id, 'repeated', cast(e - start as int), cast(e as int) from (select session_id, seq_id, start, unnest(range(start, coalesce(nxt, last + 1))) as e from b)
union all select session_id, seq_id, 'terminal', 0, cast(coalesce(nxt, last) as int) from b""", "log")
def w15(spark, sf):
    return ev.change_sequences(view(spark, sf, "log"))


@query("u2_first_stimulus_rows", f"select session_id, row_idx, value from log union all (with f as (select session_id, min_by(value, row_idx) as image from log where {IMAGE} group by 1) select session_id, -2, 'Frame' from f union all select session_id, -1, image from f)", "log")
def u2(spark, sf):
    return ev.first_stimulus_rows(view(spark, sf, "log")).select("session_id", "row_idx", "value")


@query("u4_first_seen", f"select session_id, value, min(row_idx) as first_row, cast(row_number() over (partition by session_id order by min(row_idx)) - 1 as int) as ord from log where {IMAGE} group by 1, 2", "log")
def u4(spark, sf):
    return ev.first_seen(view(spark, sf, "log"))


@query("a21_validate_log", f"select session_id, count(distinct case when {IMAGE} then value end) as n_images, bool_or(lower(value) like '%photodiode%') as has_photodiode, bool_or(lower(value) like '%omission%') as has_omission, count(distinct case when {IMAGE} then value end) > 1 and bool_or(lower(value) like '%photodiode%') as passed, concat_ws(';', case when count(distinct case when {IMAGE} then value end) <= 1 then 'few images' end, case when not bool_or(lower(value) like '%photodiode%') then 'no photodiode' end, case when not bool_or(lower(value) like '%omission%') then 'no omission' end) as warnings from log group by 1", "log")
def a21(spark, sf):
    return ev.validate_log(view(spark, sf, "log"))


@query("a26_event_document", f"select session_id, count(*) filter ({IMAGE}) as n_image, count(*) filter ({CHANGE}) as n_change, count(*) filter (lower(value) like '%omission%') as n_omission, len(list(t) filter ({CHANGE})) as n_times, round(sum(t) filter ({CHANGE}), 1) + 0 as sum_times from log group by 1", "log")
def a26(spark, sf):
    d = ev.event_document(view(spark, sf, "log")).withColumn("x", F.from_json("change_times", "array<double>"))
    return d.select("session_id", "n_image", "n_change", "n_omission", F.size("x").cast("bigint").alias("n_times"), fixed(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 1).alias("sum_times"))


@query("w45_window_times", "select k, round(k / 200e0 - 0.25e0, 6) + 0 as time from (select distinct k from trials) q", "trials")
def w45(spark, sf):
    return view(spark, sf, "trials").select("k").distinct().select(F.col("k").cast("bigint").alias("k"), fixed(ev.window_times(), 6).alias("time"))


# Windows of traces round the view events.
WINDOWS = f"ext as (select session_id, roi, min(i) lo, max(i) hi from traces group by all), w as (select o.session_id, t.roi, o.event_id, o.stimulus, t.i - (o.c - {PRE}) as k, t.v from onsets o join ext e on e.session_id = o.session_id and o.c - {PRE} >= lo and o.c + {POST} - 1 <= hi join traces t on t.session_id = o.session_id and t.roi = e.roi and t.i between o.c - {PRE} and o.c + {POST} - 1)"


def windows(spark, sf) -> DataFrame:
    return wn.event_windows(view(spark, sf, "traces"), view(spark, sf, "onsets"), PRE, POST)


def whole(spark, sf) -> DataFrame:
    """The same windows, a row each."""
    return wn.whole_windows(view(spark, sf, "traces"), view(spark, sf, "onsets"), PRE, POST)


@query("j1_event_windows", f"with {WINDOWS} select session_id, roi, stimulus, k, count(*) as n, round(sum(v), 2) + 0 as total from w group by all", "traces", "onsets")
def j1(spark, sf):
    return windows(spark, sf).groupBy("session_id", "roi", "stimulus", "k").agg(F.count("*").alias("n"), fixed(F.sum("v"), 2).alias("total"))


RESPONSES = f"{WINDOWS}, r as (select session_id, roi, event_id, stimulus, coalesce(sum(v) filter (k >= {PRE}), 0) - coalesce(sum(v) filter (k < {PRE}), 0) as delta_auc, avg(v) filter (k >= {PRE}) - avg(v) filter (k < {PRE}) as delta_mean from w group by all)"


def responses(spark, sf) -> DataFrame:
    return rs.event_responses(whole(spark, sf), (0, PRE), (PRE, PRE + POST), ["session_id", "roi", "event_id", "stimulus"])


@query("a4_event_responses", f"with {RESPONSES} select session_id, roi, event_id, stimulus, round(delta_auc, 3) + 0 as delta_auc, round(delta_mean, 6) + 0 as delta_mean from r", "traces", "onsets")
def a4(spark, sf):
    return responses(spark, sf).select("session_id", "roi", "event_id", "stimulus", fixed("delta_auc", 3).alias("delta_auc"), fixed("delta_mean", 6).alias("delta_mean"))


@query("flagship_mean_response", f"with {RESPONSES} select session_id, roi, count(*) as n_events, round(avg(delta_mean), 6) + 0 as mean_delta from r group by 1, 2", "traces", "onsets")
def flagship(spark, sf):
    """Mean change of each trace after image events."""
    return responses(spark, sf).groupBy("session_id", "roi").agg(F.count("*").alias("n_events"), fixed(F.avg("delta_mean"), 6).alias("mean_delta"))


EPOCHS = "epochs as (select session_id, min(t) + (max(t) - min(t)) * n / 5e0 as start_time, min(t) + (max(t) - min(t)) * (n + 0.5e0) / 5e0 as end_time from log, (values (0), (1), (2), (3), (4)) g(n) group by session_id, n)"


def epochs_of(spark, sf) -> DataFrame:
    """Five epochs over each session, each of half the distance to the next."""
    span = view(spark, sf, "log").groupBy("session_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    n = span.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(4))))
    at = lambda x: F.col("a") + (F.col("b") - F.col("a")) * x / 5.0
    return n.select("session_id", at(F.col("n")).alias("start_time"), at(F.col("n") + 0.5).alias("end_time"))


@query("j4_events_in_epochs", f"with {EPOCHS} select l.session_id, count(*) as n from log l where exists (select 1 from epochs e where e.session_id = l.session_id and l.t between start_time and end_time) group by 1", "log")
def j4(spark, sf):
    return _count(wn.in_epochs(view(spark, sf, "log"), epochs_of(spark, sf)), "session_id")


@query("j5_events_in_shrunk_epochs", f"with {EPOCHS} select l.session_id, count(*) as n from log l where exists (select 1 from epochs e where e.session_id = l.session_id and start_time + 5000 < end_time - 20000 and l.t between start_time + 5000 and end_time - 20000) group by 1", "log")
def j5(spark, sf):
    return _count(wn.in_epochs(view(spark, sf, "log"), epochs_of(spark, sf), 5000.0, 20000.0), "session_id")


@query("j7_as_of", "select l.session_id, l.row_idx, f.row_idx as right_row_idx from log l asof left join (select session_id, t, row_idx from log where value = 'Frame') f on f.session_id = l.session_id and l.t >= f.t", "log")
def j7(spark, sf):
    log = view(spark, sf, "log")
    return wn.as_of(log.select("session_id", "t", "row_idx"), log.where("value = 'Frame'").select("session_id", "t", F.col("row_idx")), "session_id", ["row_idx"]).select("session_id", "row_idx", "right_row_idx")


@query("j3_lower_bound_centers", "select l.session_id, l.row_idx, f.row_idx as c from (select * from log where value = 'Omission') l asof left join (select session_id, t, row_idx from log where value = 'Frame') f on f.session_id = l.session_id and l.t <= f.t", "log")
def j3(spark, sf):
    log = view(spark, sf, "log")
    return wn.lower_bound_centers(log.where("value = 'Omission'").select("session_id", "t", "row_idx"), log.where("value = 'Frame'").select("session_id", "t", F.col("row_idx").alias("i"))).select("session_id", "row_idx", "c")


@query("j8_piecewise_warp", """with a as (select session_id, t as src, t * 1.001e0 + sin(row_idx) + 5 as dst from log where value = 'Photodiode-1'),
n as (select *, lead(src) over w as src1, lead(dst) over w as dst1, row_number() over w as n from a window w as (partition by session_id order by src)),
l as (select * from n where src1 is not null),
f as (select * from log where value = 'Omission')
select q.session_id, q.row_idx, round(coalesce(q.dst, l.dst) + (q.t - coalesce(q.src, l.src)) * (coalesce(q.dst1, l.dst1) - coalesce(q.dst, l.dst)) / (coalesce(q.src1, l.src1) - coalesce(q.src, l.src)), 2) + 0 as warped from (select f.session_id, f.row_idx, f.t, l.src, l.dst, l.src1, l.dst1 from f asof left join l on l.session_id = f.session_id and f.t >= l.src) q join l on l.session_id = q.session_id and l.n = 1""", "log")
def j8(spark, sf):
    log = view(spark, sf, "log")
    anchors = log.where("value = 'Photodiode-1'").select("session_id", F.col("t").alias("src"), (F.col("t") * 1.001 + F.sin("row_idx") + 5).alias("dst"))
    return wn.piecewise_warp(log.where("value = 'Omission'"), anchors).select("session_id", "row_idx", fixed("warped", 2).alias("warped"))


@query("j9_ordinal_pairs", "with a as (select session_id, t, row_number() over (partition by session_id order by t) as n from log where value = 'Frame'), b as (select session_id, t, row_number() over (partition by session_id order by t) - 2 as n from log where value = 'Omission') select a.session_id, a.n, round(b.t - a.t, 3) + 0 as gap from a join b using (session_id, n)", "log")
def j9(spark, sf):
    log = view(spark, sf, "log")
    return wn.ordinal_pairs(log.where("value = 'Frame'"), log.where("value = 'Omission'"), 2).select("session_id", F.col("n").cast("bigint").alias("n"), fixed(F.col("dst") - F.col("src"), 3).alias("gap"))


@query("j18_resample_linear", """with m as (select session_id, roi, count(*) as m from traces group by 1, 2), n as (select *, cast(floor(avg(m) over (partition by session_id)) as bigint) as n from m),
g as (select session_id, roi, m, cast(unnest(range(n)) as int) as i, n from n), x as (select *, case when n > 1 then i * (m - 1) / (n - 1) else 0 end as x from g)
select g.session_id, g.roi, g.i, round(a.v + (g.x - floor(g.x)) * (coalesce(b.v, a.v) - a.v), 6) + 0 as v from x g join traces a on a.session_id = g.session_id and a.roi = g.roi and a.i = floor(g.x) left join traces b on b.session_id = g.session_id and b.roi = g.roi and b.i = floor(g.x) + 1""", "traces")
def j18(spark, sf):
    """Whole traces, each spread over the mean length of its session's traces."""
    from pyspark.sql import Window

    s = view(spark, sf, "traces").select("session_id", "roi", F.col("i").alias("j"), "v")
    n = s.groupBy("session_id", "roi").agg(F.count("*").alias("own")).withColumn("n", F.floor(F.avg("own").over(Window.partitionBy("session_id")))).drop("own")
    return wn.resample_linear(s, n, ("session_id", "roi")).select("session_id", "roi", F.col("i").cast("int").alias("i"), fixed("v", 6).alias("v"))


@query("w12_session_timeline", """with t as (select session_id, cast(roi as int) as trial, count(*) as n, roi % 7 <> 0 as valid from traces group by all), u as (select session_id, round_even(quantile_cont(n, 0.5), 0) as usual from t where valid group by 1),
f as (select t.session_id, trial, case when valid then n else usual end as length from t join u using (session_id))
select session_id, trial, cast(length as bigint) as length, cast(coalesce(sum(length) over (partition by session_id order by trial rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from f""", "traces")
def w12(spark, sf):
    t = view(spark, sf, "traces").groupBy("session_id", F.col("roi").cast("int").alias("trial")).agg(F.count("*").alias("n_samples")).withColumn("valid", F.col("trial") % 7 != 0)
    return wn.session_timeline(t, 200.0).select("session_id", "trial", F.col("length").cast("bigint").alias("length"), F.col("offset").cast("bigint").alias("offset"))


# Responses over the trials of the embedding table.


@query("a1_tensor_summary", "select stimulus, k, round(avg(v), 5) + 0 as mean, round(stddev_pop(v), 5) + 0 as std, count(distinct event_index) as n_events, count(v) as n_finite from trials group by all", "trials")
def a1(spark, sf):
    return rs.tensor_summary(view(spark, sf, "trials"), ["stimulus"], "event_index").select("stimulus", F.col("k").cast("bigint").alias("k"), fixed("mean", 5).alias("mean"), fixed("std", 5).alias("std"), "n_events", "n_finite")


@query("a5_trapezoid", "select stimulus, event_index, round(sum(v) - (min_by(v, k) + max_by(v, k)) / 2, 5) + 0 as auc from trials group by all", "trials")
def a5(spark, sf):
    return rs.trapezoid(view(spark, sf, "trials"), ["stimulus", "event_index"]).withColumn("auc", fixed("auc", 5))


@query("a6_amplitudes", "select event_index, round(avg(v), 5) + 0 as mean, round(max(v), 5) + 0 as max, round(sum(v), 5) + 0 as sum, round(avg(v) filter (r <= 10), 5) + 0 as top_mean from (select *, row_number() over (partition by event_index order by v desc, k) as r from trials) q group by 1", "trials")
def a6(spark, sf):
    a = rs.amplitudes(view(spark, sf, "trials"), ["event_index"])
    return a.select("event_index", *[fixed(c, 5).alias(c) for c in ("mean", "max", "sum", "top_mean")])


FVE = "c as (select stimulus, k, count(v) n, sum(v) s, sum(v * v) q from trials group by all), g as (select k, sum(n) n, sum(s) s, sum(q) q, sum(q - s * s / n) w from c group by 1), f as (select sum(q) / sum(n) - (sum(s) / sum(n)) ** 2 as total_var, sum(q - s * s / n) / sum(n) as mean_residual_var, sum(w) / sum(n) as image_residual_var from g)"


@query("a7_trace_fve", f"with {FVE} select 1 as roi, round(total_var, 6) + 0 as total_var, round(mean_residual_var, 6) + 0 as mean_residual_var, round(image_residual_var, 6) + 0 as image_residual_var, round((mean_residual_var - image_residual_var) / mean_residual_var, 5) + 0 as fve from f", "trials")
def a7(spark, sf):
    f = rs.trace_fve(view(spark, sf, "trials").withColumn("roi", F.lit(1)), ["roi"])
    return f.select("roi", *[fixed(c, 6).alias(c) for c in ("total_var", "mean_residual_var", "image_residual_var")], fixed("fve", 5).alias("fve"))


ANOVA = f"{RESPONSES}, x as (select session_id, roi, stimulus, count(delta_mean) n, sum(delta_mean) s, sum(delta_mean * delta_mean) q from r group by all)"


@query("a8_scalar_fve", f"with {ANOVA} select session_id, roi, cast(sum(n) as bigint) as n, count(*) as n_stimuli, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 5) + 0 as fve from x group by 1, 2", "traces", "onsets")
def a8(spark, sf):
    f = rs.scalar_fve(responses(spark, sf).withColumnRenamed("delta_mean", "v"), ["session_id", "roi"])
    return f.select("session_id", "roi", "n", "n_stimuli", fixed("fve", 5).alias("fve"))


@query("a9_fve_wide", "with m as (select roi % 10 as g, session_id, roi, avg(v) as m from traces group by all), w as (select g, " + ", ".join(f"round(max(m) filter (session_id = {i}), 3) + 0 as s{i}" for i in range(5)) + " from m group by 1) select * from w", "traces")
def a9(spark, sf):
    m = view(spark, sf, "traces").groupBy((F.col("roi") % 10).alias("g"), "session_id", "roi").agg(F.avg("v").alias("m"))
    wide = rs.fve_wide(m.groupBy("g", "session_id").agg(F.max("m").alias("fve")), ["g"], "session_id", [0, 1, 2, 3, 4])
    return wide.select("g", *[fixed(F.col(str(i)), 3).alias(f"s{i}") for i in range(5)])


@query("a10_curve_selectivity", f"with {FVE} select round(greatest(mean_residual_var - image_residual_var, 0), 6) + 0 as image_var, round(sqrt(greatest(mean_residual_var - image_residual_var, 0)), 5) + 0 as rms from f", "trials")
def a10(spark, sf):
    f = rs.curve_selectivity(view(spark, sf, "trials").withColumn("roi", F.lit(1)), ["roi"])
    return f.select(fixed("image_var", 6).alias("image_var"), fixed("rms", 5).alias("rms"))


@query("a11_mean_curve_fve", "with m as (select stimulus, k, avg(v) m from trials group by all), d as (select *, m - avg(m) over (partition by k) as d from m) select stimulus, round(1 - var_pop(d) / (select var_pop(m) from m), 5) + 0 as fve from d group by 1", "trials")
def a11(spark, sf):
    return rs.mean_curve_fve(view(spark, sf, "trials").withColumn("roi", F.lit(1)), ["roi"]).select("stimulus", fixed("fve", 5).alias("fve"))


@query("a12_depth_fve", f"""with {RESPONSES}, v as (select roi % 4 as depth, roi, stimulus, delta_mean as v from r), i as (select depth, roi, stimulus, avg(v) m from v group by all),
o as (select depth, roi, count(*) c, avg(m) rm, max(m) - min(m) rr from i group by all having count(*) >= 2)
select d.depth, n_rois, round(mean_range, 2) + 0 as mean_range, round(b / t, 5) + 0 as fve from (select depth, count(*) as n_rois, var_samp(rm) as b, avg(rr) as mean_range from o group by 1) d join (select depth, var_samp(v) as t from v group by 1) e on d.depth is not distinct from e.depth""", "traces", "onsets")
def a12(spark, sf):
    v = responses(spark, sf).select((F.col("roi") % 4).alias("depth"), "roi", "stimulus", F.col("delta_mean").alias("v"))
    return rs.depth_fve(v).select("depth", "n_rois", fixed("mean_range", 2).alias("mean_range"), fixed("fve", 5).alias("fve"))


@query("a13_per_image", f"with {RESPONSES} select session_id, roi, stimulus, count(delta_mean) as n_trials, round(avg(delta_mean), 8) + 0 as mean_response, round(quantile_cont(delta_mean, 0.5), 8) + 0 as median_response, round(stddev_samp(delta_mean), 6) + 0 as std_response from r group by all", "traces", "onsets")
def a13(spark, sf):
    p = rs.per_image(responses(spark, sf).withColumnRenamed("delta_mean", "v"), ["session_id", "roi"])
    return p.select("session_id", "roi", "stimulus", "n_trials", fixed("mean_response", 8).alias("mean_response"), fixed("median_response", 8).alias("median_response"), fixed("std_response", 6).alias("std_response"))


@query("w39_preferred", f"with {RESPONSES}, m as (select session_id, roi, stimulus, avg(delta_mean) m from r group by all), o as (select *, row_number() over w as r, lead(m) over w as n from m window w as (partition by session_id, roi order by m desc, stimulus)) select a.session_id, a.roi, a.stimulus as preferred, round(a.m, 8) + 0 as best_mean, round(a.m - a.n, 8) + 0 as over_next, round(a.m - b.rest, 8) + 0 as over_rest from o a left join (select session_id, roi, quantile_cont(m, 0.5) as rest from o where r > 1 group by all) b using (session_id, roi) where a.r = 1", "traces", "onsets")
def w39(spark, sf):
    p = rs.preferred(rs.per_image(responses(spark, sf).withColumnRenamed("delta_mean", "v"), ["session_id", "roi"]), ["session_id", "roi"])
    return p.select("session_id", "roi", "preferred", *[fixed(c, 8).alias(c) for c in ("best_mean", "over_next", "over_rest")])


@query("a33_mean_sem", "select session_id, roi, round(avg(v), 3) + 0 as mean, round(stddev_samp(v), 3) + 0 as sd, count(v) as n, round(stddev_samp(v) / sqrt(count(v)), 4) + 0 as sem from traces group by all", "traces")
def a33(spark, sf):
    m = rs.mean_sem(view(spark, sf, "traces"), ["session_id", "roi"])
    return m.select("session_id", "roi", fixed("mean", 3).alias("mean"), fixed("sd", 3).alias("sd"), "n", fixed("sem", 4).alias("sem"))


@query("a34_collapse", "with c as (select subject_id, quality, count(*) n, sum(score) s from sessions group by all) select subject_id, round(sum(s) / sum(n), 6) + 0 as mean, arg_min(quality, (-n, quality)) as modal, min(quality) as low, max(quality) as high from c group by 1", "sessions")
def a34(spark, sf):
    return rs.collapse(view(spark, sf, "sessions").withColumnRenamed("score", "v"), ["subject_id"], "quality").withColumn("mean", fixed("mean", 6))


@query("a42_curve_auc", "with m as (select stimulus, k, avg(v) m from trials group by all), p as (select stimulus, sum(m) - avg(m) filter (k < 21) * count(m) as auc from m group by 1) select round(avg(auc), 5) + 0 as auc from p", "trials")
def a42(spark, sf):
    return rs.curve_auc(view(spark, sf, "trials").withColumn("roi", F.lit(1)), ["roi"], 64).select(fixed("auc", 5).alias("auc"))


@query("j19_tuning_curve", "with m as (select stimulus, k, avg(v) m from trials group by all) select row_number() over (order by stimulus, k) - 1 as place, round(m, 5) + 0 as v from m", "trials")
def j19(spark, sf):
    c = rs.tuning_curve(view(spark, sf, "trials").withColumn("roi", F.lit(1)), ["roi"], 10)
    return c.select(F.posexplode("curve").alias("place", "v")).select(F.col("place").cast("bigint").alias("place"), fixed("v", 5).alias("v"))
