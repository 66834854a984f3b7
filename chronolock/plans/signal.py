"""Queries of sampled signals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from chronolock.catalog import query, view
from chronolock.functions import fixed
from chronolock.operators import baselines as bl
from chronolock.operators import peaks as pk
from chronolock.operators import signals as sg
from chronolock.plans.core import PRE, WINDOWS, windows

K = ["session_id", "roi"]
W = "window w as (partition by session_id, roi order by i)"


def traces(spark, sf):
    return view(spark, sf, "traces")


def samples(spark, sf):
    return view(spark, sf, "samples")


def out(df, *digits: tuple[str, int], keys=("session_id", "roi", "i")):
    return df.select(*keys, *[fixed(c, n).alias(c) for c, n in digits])


MED9 = "list_sort(list_concat(list(v) over f, list_transform(range(9 - count(*) over f), lambda x: 0e0)))[5]"
EDGES = f"m as (select session_id, i, t, {MED9} as m from samples window f as (partition by session_id order by i rows between 4 preceding and 4 following)), th as (select session_id, (quantile_cont(m, 0.05) + quantile_cont(m, 0.95)) / 2 + 1e-12 * (abs(quantile_cont(m, 0.05)) + abs(quantile_cont(m, 0.95))) as th from m group by 1), b as (select m.*, cast(m > th as int) as b from m join th using (session_id)), e as (select session_id, i, t, b - lag(b) over (partition by session_id order by i) as step from b), edges as (select * from e where step <> 0)"


@query("w3_edges", f"with {EDGES} select session_id, i, step from edges", "samples")
def w3(spark, sf):
    return sg.edges(samples(spark, sf), ["session_id"]).select("session_id", "i", "step")


@query("w4_debounce", "with r as (select session_id, t, row_number() over (partition by session_id order by t) as n from samples), k as (select session_id, n, t as kept, true as k from r where n = 1 union all select r.session_id, r.n, case when r.t - k.kept > 40000 then r.t else k.kept end, r.t - k.kept > 40000 from k join r on r.session_id = k.session_id and r.n = k.n + 1) select session_id, round(kept, 3) + 0 as t from k where k", "samples")
def w4(spark, sf):
    return sg.debounce(samples(spark, sf), "session_id", 40000.0).select("session_id", fixed("t", 3).alias("t"))


@query("w5_edge_summary", "with g as (select session_id, lead(t) over (partition by session_id order by t) - t as gap from samples) select session_id, count(*) as n_edges, round(quantile_cont(gap, 0.5), 3) + 0 as median_gap, round(quantile_cont(gap, 0.95), 3) + 0 as p95_gap, round(max(gap), 3) + 0 as longest, round(30 / quantile_cont(gap, 0.5), 8) + 0 as rate_hz from g group by 1", "samples")
def w5(spark, sf):
    return sg.edge_summary(samples(spark, sf), "session_id").select("session_id", "n_edges", fixed("median_gap", 3).alias("median_gap"), fixed("p95_gap", 3).alias("p95_gap"), fixed("longest", 3).alias("longest"), fixed("rate_hz", 8).alias("rate_hz"))


@query("w7_train_segments", "with g as (select session_id, t, t - lag(t) over (partition by session_id order by t) as gap from samples), u as (select session_id, quantile_cont(gap, 0.5) as u from g group by 1), s as (select g.session_id, t, coalesce(sum(cast(gap > 3 * u and gap > 1.5 as int)) over (partition by g.session_id order by t rows unbounded preceding), 0) as seg from g join u using (session_id)) select session_id, cast(seg as bigint) as segment, count(*) as n_edges, round(min(t), 3) + 0 as start, round(max(t), 3) + 0 as stop from s group by 1, 2 having count(*) >= 10 or max(seg) = 0", "samples")
def w7(spark, sf):
    return sg.train_segments(samples(spark, sf), "session_id", 3.0, 1.5, 10).select("session_id", F.col("segment").cast("bigint").alias("segment"), "n_edges", fixed("start", 3).alias("start"), fixed("stop", 3).alias("stop"))


RUNS = "n as (select *, coalesce(lead(t) over (partition by session_id order by i), t) as nt from samples), o as (select *, i - row_number() over (partition by session_id order by i) as isl from n where b), runs as (select session_id, min(i) as s, max(i) + 1 as e, min(t) as st, max(nt) as et from o group by session_id, isl)"
EPOCHS = f"{RUNS}, c as (select *, coalesce(cast(st - lag(et) over (partition by session_id order by s) > 20000 as int), 0) as cut from runs), p as (select *, sum(cut) over (partition by session_id order by s rows unbounded preceding) as part from c), epochs as (select session_id, min(s) as start_idx, max(e) as end_idx, min(st) as start_time, max(et) as end_time, max(et) - min(st) as duration_s from p group by session_id, part having max(et) - min(st) >= 30000)"


def epochs(spark, sf):
    return sg.epochs(samples(spark, sf), "session_id", 20000.0, 30000.0)


@query("w8_epochs", f"with {EPOCHS} select session_id, start_idx, end_idx, round(duration_s, 3) + 0 as duration_s from epochs", "samples")
def w8(spark, sf):
    return epochs(spark, sf).select("session_id", "start_idx", "end_idx", fixed("duration_s", 3).alias("duration_s"))


@query("w8_epochs_continuous", f"with {RUNS} select session_id, min(s) as start_idx, max(e) as end_idx, round(max(et) - min(st), 3) + 0 as duration_s from runs group by 1", "samples")
def w8c(spark, sf):
    return sg.epochs(samples(spark, sf), mode="continuous").select("session_id", "start_idx", "end_idx", fixed("duration_s", 3).alias("duration_s"))


@query("w9_adaptive_gap", f"with {RUNS}, r as (select runs.*, th from runs, (values (1000e0), (10000e0), (50000e0), (100000e0), (200000e0)) g(th)), c as (select *, coalesce(cast(st - lag(et) over (partition by session_id, th order by s) > th as int), 0) as cut from r), p as (select *, sum(cut) over (partition by session_id, th order by s rows unbounded preceding) as part from c), d as (select session_id, th, part, max(et) - min(st) as d from p group by all), cn as (select session_id, th, count(*) filter (d >= 20000) as n from d group by 1, 2) select session_id, min(th) filter (n >= 5) as gap from cn group by 1", "samples")
def w9(spark, sf):
    return sg.adaptive_gap(samples(spark, sf), 5, [1000.0, 10000.0, 50000.0, 100000.0, 200000.0], 20000.0)


@query("w10_shift_epochs", f"with {EPOCHS}, z as (select session_id, min(t) as z from samples group by 1) select session_id, start_idx, round(start_time - z, 3) + 0 as start_time, round(end_time - z, 3) + 0 as end_time from epochs join z using (session_id)", "samples")
def w10(spark, sf):
    zero = samples(spark, sf).groupBy("session_id").agg((-F.min("t")).alias("offset"))
    return sg.shift_epochs(epochs(spark, sf), zero).select("session_id", "start_idx", fixed("start_time", 3).alias("start_time"), fixed("end_time", 3).alias("end_time"))


@query("a24_epoch_summary", f"with {EPOCHS} select session_id, count(*) as n_epochs, round(avg(duration_s), 3) + 0 as mean_s, count(*) > 0 as passed from epochs group by 1", "samples")
def a24(spark, sf):
    return sg.epoch_summary(epochs(spark, sf)).select("session_id", "n_epochs", fixed("mean_s", 3).alias("mean_s"), "passed")


@query("a22_sample_checks", "with d as (select *, t - lag(t) over (partition by session_id order by i) as d from samples) select session_id, coalesce(min(d) >= 0, true) as monotonic, round(max(v) - min(v), 4) + 0 as span, bool_or(b) as ever_on from d group by 1", "samples")
def a22(spark, sf):
    return sg.sample_checks(samples(spark, sf)).withColumn("span", fixed("span", 4))


@query("w14_time_step", "with d as (select session_id, lead(t) over (partition by session_id order by i) - t as d from samples) select session_id, round(coalesce(quantile_cont(d, 0.5), 1), 4) + 0 as dt from d group by 1", "samples")
def w14(spark, sf):
    return sg.time_step(samples(spark, sf)).withColumn("dt", fixed("dt", 4))


@query("w16_rolling_mean_valid", f"select session_id, roi, i, round(m, 6) + 0 as mean from (select session_id, roi, i, avg(v) over (partition by session_id, roi order by i rows between 9 preceding and current row) as m, row_number() over w as rn from traces {W}) q where rn >= 10", "traces")
def w16(spark, sf):
    return out(sg.rolling_mean_valid(traces(spark, sf), K, 10), ("mean", 6))


@query("w17_peak_response", f"with {WINDOWS}, m as (select session_id, roi, event_id, avg(v) over (partition by session_id, roi, event_id order by k rows between 4 preceding and current row) as m, row_number() over (partition by session_id, roi, event_id order by k) as rn from w where k >= {PRE}), p as (select session_id, roi, event_id, max(m) as p from m where rn >= 5 group by all), b as (select session_id, roi, event_id, avg(v) as b from w where k < {PRE} group by all) select session_id, roi, event_id, round(p - b, 6) + 0 as response from p join b using (session_id, roi, event_id)", "traces", "onsets")
def w17(spark, sf):
    p = sg.peak_response(windows(spark, sf), ["session_id", "roi", "event_id"], (0, PRE), (PRE, PRE + 20), 5)
    return out(p, ("response", 6), keys=("session_id", "roi", "event_id"))


@query("w18_trailing_mean", f"select session_id, roi, i, round(avg(v) over (partition by session_id, roi order by i rows between 4 preceding and current row), 6) + 0 as mean from traces", "traces")
def w18(spark, sf):
    return out(traces(spark, sf).withColumn("mean", sg.trailing_mean(K, 5)), ("mean", 6))


@query("w19_centered_mean", "select session_id, roi, i, round(avg(v) over (partition by session_id, roi order by i rows between 5 preceding and 5 following), 6) + 0 as mean from traces", "traces")
def w19(spark, sf):
    return out(traces(spark, sf).withColumn("mean", sg.centered_mean(K, 5)), ("mean", 6))


REFLECT = "n as (select session_id, roi, max(i) as last from traces group by all), e as (select session_id, roi, i, v, true as own, last from traces join n using (session_id, roi) union all select session_id, roi, -i, v, false, last from traces join n using (session_id, roi) where i between 1 and 4 union all select session_id, roi, 2 * last - i, v, false, last from traces join n using (session_id, roi) where i < last and i >= last - 4), r as (select session_id, roi, i, v, own, avg(v) over (partition by session_id, roi order by i rows between 4 preceding and 4 following) as smooth from e)"


@query("w19_reflected_mean", f"with {REFLECT} select session_id, roi, i, round(smooth, 6) + 0 as smooth from r where own", "traces")
def w19r(spark, sf):
    return out(sg.reflected_mean(traces(spark, sf), K, 4), ("smooth", 6))


#: Rows of ``src`` (with ``n`` rows a series) and where they stand when the ends are mirrored for ``half`` samples.
def mirrored(src: str, keys: str, half: int, whole: bool) -> str:
    period = "greatest(2 * (n - 1), 1)" if whole else "2 * n"
    back = f"{period} - p" if whole else "2 * n - 1 - p"
    return f"select {keys}, j as i, case when p < n then p else {back} end as at from (select {keys}, n, unnest(range(-{half}, n + {half})) as j, ((j % ({period})) + ({period})) % ({period}) as p from (select {keys}, count(*) as n from {src} group by all))"


@query("w20_percentile_baseline", f"with x as (select a.session_id, a.roi, a.i, t.v from ({mirrored('traces', 'session_id, roi', 10, False)}) a join traces t on t.session_id = a.session_id and t.roi = a.roi and t.i = a.at), l as (select session_id, roi, i, list_sort(list(v) over (partition by session_id, roi order by i rows between 10 preceding and 10 following))[3] as low from x), b as (select l.* from l join traces using (session_id, roi, i)), y as (select a.session_id, a.roi, a.i, b.low from ({mirrored('traces', 'session_id, roi', 5, True)}) a join b on b.session_id = a.session_id and b.roi = a.roi and b.i = a.at), m as (select session_id, roi, i, avg(low) over (partition by session_id, roi order by i rows between 5 preceding and 5 following) as base from y) select session_id, roi, i, round(greatest(base, 1e-6), 4) + 0 as base from m join traces using (session_id, roi, i)", "traces")
def w20(spark, sf):
    return out(bl.percentile_baseline(traces(spark, sf), K, 10, 10.0, 5), ("base", 4))


@query("w21_floor_baseline", "with m as (select *, avg(v) over (partition by session_id, roi order by i rows between 8 preceding and 8 following) - 20000 as base from traces), s as (select session_id, roi, quantile_cont(v, 0.2) as p from traces group by all) select session_id, roi, i, round(greatest(base, greatest(1e-6, 0.05e0 * p)), 6) + 0 as f0 from m join s using (session_id, roi)", "traces")
def w21(spark, sf):
    t = traces(spark, sf).withColumn("base", sg.centered_mean(K, 8) - 20000)
    return out(sg.floor_baseline(t, K), ("f0", 6))


@query("w22_hull_baseline", "with m as (select session_id, roi, i, quantile_cont(v, 0.5) over (partition by session_id, roi order by i rows between 3 preceding and 3 following) as m from traces), l as (select session_id, roi, i, min(m) over (partition by session_id, roi order by i rows between 10 preceding and 10 following) as low from m) select session_id, roi, i, round(avg(low) over (partition by session_id, roi order by i rows between 10 preceding and 10 following), 6) + 0 as base from l", "traces")
def w22(spark, sf):
    return out(sg.hull_baseline(traces(spark, sf), K, 3, 10), ("base", 6))


_ENVELOPE = """
with c as (select session_id, roi, count(*) as n from traces group by all),
z as (select session_id, roi, n, ceil(n / 4e0)::int + 1 as points, ceil(least(20, n // 4) / 4e0)::int as phases, (n - 1) / (ceil(n / 4e0)) as step from c where n >= 4),
m as (select session_id, roi, i, quantile_cont(v, 0.5) over (partition by session_id, roi order by i rows between 3 preceding and 3 following) as m from traces),
l as (select z.*, j, round_even(j * step, 0)::int as t from (select *, unnest(range(points)) as j from z) z),
x as (select l.*, m.m from l join m on m.session_id = l.session_id and m.roi = l.roi and m.i = l.t),
s as (select a.session_id, a.roi, a.j as j0, b.j as j1, a.t as t0, b.t as t1, a.m as m0, b.m as m1 from x a left join x b on a.session_id = b.session_id and a.roi = b.roi and b.j = a.j + a.phases),
y as (select x.session_id, x.roi, x.j, any_value(x.t) as t, any_value(x.phases) as phases, min(case when x.j = s.j0 then m0 else m0 + (x.t - t0) * (m1 - m0) / (t1 - t0) end) as low, count(*) as there
  from x join s on s.session_id = x.session_id and s.roi = x.roi and (x.j = s.j0 or (x.j > s.j0 and x.j < s.j1)) group by x.session_id, x.roi, x.j),
e as (select *, count(*) filter (there >= (phases + 1) // 2) over (partition by session_id, roi) > 2 as enough from y),
f as (select * replace (case when there >= (phases + 1) // 2 or not enough then low end as low) from e),
g as (select * replace (coalesce(low, avg(low) over w) as low) from f window w as (partition by session_id, roi order by j rows between 3 preceding and 3 following)),
h as (select session_id, roi, j, t, avg(low) over w as f from g window w as (partition by session_id, roi order by j rows between 3 preceding and 3 following)),
k as (select *, lead(t) over w - t as h1, (lead(f) over w - f) / (lead(t) over w - t) as m1, t - lag(t) over w as h0, (f - lag(f) over w) / (t - lag(t) over w) as m0, lead(t, 2) over w - lead(t) over w as hb, (lead(f, 2) over w - lead(f) over w) / (lead(t, 2) over w - lead(t) over w) as mb, lag(t) over w - lag(t, 2) over w as hc, (lag(f) over w - lag(f, 2) over w) / (lag(t) over w - lag(t, 2) over w) as mc from h window w as (partition by session_id, roi order by j)),
d as (select *, case when m0 is null then case when sign(((2 * h1 + hb) * m1 - h1 * mb) / (h1 + hb)) <> sign(m1) then 0 when sign(m1) <> sign(mb) and abs(((2 * h1 + hb) * m1 - h1 * mb) / (h1 + hb)) > 3 * abs(m1) then 3 * m1 else ((2 * h1 + hb) * m1 - h1 * mb) / (h1 + hb) end
  when m1 is null then case when sign(((2 * h0 + hc) * m0 - h0 * mc) / (h0 + hc)) <> sign(m0) then 0 when sign(m0) <> sign(mc) and abs(((2 * h0 + hc) * m0 - h0 * mc) / (h0 + hc)) > 3 * abs(m0) then 3 * m0 else ((2 * h0 + hc) * m0 - h0 * mc) / (h0 + hc) end
  when m0 * m1 <= 0 then 0 else (3 * h1 + 3 * h0) / ((2 * h1 + h0) / m0 + (h1 + 2 * h0) / m1) end as d from k),
q as (select *, lead(f) over w as f1, lead(d) over w as d1, unnest(range(t, coalesce(t + h1, t + 1))) as i from d window w as (partition by session_id, roi order by j)),
r as (select *, (i - t) / h1 as u from q)
select session_id, roi, i, round(case when h1 is null then f else f * (1 + 2 * u) * (1 - u) * (1 - u) + d * h1 * u * (1 - u) * (1 - u) + f1 * u * u * (3 - 2 * u) + d1 * h1 * u * u * (u - 1) end / 9973e0, 8) + 0 as base from r"""


@query("w22_lower_envelope", _ENVELOPE, "traces")
def w22e(spark, sf):
    e = bl.lower_envelope(traces(spark, sf), K, 7, 20)  # decimals of the test table end in halves
    return e.select(*K, "i", fixed(F.col("base") / 9973, 8).alias("base"))


@query("w23_mask_artifacts", "with d as (select *, lead(v) over w - v as d, row_number() over w as rn, count(*) over (partition by session_id, roi) - row_number() over w + 1 as lft from traces window w as (partition by session_id, roi order by i)), s as (select session_id, roi, quantile_cont(d, 0.5) as mid, stddev_pop(d) as sd from d group by all), f as (select d.*, coalesce(cast(abs(d) > mid + 2 * sd and rn > 1 and lft > 2 as int), 0) as flag from d join s using (session_id, roi)), n as (select *, max(flag) over (partition by session_id, roi order by i rows between 9 preceding and 10 following) as near from f) select session_id, roi, count(*) as n, count(*) filter (near = 0) as n_clean from n group by all", "traces")
def w23(spark, sf):
    m = sg.mask_artifacts(traces(spark, sf), K, 2.0)
    return m.groupBy(*K).agg(F.count("*").alias("n"), F.count("clean").alias("n_clean"))


@query("w24_high_pass", f"with {REFLECT}, q as (select session_id, roi, i, v - smooth as x from r where own), s as (select session_id, roi, avg(x) as m, stddev_pop(x) as sd from q group by all) select session_id, roi, i, round((x - m) / sd, 6) + 0 as hp from q join s using (session_id, roi)", "traces")
def w24(spark, sf):
    return out(sg.high_pass(traces(spark, sf), K, 4), ("hp", 6))


@query("w25_unmix", "with p as (select session_id, roi, i, v as y, ln(1 + i % 13) as x from traces), s as (select session_id, roi, (count(*) * sum(x * y) - sum(x) * sum(y)) / (count(*) * (sum(x * x) + 1e-6) - sum(x) * sum(x)) as slope from p group by all) select session_id, roi, i, round(y - slope * x, 4) + 0 as clean from p join s using (session_id, roi)", "traces")
def w25(spark, sf):
    p = traces(spark, sf).select(*K, "i", F.col("v").alias("y"), F.log(1 + F.col("i") % 13).alias("x"))
    return out(sg.unmix(p, K), ("clean", 4))


@query("w26_motion_regressors", "with m as (select session_id, roi, i, sin(i) as dx, cos(i * 0.5e0) + v / 1e5 as dy from traces), g as (select *, case when lag(dx) over w is null then lead(dx) over w - dx when lead(dx) over w is null then dx - lag(dx) over w else (lead(dx) over w - lag(dx) over w) / 2 end as gx, case when lag(dy) over w is null then lead(dy) over w - dy when lead(dy) over w is null then dy - lag(dy) over w else (lead(dy) over w - lag(dy) over w) / 2 end as gy from m window w as (partition by session_id, roi order by i)) select session_id, roi, i, round(dx * dy, 6) + 0 as dxdy, round(gx, 6) + 0 as gx, round(sqrt(gx * gx + gy * gy), 6) + 0 as speed from g", "traces")
def w26(spark, sf):
    m = traces(spark, sf).select(*K, "i", F.sin("i").alias("dx"), (F.cos(F.col("i") * 0.5) + F.col("v") / 1e5).alias("dy"))
    return out(sg.motion_regressors(m, K), ("dxdy", 6), ("gx", 6), ("speed", 6))


@query("w28_lags", "select session_id, roi, i, coalesce(lag(v, 2) over w, first_value(v) over (partition by session_id, roi order by i rows between unbounded preceding and unbounded following)) as v_2, coalesce(lead(v, 1) over w, last_value(v) over (partition by session_id, roi order by i rows between unbounded preceding and unbounded following)) as \"v_-1\" from traces window w as (partition by session_id, roi order by i)", "traces")
def w28(spark, sf):
    return traces(spark, sf).withColumns(sg.lags(K, "v", [2, -1])).select(*K, "i", "v_2", "v_-1")


def polynomial(src: str, keys: str, half: int) -> str:
    """``smooth``: a cubic fitted to the window round each sample, or to the first or last one, by the weights of
    a window's samples for each of its places."""
    x = np.vander(np.arange(-half, half + 1) / half, 4)
    hat = [float(w) for w in (x @ np.linalg.pinv(x)).ravel()]
    w = 2 * half + 1
    on = " and ".join(f"s.{k} = t.{k}" for k in keys.split(", "))
    own = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"select {own}, s.i, any_value(s.v) as v, sum({hat}[(s.i - s.f) * {w} + t.i - s.f + 1] * t.v) as smooth from (select *, i0 + least(greatest(i - i0 - {half}, 0), n - {w}) as f from (select *, min(i) over p as i0, count(*) over p as n from {src} window p as (partition by {keys})) where n >= {w}) s join {src} t on {on} and t.i >= s.f and t.i < s.f + {w} group by {own}, s.i"


@query("w30_savitzky_golay", f"select session_id, roi, i, round(smooth, 3) + 0 as smooth from ({polynomial('traces', 'session_id, roi', 5)})", "traces")
def w30(spark, sf):
    return out(bl.savitzky_golay(traces(spark, sf), K, 5), ("smooth", 3))


HOLES = "h as (select session_id, roi, i, case when i % 10 not in (3, 4, 5) and i > 1 then v end as v from traces)"


def holes(spark, sf):
    return traces(spark, sf).withColumn("v", F.when(~(F.col("i") % 10).isin(3, 4, 5) & (F.col("i") > 1), F.col("v")))


@query("w31_fill_runs", f"with {HOLES}, b as (select *, last_value(case when v is not null then i end ignore nulls) over (partition by session_id, roi order by i rows unbounded preceding) as bi, last_value(v ignore nulls) over (partition by session_id, roi order by i rows unbounded preceding) as bv, first_value(case when v is not null then i end ignore nulls) over (partition by session_id, roi order by i rows between current row and unbounded following) as ai, first_value(v ignore nulls) over (partition by session_id, roi order by i rows between current row and unbounded following) as av from h) select session_id, roi, i, round(coalesce(v, bv + (i - bi) * (av - bv) / nullif(ai - bi, 0), bv, av), 6) + 0 as filled from b", "traces")
def w31(spark, sf):
    return out(sg.fill_runs(holes(spark, sf), K), ("filled", 6))


@query("w35_fill_stat", f"with {HOLES}, m as (select session_id, roi, quantile_cont(v, 0.5) as m from h group by all) select session_id, roi, i, round(coalesce(v, m, 0), 6) + 0 as filled from h join m using (session_id, roi)", "traces")
def w35(spark, sf):
    return out(sg.fill_stat(holes(spark, sf), K), ("filled", 6))


_RADIUS, _SIGMA = 4, 1.0
_WEIGHTS = [math.exp(-(j * j) / (2 * _SIGMA**2)) for j in range(-_RADIUS, _RADIUS + 1)]
_TERMS = " + ".join(f"{w / sum(_WEIGHTS)!r} * coalesce({'v' if not j else f'lead(v, {j}) over w' if j > 0 else f'lag(v, {-j}) over w'}, {'l' if j > 0 else 'f'})" for j, w in zip(range(-_RADIUS, _RADIUS + 1), _WEIGHTS))


@query("w33_gaussian", f"with e as (select *, first_value(v) over x as f, last_value(v) over x as l from traces window x as (partition by session_id, roi order by i rows between unbounded preceding and unbounded following)) select session_id, roi, i, round({_TERMS}, 4) + 0 as smooth from e {W}", "traces")
def w33(spark, sf):
    return out(sg.gaussian(traces(spark, sf), K, _SIGMA), ("smooth", 4))


_SPEED = [math.exp(-(j * j) / 18) for j in range(-12, 13)]
_SPEED = [w / sum(_SPEED) for w in _SPEED]


@query("w32_running_speed", f"with m as (select session_id, i, t, list_sort(list_concat(list(v) over f, list_transform(range(51 - count(*) over f), lambda x: 0e0)))[26] as m from samples window f as (partition by session_id order by i rows between 25 preceding and 25 following)), g as (select *, case when lag(m) over w is null then lead(m) over w - m when lead(m) over w is null then m - lag(m) over w else (lead(m) over w - lag(m) over w) / 2 end as dm, case when lag(t) over w is null then lead(t) over w - t when lead(t) over w is null then t - lag(t) over w else (lead(t) over w - lag(t) over w) / 2 end as dt from m window w as (partition by session_id order by i)), s as (select session_id, i, t, coalesce(abs(case when dt > 0 then dm / dt end), 0) * (2 * pi() * 8 / 1024) as speed from g), c as (select session_id, count(*) as n from s group by 1), e as (select session_id, i, n, unnest(range(-12, 13)) as j from s join c using (session_id)), a as (select session_id, i, j, case when p < n then p else 2 * n - 1 - p end as at from (select *, (((i + j) % (2 * n)) + 2 * n) % (2 * n) as p from e)), z as (select a.session_id, a.i, sum({_SPEED}[j + 13] * speed) as speed from a join s on s.session_id = a.session_id and s.i = a.at group by 1, 2) select session_id, i, round(t - first_value(t) over (partition by session_id order by i), 3) + 0 as t, round(speed * 1e6, 6) + 0 as speed from z join samples using (session_id, i)", "samples")
def w32(spark, sf):
    s = sg.running_speed(samples(spark, sf), ["session_id"], zero="first_sample")
    return s.select("session_id", "i", fixed("t", 3).alias("t"), fixed(F.col("speed") * 1e6, 6).alias("speed"))


@query("w34_zscore", "with s as (select session_id, roi, avg(v) as m, stddev_pop(v) as sd from traces group by all) select session_id, roi, i, round((v - m) / sd, 6) + 0 as z from traces join s using (session_id, roi)", "traces")
def w34(spark, sf):
    return out(sg.zscored(traces(spark, sf), K), ("z", 6))


@query("w34_robust_z", "with s as (select session_id, roi, quantile_cont(v, 0.5) as m from traces group by all), d as (select session_id, roi, 1.4826e0 * quantile_cont(abs(v - m), 0.5) as s from traces join s using (session_id, roi) group by all) select session_id, roi, i, round((v - m) / d.s, 6) + 0 as z from traces join s using (session_id, roi) join d using (session_id, roi)", "traces")
def w34r(spark, sf):
    return out(sg.robust_z(traces(spark, sf), K), ("z", 6))


@query("w36_subtract_baseline", f"with {WINDOWS} select session_id, roi, event_id, k, round(v - coalesce(avg(v) filter (k < {PRE}) over (partition by session_id, roi, event_id), 0), 6) + 0 as v from w", "traces", "onsets")
def w36(spark, sf):
    b = sg.subtract_baseline(windows(spark, sf), ["session_id", "roi", "event_id"], PRE)
    return out(b, ("v", 6), keys=("session_id", "roi", "event_id", "k"))


@query("w40_cumulative_share", "select session_id, roi, i, round(cume_dist() over (partition by session_id, roi order by v), 9) + 0 as share from traces", "traces")
def w40(spark, sf):
    return out(sg.cumulative_share(traces(spark, sf), K), ("share", 9))


@query("w42_downsample", "select session_id, roi, i // 4 as block, round(avg(v), 6) + 0 as v from traces group by all having count(*) = 4", "traces")
def w42(spark, sf):
    return out(sg.downsample(traces(spark, sf), K, 4), ("v", 6), keys=("session_id", "roi", "block"))


RUNS = "b as (select session_id, roi, i, v, lag(v) over w as b, row_number() over w as rn from traces window w as (partition by session_id, roi order by i)), u as (select * from b where rn = 1 or v is distinct from b), x as (select *, lead(v) over w as a, lead(i) over w - 1 as r from u window w as (partition by session_id, roi order by i)), p as (select session_id, roi, (i + r) // 2 as i, v, i as l, r from x where rn > 1 and v > b and v > a)"


@query("w43_peaks", f"with {RUNS} select session_id, roi, i, l as \"left\", r as \"right\" from p where v >= 60000", "traces")
def w43(spark, sf):
    return pk.peaks(traces(spark, sf), K, 60000.0).select(*K, "i", "left", "right")


_KEPT = f"with {RUNS}, q as (select session_id, roi, i, v, row_number() over (partition by session_id, roi order by v desc, i desc) as k from p where v >= 30000), s as (select session_id, roi, 1 as k, [i] as kept from q where k = 1 union all select q.session_id, q.roi, q.k, case when len(list_filter(s.kept, lambda y: abs(y - q.i) < 12)) = 0 then list_append(s.kept, q.i) else s.kept end from s join q on q.session_id = s.session_id and q.roi = s.roi and q.k = s.k + 1)"


@query("w43_peaks_apart", f"{_KEPT} select session_id, roi, unnest(kept) as i from (select session_id, roi, arg_max(kept, k) as kept from s group by all)", "traces")
def w43d(spark, sf):
    return pk.peaks(traces(spark, sf), K, 30000.0, distance=12).select(*K, "i")


_WIDTHS = f"""with {RUNS}, q as (select * from p where v >= 80000),
e as (select q.session_id, q.roi, q.i, any_value(q.v) as v, max(t.i) filter (t.i < q.i and t.v > q.v) as lb, min(t.i) filter (t.i > q.i and t.v > q.v) as rb from q join traces t on t.session_id = q.session_id and t.roi = q.roi group by 1, 2, 3),
o as (select e.session_id, e.roi, e.i, any_value(e.v) as v, min(t.v) filter (t.i < e.i) as ll, min(t.v) filter (t.i > e.i) as rl from e join traces t on t.session_id = e.session_id and t.roi = e.roi and t.i > coalesce(lb, -1) and t.i < coalesce(rb, 1e9) group by 1, 2, 3),
y as (select *, v - greatest(ll, rl) as prom, v - 0.5e0 * (v - greatest(ll, rl)) as level from o),
z as (select y.*, (select max(t.i) from traces t where t.session_id = y.session_id and t.roi = y.roi and t.i < y.i and t.v <= level) as a, (select min(t.i) from traces t where t.session_id = y.session_id and t.roi = y.roi and t.i > y.i and t.v <= level) as b from y),
w as (select z.*, ta.v as va, tn.v as vn, tb.v as vb, tm.v as vm from z join traces ta on ta.session_id = z.session_id and ta.roi = z.roi and ta.i = z.a join traces tn on tn.session_id = z.session_id and tn.roi = z.roi and tn.i = z.a + 1 join traces tb on tb.session_id = z.session_id and tb.roi = z.roi and tb.i = z.b join traces tm on tm.session_id = z.session_id and tm.roi = z.roi and tm.i = z.b - 1),
f as (select session_id, roi, i, prom, (b - case when vb < level then (level - vb) / (vm - vb) else 0 end) - (a + case when va < level then (level - va) / (vn - va) else 0 end) as width from w)
select session_id, roi, i, round(prom, 4) + 0 as prominence, round(width, 6) + 0 as width from f where width >= 1"""


@query("w43_peak_widths", _WIDTHS, "traces")
def w43w(spark, sf):
    return out(pk.peaks(traces(spark, sf), K, 80000.0, width=1.0), ("prominence", 4), ("width", 6))


@query("w44_quantile_bin", "with r as (select session_id, roi, i, count(*) over (partition by session_id, roi) as n from traces) select session_id, roi, i, greatest((i * 3 + greatest(n - 1, 1) - 1) // greatest(n - 1, 1) - 1, 0) as bin from r", "traces")
def w44(spark, sf):
    from pyspark.sql import Window

    t = traces(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy(*K)))
    return t.select(*K, "i", sg.quantile_bin(F.col("i"), F.col("n"), 3).cast("bigint").alias("bin"))


@query("f20_guarded_ratio", "with m as (select *, avg(v) over (partition by session_id, roi order by i rows between 8 preceding and 8 following) as f0 from traces) select session_id, roi, i, round(case when abs(f0) > 1e-8 then (v - f0) / f0 end, 6) + 0 as dff from m", "traces")
def f20(spark, sf):
    t = traces(spark, sf).withColumn("f0", sg.centered_mean(K, 8))
    return out(t.withColumn("dff", sg.guarded_ratio(F.col("v") - F.col("f0"), F.col("f0"))), ("dff", 6))
