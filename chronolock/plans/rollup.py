"""Queries of registries, quality and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolock.catalog import query, table, view
from chronolock.functions import fixed
from chronolock.operators import components as cp
from chronolock.operators import quality as ql
from chronolock.operators import registry as rg
from chronolock.operators import responses as rs
from chronolock.operators import selection as sl
from chronolock.operators import statistics as st
from chronolock.operators import windows as wn
from chronolock.operators.events import classify
from chronolock.plans.core import EPOCHS, IMAGE, RESPONSES, epochs_of, responses
from chronolock.plans.signal import polynomial

K = ["session_id", "roi"]


def sessions(spark, sf):
    return view(spark, sf, "sessions")


def traces(spark, sf):
    return view(spark, sf, "traces")


def out(df, keys, **digits):
    return df.select(*keys, *[fixed(c, n).alias(c) for c, n in digits.items()])


@query("f4_select_sessions", "select session_id from sessions where quality in ('F', 'O') and (session_type not in ('5-LOW') or session_type is null)", "sessions")
def f4(spark, sf):
    return rg.select_sessions(sessions(spark, sf), qualities=["F", "O"], excluded_types=["5-LOW"]).select("session_id")


@query("f5_not_unique", "select subject_id, count(*) as n from sessions group by 1 having count(*) > 1", "sessions")
def f5(spark, sf):
    return rg.not_unique(sessions(spark, sf), "subject_id")


@query("f6_quality_word", "select event_type, case lower(trim(event_type)) when 'view' then 'view' else lower(trim(event_type)) end as word, count(*) as n from events group by all")
def f6(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_type", rg.quality_word(F.col("event_type")).alias("word")).groupBy("event_type", "word").agg(F.count("*").alias("n"))


@query("f7_class_word", "select o_orderpriority as raw, lower(trim(o_orderpriority)) as word, count(*) as n from orders group by all")
def f7(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("raw"), rg.class_word(F.col("o_orderpriority")).alias("word")).groupBy("raw", "word").agg(F.count("*").alias("n"))


@query("f9_plane_number", "select cast(l_linenumber as bigint) as plane, count(*) as n from lineitem group by 1")
def f9(spark, sf):
    li = table(spark, sf, "lineitem")
    label = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("dmd"), F.col("l_linenumber").cast("string"))).otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit(".0")))
    return li.select(rg.plane_number(label).cast("bigint").alias("plane")).groupBy("plane").agg(F.count("*").alias("n"))


@query("f10_depths_long", "select session_id, 1 as plane, cast(score as double) as depth_um from sessions union all select session_id, 2, subject_id * 1e0 from sessions", "sessions")
def f10(spark, sf):
    return rg.depths_long(sessions(spark, sf), {"score": 1, "subject_id": 2})


@query("f11_identity", "select subject_id + 100000 as subject_id, cast(session_date as varchar) as session_date, '12-30-00' as session_time, count(*) as n from sessions group by all", "sessions")
def f11(spark, sf):
    name = F.concat(F.lit("data/"), (F.col("subject_id") + 100000).cast("string"), F.lit("_"), F.col("session_date").cast("string"), F.lit("_12-30-00/x"))
    s = sessions(spark, sf).withColumn("name", name)
    i = rg.identity(F.col("name"))
    return s.select(i["subject_id"].alias("subject_id"), i["session_date"].cast("string").alias("session_date"), i["session_time"].alias("session_time")).groupBy("subject_id", "session_date", "session_time").agg(F.count("*").alias("n"))


@query("f12_tolerant_number", "select event_id, try_cast(nullif(split_part(split_part(props, ': ', 2), '}', 1), '') as double) as k from events")
def f12(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", rg.tolerant_number(F.get_json_object("props", "$.k")).alias("k"))


@query("f13_is_indicator", "select regexp_matches(p_name, '(?i)^[A-Za-z]*CaMP[0-9]+[A-Za-z0-9._-]*$') as indicator, count(*) as n from part group by 1")
def f13(spark, sf):
    return table(spark, sf, "part").select(rg.is_indicator(F.col("p_name")).alias("indicator")).groupBy("indicator").agg(F.count("*").alias("n"))


@query("f15_channel_number", "select case l_returnflag when 'R' then 1 else null end as channel, l_returnflag as flag, count(*) as n from lineitem group by all")
def f15(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(rg.channel_number(F.col("l_returnflag")).alias("channel"), F.col("l_returnflag").alias("flag")).groupBy("channel", "flag").agg(F.count("*").alias("n"))


@query("f14_drop_discarded", "select session_id, roi, count(*) as n, round(sum(v), 2) + 0 as total from traces where not (i % 50 < 3) group by all", "traces")
def f14(spark, sf):
    bad = traces(spark, sf).select(*K, "i", (F.col("i") % 50 < 3).alias("discard"))
    return sl.drop_discarded(traces(spark, sf), bad, K).groupBy(*K).agg(F.count("*").alias("n"), fixed(F.sum("v"), 2).alias("total"))


@query("f16_empty_channels", "select session_id, roi, count(*) as n from traces where roi % 3 <> 0 group by all", "traces")
def f16(spark, sf):
    t = traces(spark, sf).withColumn("v", F.when(F.col("roi") % 3 != 0, F.col("v")))
    return sl.drop_empty_channels(t, ["session_id"], "roi").groupBy(*K).agg(F.count("*").alias("n"))


@query("f17_time_window", "select session_id, roi, count(*) as n from traces where i >= 100 and i < 300 group by all", "traces")
def f17(spark, sf):
    return sl.in_frames(traces(spark, sf), 0.5, 1.5, 200.0).groupBy(*K).agg(F.count("*").alias("n"))


@query("f19_keep_mask", "select session_id, count(distinct roi) as n_rois, count(*) as n from traces t where roi in (select s_suppkey from supplier where s_acctbal > 0) group by 1", "traces")
def f19(spark, sf):
    keep = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("roi"))
    return sl.kept_only(traces(spark, sf), keep, ["roi"]).groupBy("session_id").agg(F.countDistinct("roi").alias("n_rois"), F.count("*").alias("n"))


@query("f21_time_cap", "with n as (select session_id, roi as trial, count(*) as n from traces group by all), c as (select *, coalesce(sum(n) over (partition by session_id order by trial rows between unbounded preceding and 1 preceding), 0) as before from n) select t.session_id, t.roi, count(case when before + i < 6000 then v end) as n_kept from traces t join c on c.session_id = t.session_id and c.trial = t.roi group by all", "traces")
def f21(spark, sf):
    t = traces(spark, sf)
    n = t.groupBy("session_id", F.col("roi").alias("trial")).agg(F.count("*").alias("n_samples")).withColumn("valid", F.lit(True))
    line = wn.session_timeline(n, 200.0).withColumnRenamed("trial", "roi")
    return sl.capped(t, line, 0.5, 200.0, "roi").groupBy(*K).agg(F.count("v").alias("n_kept"))


@query("f22_enough", f"with {RESPONSES} select session_id, roi, stimulus, count(delta_mean) as n from r group by all having count(delta_mean) >= 12", "traces", "onsets")
def f22(spark, sf):
    return sl.with_enough(responses(spark, sf), [*K, "stimulus"], "delta_mean", 12).drop("finite")


@query("f24_parameter", "select session_id, coalesce(nullif(quality, 'P'), session_type) as value from sessions", "sessions")
def f24(spark, sf):
    return sl.parameter(sessions(spark, sf), "value", [F.expr("nullif(quality, 'P')"), "session_type"]).select("session_id", "value")


@query("f25_availability", "select session_id, cast(min(case when roi % 7 <> 0 then roi end) as bigint) as first_valid, count(distinct case when roi % 7 <> 0 then roi end) as n_valid, count(distinct roi) as n_rois, count(v) as n_values, '' as reason, true as usable from traces group by 1", "traces")
def f25(spark, sf):
    t = traces(spark, sf)
    trials = t.select("session_id", F.col("roi").alias("trial")).distinct().withColumn("valid", F.col("trial") % 7 != 0)
    return ql.availability(trials, t)


@query("w38_last_sessions", "with b as (select *, row_number() over (partition by subject_id order by session_date desc, session_id desc) as back from sessions), p as (select *, row_number() over (partition by subject_id order by session_date, session_id) as place from b where back <= 6) select subject_id, session_id, place, (['f1', 'f2', 'f3', 'n', 'n+1', 'n+2'])[place] as slot from p", "sessions")
def w38(spark, sf):
    return rg.last_sessions(sessions(spark, sf)).select("subject_id", "session_id", "place", "slot")


@query("w41_extremes", "with r as (select *, row_number() over (partition by subject_id order by score, session_id) as r, count(*) over (partition by subject_id) as n from sessions), p as (select subject_id, session_id, 'worst' as pick from r where r <= 2 union all select subject_id, session_id, 'middle' from r where r > floor((n - 2) / 2) and r <= floor((n - 2) / 2) + 2 union all select subject_id, session_id, 'best' from r where r > n - 2) select * from p", "sessions")
def w41(spark, sf):
    return rg.extremes(sessions(spark, sf), ["subject_id"]).select("subject_id", "session_id", "pick")


@query("a30_quality_overview", "select subject_id, count(*) as n, count(*) filter (q = 'good') as good, count(*) filter (q = 'okay') as okay, count(*) filter (q = 'poor') as poor, cast(max(session_date) as varchar) as latest, string_agg(distinct session_type, ', ' order by session_type) as types, case when count(*) filter (q = 'good') >= floor(0.75e0 * count(*)) then 'strong' when count(*) filter (q in ('good', 'okay')) >= floor(0.75e0 * count(*)) then 'usable' when count(*) filter (q = 'poor') >= count(*) // 2 then 'needs review' else 'mixed' end as assessment from (select *, case quality when 'F' then 'good' when 'O' then 'okay' else 'poor' end as q from sessions) s group by 1", "sessions")
def a30(spark, sf):
    s = sessions(spark, sf).withColumn("quality", F.when(F.col("quality") == "F", "good").when(F.col("quality") == "O", "okay").otherwise("poor"))
    return rg.quality_overview(s).withColumn("latest", F.col("latest").cast("string"))


PARTS = "p as (select session_id, subject_id, case when quality <> 'P' then score / 4e5 end as glut_pass_fraction, case when session_id % 3 > 0 then (session_id % 100) / 80e0 - 0.1e0 end as ca_pass_fraction, case when subject_id % 7 > 0 then subject_id % 10 > 2 end as alignment_ready, case when quality <> 'F' or subject_id % 2 = 0 then 1 - (session_id % 40) / 100e0 end as event_coverage from sessions), k as (select *, case when glut_pass_fraction is not null then least(greatest(glut_pass_fraction, 0), 1) end as g, case when ca_pass_fraction is not null then least(greatest(ca_pass_fraction, 0), 1) end as c, alignment_ready::int as a, case when event_coverage is not null then least(greatest(event_coverage, 0), 1) end as e from p), s as (select *, (0.45e0 * coalesce(g, 0) + 0.2e0 * coalesce(c, 0) + 0.2e0 * coalesce(a, 0) + 0.15e0 * coalesce(e, 0)) / nullif(0.45e0 * (g is not null)::int + 0.2e0 * (c is not null)::int + 0.2e0 * (a is not null)::int + 0.15e0 * (e is not null)::int, 0) as score from k), t as (select *, case when score >= 0.85 then 'A' when score >= 0.7 then 'B' when score >= 0.5 then 'C' when score is not null then 'FAIL' end as tier from s)"


def scored(spark, sf):
    part = {
        "glut_pass_fraction": F.when(F.col("quality") != "P", F.col("score") / 4e5),
        "ca_pass_fraction": F.when(F.col("session_id") % 3 > 0, (F.col("session_id") % 100) / 80.0 - 0.1),
        "alignment_ready": F.when(F.col("subject_id") % 7 > 0, F.col("subject_id") % 10 > 2),
        "event_coverage": F.when((F.col("quality") != "F") | (F.col("subject_id") % 2 == 0), 1 - (F.col("session_id") % 40) / 100.0),
    }
    return rg.overall_quality(sessions(spark, sf).select("session_id", "subject_id", *[c.alias(n) for n, c in part.items()]))


@query("a28_overall_quality", f"with {PARTS} select session_id, round(score, 6) + 0 as score, tier, concat_ws('; ', case when glut_pass_fraction < 0.4 then 'low_glut_pass_fraction' end, case when ca_pass_fraction < 0.4 then 'low_calcium_pass_fraction' end, case when not alignment_ready then 'alignment_failed' end, case when event_coverage < 0.85 then 'low_event_coverage' end) as flags, tier is null or tier in ('C', 'FAIL') as needs_review from t", "sessions")
def a28(spark, sf):
    return scored(spark, sf).select("session_id", fixed("score", 6).alias("score"), "tier", "flags", "needs_review")


@query("a29_subject_rollup", f"with {PARTS} select subject_id, count(*) as n_sessions, count(*) filter (tier in ('A', 'B')) as n_usable, count(*) filter (tier is null or tier in ('C', 'FAIL')) as n_review, round(avg(score), 7) + 0 as mean_score, round(quantile_cont(score, 0.5), 7) + 0 as median_score from t group by 1", "sessions")
def a29(spark, sf):
    r = rg.subject_rollup(scored(spark, sf))
    return r.select("subject_id", "n_sessions", "n_usable", "n_review", fixed("mean_score", 7).alias("mean_score"), fixed("median_score", 7).alias("median_score"))


@query("a29_manifest", f"with {PARTS} select subject_id, session_id, tier, 'session' as level from t union all select distinct subject_id, null, null, 'subject' from t", "sessions")
def a29m(spark, sf):
    s = scored(spark, sf)
    return rg.manifest(rg.subject_rollup(s), s).select("subject_id", "session_id", "tier", "level")


@query("a27_flatten_json", "select event_id, split_part(split_part(props, ': ', 2), '}', 1) as k from events")
def a27(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("props").alias("body"))
    return rg.flatten_json(e, {"k": ["$.missing", "$.k"]}).select("event_id", "k")


@query("a31_percent_by_slot", "with e as (select session_type, subject_id, 100e0 * count(*) filter (quality = 'F') / count(*) as p from sessions group by all) select session_type, round(avg(p), 5) + 0 as mean, round(stddev_samp(p), 5) + 0 as sd, count(*) as n, round(stddev_samp(p) / sqrt(count(*)), 6) + 0 as sem from e group by 1", "sessions")
def a31(spark, sf):
    p = rg.percent_by_slot(sessions(spark, sf), ["session_type"], "subject_id", F.col("quality") == "F")
    return p.select("session_type", fixed("mean", 5).alias("mean"), fixed("sd", 5).alias("sd"), "n", fixed("sem", 6).alias("sem"))


@query("a32_shares_by_class", "select subject_id, c as class, count(*) filter (quality = c) as n, round(count(*) filter (quality = c) / count(*), 7) + 0 as share from sessions, (values ('F'), ('O'), ('P'), ('X')) v(c) group by all", "sessions")
def a32(spark, sf):
    s = rg.shares_by_class(sessions(spark, sf), ["subject_id"], "quality", ["F", "O", "P", "X"])
    return s.select("subject_id", "class", "n", fixed("share", 7).alias("share"))


@query("j15_share_of", "select subject_id, count(*) as n, count(*) filter (quality = 'F') as m, round(100e0 * count(*) filter (quality = 'F') / count(*), 6) + 0 as percent from sessions group by 1", "sessions")
def j15(spark, sf):
    s = sessions(spark, sf)
    return rg.share_of(s, s.where("quality = 'F'"), ["subject_id"]).withColumn("percent", fixed("percent", 6))


@query("j16_reconcile", "select coalesce(a.k, b.k) as value, coalesce(a.n, 0) as logged, coalesce(b.n, 0) as extracted, coalesce(a.n, 0) - coalesce(b.n, 0) as difference from (select value as k, count(*) as n from log where session_id < 3 group by 1) a full join (select value as k, count(*) as n from log where session_id >= 3 group by 1) b on a.k = b.k", "log")
def j16(spark, sf):
    log = view(spark, sf, "log")
    return rg.reconcile(log.where("session_id < 3"), log.where("session_id >= 3"), "value")


@query("j11_gate", "select session_id, roi, count(*) as n from traces where roi in (select l_suppkey from lineitem group by 1 having avg(l_extendedprice) > 38000) group by all", "traces")
def j11(spark, sf):
    t = traces(spark, sf)
    kept = t.groupBy(*K).agg(F.avg("v").alias("m")).where("m > 38000").select(*K).distinct()
    return t.join(kept, K, "left_semi").groupBy(*K).agg(F.count("*").alias("n"))


@query("j12_enrich", "select s_suppkey as roi, n_name as nation, count(v) as n from supplier left join nation on s_nationkey = n_nationkey left join traces on roi = s_suppkey group by all", "traces")
def j12(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("roi"), "s_nationkey")
    named = sl.enriched(s, table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), ["s_nationkey"], ["n_name"])
    n = traces(spark, sf).groupBy("roi").agg(F.count("v").alias("n"))
    return sl.enriched(named, n, ["roi"], ["n"]).select("roi", F.col("n_name").alias("nation"), F.coalesce("n", F.lit(0)).alias("n"))


@query("j13_inner", f"with {RESPONSES} select r.session_id, r.roi, s_name as name, count(*) as n from r join supplier on s_suppkey = r.roi where s_acctbal > 0 group by all", "traces", "onsets")
def j13(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("roi"), F.col("s_name").alias("stimulus"))
    both = sl.with_suffixes(responses(spark, sf), s, ["roi"], ("", "_name"))
    return both.groupBy("session_id", "roi", F.col("stimulus_name").alias("name")).agg(F.count("*").alias("n"))


@query("j14_full_outer", "select coalesce(a.k, b.k) as depth, a.n as a, b.n as b from (select nullif(s_nationkey % 5, 0) as k, count(*) as n from supplier group by 1) a full join (select nullif(c_nationkey % 7, 0) as k, count(*) as n from customer group by 1) b on a.k is not distinct from b.k")
def j14(spark, sf):
    a = table(spark, sf, "supplier").groupBy(F.expr("nullif(s_nationkey % 5, 0)").alias("depth")).agg(F.count("*").alias("a"))
    b = table(spark, sf, "customer").groupBy(F.expr("nullif(c_nationkey % 7, 0)").alias("depth")).agg(F.count("*").alias("b"))
    return sl.outer_totals(a, b, "depth")


@query("k4_status", "select session_id, case when quality <> 'P' and score > 1000 then 'ok' else 'failed' end as status, case when not quality <> 'P' then 'quality' when not score > 1000 then 'score' end as failure_stage, concat_ws(';', case when not quality <> 'P' then 'quality' end, case when not score > 1000 then 'score' end) as reasons from sessions", "sessions")
def k4(spark, sf):
    s = rg.status(sessions(spark, sf), {"quality": F.col("quality") != "P", "score": F.col("score") > 1000})
    return s.select("session_id", "status", "failure_stage", F.concat_ws(";", "failure_reasons").alias("reasons"))


@query("k5_pending", "select session_id from sessions where session_id not in (select l_orderkey from lineitem where l_quantity > 45)", "sessions")
def k5(spark, sf):
    done = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("session_id"))
    return rg.pending(sessions(spark, sf), done).select("session_id")


@query("s12_newest", "select subject_id, arg_max(session_type, (session_date, session_type)) as path, cast(max(session_date) as varchar) as mtime from sessions group by 1", "sessions")
def s12(spark, sf):
    f = sessions(spark, sf).select("subject_id", F.col("session_type").alias("path"), F.col("session_date").alias("mtime"))
    return rg.newest(f, ["subject_id"]).withColumn("mtime", F.col("mtime").cast("string"))


@query("s15_completeness", "select s.session_id, p as product, exists (select 1 from lineitem l where l.l_orderkey = s.session_id and l.l_returnflag = p) as \"exists\" from sessions s, (values ('A'), ('N'), ('R')) v(p)", "sessions")
def s15(spark, sf):
    there = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("product"))
    return rg.completeness(sessions(spark, sf), ["A", "N", "R"], there)


@query("s5_paired", "select a.session_id, a.roi as a, b.roi as b, count(*) as n, round(corr(a.v, b.v), 6) + 0 as r from traces a join traces b on b.session_id = a.session_id and b.roi = a.roi + 5 and b.i = a.i group by all", "traces")
def s5(spark, sf):
    from chronolock.sources import paired

    t = traces(spark, sf)
    p = paired(t.withColumn("pair", F.col("roi")), t.withColumn("pair", F.col("roi") - 5), ["session_id", "pair", "i"])
    return p.groupBy("session_id", F.col("pair").alias("a")).agg(F.count("*").alias("n"), fixed(F.corr("y", "x"), 6).alias("r")).select("session_id", "a", (F.col("a") + 5).alias("b"), "n", "r")


@query("s7_line", "select user_id as session_id, event_id, round(epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) over (partition by user_id), 3) + 0 as t from events where event_type = 'view'")
def s7(spark, sf):
    from chronolock.sources import line

    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "event_id", F.col("event_type").alias("line"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1e6").alias("t"))
    return line(e, "view").select("session_id", "event_id", fixed("t", 3).alias("t"))


@query("a14_robust_stats", "with m as (select session_id, roi, quantile_cont(v, 0.5) as median, count(v) / count(*) as finite, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) as span, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) as iqr from traces group by all), d as (select session_id, roi, quantile_cont(abs(v - median), 0.5) as mad from traces join m using (session_id, roi) group by all) select session_id, roi, round(median, 6) + 0 as median, round(mad, 6) + 0 as mad, round(1.4826e0 * mad, 5) + 0 as sigma, round(span, 5) + 0 as span, round(iqr, 5) + 0 as iqr, finite from m join d using (session_id, roi)", "traces")
def a14(spark, sf):
    return out(ql.robust_stats(traces(spark, sf), K), K, median=6, mad=6, sigma=5, span=5, iqr=5, finite=6)


_SMOOTH = polynomial("s", "session_id, roi, segment", 5)
QUALITY = f"s as (select session_id, roi, i, i // 40 as segment, v / 1e5 as v from traces), c as ({_SMOOTH}), e as (select session_id, roi, segment, quantile_cont(v, 0.5) as mid from c group by all), w as (select session_id, roi, smooth - mid as level, v - smooth as res from c join e using (session_id, roi, segment)), m as (select session_id, roi, quantile_cont(abs(v), 0.99) as p99, count(v) / count(*) as finite from s group by all), g as (select session_id, roi, quantile_cont(level, 0.5) as lm, quantile_cont(res, 0.5) as rm from w group by all), n as (select session_id, roi, quantile_cont(abs(level - lm), 0.5) / nullif(quantile_cont(abs(res - rm), 0.5), 0) as snr from w join g using (session_id, roi) group by all), q as (select session_id, roi, finite, p99, snr, 1 - exp(-0.75e0 * p99) as act, 1 - exp(-0.8e0 * snr) as sn from m left join n using (session_id, roi)), z as (select *, (0.15e0 + 0.15e0 * finite + 0.25e0 * act + coalesce(0.35e0 * sn, 0)) / (0.55e0 + case when sn is null then 0 else 0.35e0 end) as score from q)"


def quality(spark, sf):
    t = traces(spark, sf).withColumn("v", F.col("v") / 1e5).withColumn("segment", F.floor(F.col("i") / 40))
    return ql.trace_quality(t, K, half=5)


@query("a16_trace_quality", f"with {QUALITY} select session_id, roi, round(p99, 6) + 0 as p99, round(snr, 5) + 0 as snr, round(20 * log10(snr), 5) + 0 as snr_db, round(score, 6) + 0 as quality_score from z", "traces")
def a16(spark, sf):
    return out(quality(spark, sf), K, p99=6, snr=5, snr_db=5, quality_score=6)


@query("a17_subscores", f"with {QUALITY} select session_id, roi, round(act, 6) + 0 as activity_score, round(sn, 6) + 0 as snr_score from z", "traces")
def a17(spark, sf):
    return out(quality(spark, sf), K, activity_score=6, snr_score=6)


@query("w37_ranked", f"with {QUALITY}, r as (select session_id, roi, score, rank() over (partition by session_id order by score desc) as rank, (rank() over (partition by session_id order by score) + (count(*) over (partition by session_id, score) - 1) / 2e0) / count(*) over (partition by session_id) as percentile from z) select session_id, roi, rank, round(percentile, 6) + 0 as percentile, percentile >= 0.25 as recommended from r", "traces")
def w37(spark, sf):
    r = ql.ranked(quality(spark, sf), ["session_id"])
    return r.select(*K, "rank", fixed("percentile", 6).alias("percentile"), "recommended")


@query("a18_score_summary", f"with {QUALITY} select session_id, count(score) as n, round(avg(score), 6) + 0 as mean, round(quantile_cont(score, 0.5), 6) + 0 as median, round(stddev_samp(score), 6) + 0 as std, round(min(score), 6) + 0 as min, round(max(score), 6) + 0 as max from z group by 1", "traces")
def a18(spark, sf):
    s = ql.score_summary(quality(spark, sf), ["session_id"])
    return s.select("session_id", "n", *[fixed(c, 6).alias(c) for c in ("mean", "median", "std", "min", "max")])


SOMA = "th as (select *, ntile(3) over (partition by session_id, roi order by i) as third from traces), d as (select session_id, roi, abs(quantile_cont(v, 0.5) filter (third = 3) - quantile_cont(v, 0.5) filter (third = 1)) as drift from th group by all), p as (select session_id, roi, quantile_cont(v, 0.05) as p5, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.95) as p95, max(abs(v)) as peak, stddev_pop(v) as sd, 1e0 as finite from traces group by all), m as (select session_id, roi, finite, p95 - p5 as range, peak, (p95 - p50) / sd as snr, drift, drift / (p95 - p5) as drift_share from p join d using (session_id, roi))"


@query("a19_soma_metrics", f"with {SOMA} select session_id, roi, round(range, 5) + 0 as range, round(peak, 2) + 0 as peak, round(snr, 6) + 0 as snr, round(drift, 5) + 0 as drift, round(drift_share, 7) + 0 as drift_share from m", "traces")
def a19(spark, sf):
    return out(ql.soma_metrics(traces(spark, sf), K), K, range=5, peak=2, snr=6, drift=5, drift_share=7)


def checked(spark, sf):
    return ql.threshold_checks(ql.soma_metrics(traces(spark, sf), K), {"finite": 0.75, "range": 62000.0, "snr": 1.3}, {"drift": 4000.0})


CHECKED = f"{SOMA}, c as (select session_id, roi, concat_ws(';', case when not finite >= 0.75 then 'finite' end, case when not range >= 62000 then 'range' end, case when not snr >= 1.3 then 'snr' end, case when not drift <= 4000 then 'drift' end) as fail_reasons, (not finite >= 0.75)::int + (not range >= 62000)::int + (not snr >= 1.3)::int + (not drift <= 4000)::int as n_failed from m)"


@query("a20_threshold_checks", f"with {CHECKED} select session_id, roi, fail_reasons, n_failed, n_failed = 0 as keep from c", "traces")
def a20(spark, sf):
    return checked(spark, sf).select(*K, "fail_reasons", "n_failed", "keep")


@query("a20_reason_counts", f"with {CHECKED} select reason, count(*) as n from (select unnest(string_split(fail_reasons, ';')) as reason from c where fail_reasons <> '') q group by 1", "traces")
def a20r(spark, sf):
    return ql.reason_counts(checked(spark, sf))


@query("a15_segments", "with n as (select session_id, roi, count(*) as n, roi % 7 <> 0 as valid from traces group by all) select session_id, count(*) as n_trials, round(avg(valid::int), 6) + 0 as valid_fraction, round(avg(n) filter (valid), 6) + 0 as mean_length, cast(sum(n) filter (valid) as bigint) as total from n group by 1", "traces")
def a15(spark, sf):
    n = traces(spark, sf).groupBy(*K).agg(F.count("*").alias("n_samples")).withColumn("valid", F.col("roi") % 7 != 0)
    return sl.trial_summary(n, ["session_id"]).select("session_id", "n_trials", fixed("valid_fraction", 6).alias("valid_fraction"), fixed("mean_length", 6).alias("mean_length"), "total")


@query("a23_coverage", f"with {EPOCHS}, f as (select session_id, t, case when {IMAGE} then 'image' else 'rest' end as family from log), i as (select *, exists (select 1 from epochs e where e.session_id = f.session_id and f.t between start_time and end_time) as inside from f) select session_id, family, count(*) as total, count(*) filter (inside) as inside, round(count(*) filter (inside) / count(*), 7) + 0 as share from i group by 1, 2", "log")
def a23(spark, sf):
    log = classify(view(spark, sf, "log")).withColumn("family", F.when(F.col("family") == "image", "image").otherwise("rest"))
    return ql.coverage(log, wn.in_epochs(log, epochs_of(spark, sf))).withColumn("share", fixed("share", 7))


@query("a25_counts_with_zeros", f"with i as (select distinct value from log where {IMAGE}), s as (select distinct session_id from log) select session_id, value, (select count(*) from log l where l.session_id = s.session_id and l.value = i.value) as n from s, i", "log")
def a25(spark, sf):
    log = view(spark, sf, "log")
    images = log.where(F.lower("value").endswith(".tiff")).select("value").distinct()
    return sl.counts_with_zeros(log, log, images)


@query("a39_counts_by_depth", "select s_nationkey as depth, count(distinct s_suppkey) as n_rois, count(*) as n from supplier join traces on roi = s_suppkey group by 1", "traces")
def a39(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("roi"), F.col("s_nationkey").alias("depth"))
    return sl.counts_by_depth(traces(spark, sf), s)


@query("l2_top_sessions", "select session_id, score from sessions order by score desc, session_id limit 20", "sessions")
def l2(spark, sf):
    return sl.first_rows(sessions(spark, sf), ["-score", "session_id"], 20).select("session_id", "score")


@query("l1_sorted", "select subject_id, session_id, row_number() over (partition by subject_id order by session_date, session_id) as place from sessions", "sessions")
def l1(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.asc_nulls_last("session_date"), "session_id"))
    return sl.in_order(sessions(spark, sf).select("subject_id", "session_id", place.alias("place")), ["subject_id", "place"])


# Statistics.

RANKS = "e as (select family, p - 0.05e0 as v from pvalues), z as (select family, v, abs(v) as a from e where v <> 0), r as (select family, v, rank() over (partition by family order by a) + (count(*) over (partition by family, a) - 1) / 2e0 as r from z)"


def normal_sql(z: str) -> str:
    """Two-sided p of a normal deviate, by a series of positive terms; beyond 8 deviations it is under 2e-15,
    and 300 terms no longer reach it."""
    x = f"(abs({z}) / sqrt(2e0))"
    term = f"{x} * exp(k * ln(2 * {x} * {x}) - (lgamma(2 * k + 2) - k * ln(2e0) - lgamma(k + 1)))"
    return f"case when {z} = 0 then 1e0 when abs({z}) > 8 then 0e0 else greatest(1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(300), lambda k: {term})), 0) end"


def chi_square_sql(x: str, df: str) -> str:
    """Upper tail of chi-square, by a series of positive terms."""
    a, y = f"({df} / 2e0)", f"({x} / 2e0)"
    return f"case when {x} <= 0 then 1e0 else greatest(1 - list_sum(list_transform(range(300), lambda k: exp(-{y} + ({a} + k) * ln({y}) - lgamma({a} + k + 1)))), 0) end"


@query("t1_wilcoxon", f"with {RANKS}, w as (select family, count(*) as n, sum(r) filter (v > 0) as w_plus, sum(r) filter (v < 0) as w_minus from r group by 1), tied as (select family, sum(m * m * m - m) as ties from (select family, abs(v) as a, count(*) as m from r group by all) q group by 1), y as (select *, (least(w_plus, w_minus) - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2 * n + 1) / 24e0 - ties / 48e0) as z from w join tied using (family)) select family, n, round(w_plus, 2) + 0 as w_plus, round(w_minus, 2) + 0 as w_minus, round({normal_sql('z')}, 7) + 0 as p from y", "pvalues")
def t1(spark, sf):
    w = st.wilcoxon(view(spark, sf, "pvalues").select("family", (F.col("p") - 0.05).alias("v")), ["family"])
    return w.select("family", "n", fixed("w_plus", 2).alias("w_plus"), fixed("w_minus", 2).alias("w_minus"), fixed("p", 7).alias("p"))


KRUSKAL = f"{RESPONSES}, d as (select session_id, roi, stimulus, round(delta_mean, 6) as v from r where delta_mean is not null), k as (select session_id, roi, stimulus, rank() over (partition by session_id, roi order by v) + (count(*) over (partition by session_id, roi, v) - 1) / 2e0 as r, count(*) over (partition by session_id, roi, v) as c from d), g as (select session_id, roi, stimulus, count(*) n, sum(r) s, sum(c * c - 1) t from k group by all), h as (select session_id, roi, cast(sum(n) as bigint) as n, count(*) as groups, (12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - sum(t) / (sum(n) * sum(n) * sum(n) - sum(n))) as h from g group by 1, 2 having count(*) >= 2)"


@query("t2_kruskal", f"with {KRUSKAL} select session_id, roi, n, groups, round(h, 6) + 0 as h, round({chi_square_sql('h', '(groups - 1)')}, 7) + 0 as p from h", "traces", "onsets")
def t2(spark, sf):
    """Responses are taken to 6 digits, so that equal ones tie whatever the order in which they were summed."""
    h = st.kruskal(responses(spark, sf).withColumn("v", fixed("delta_mean", 6)), K)
    return h.select(*K, "n", "groups", fixed("h", 6).alias("h"), fixed("p", 7).alias("p"))


@query("t3_mann_whitney", f"with g as (select distinct family from pvalues), pr as (select a.family as a, b.family as b from g a join g b on a.family < b.family), x as (select a, b, family, p from pr join pvalues on family in (a, b)), r as (select a, b, family, p, rank() over (partition by a, b order by p) + (count(*) over (partition by a, b, p) - 1) / 2e0 as r, count(*) over (partition by a, b, p) as c from x), u as (select a, b, count(*) filter (family = a) as na, count(*) filter (family = b) as nb, quantile_cont(p, 0.5) filter (family = a) as med_a, quantile_cont(p, 0.5) filter (family = b) as med_b, sum(r) filter (family = a) - count(*) filter (family = a) * (count(*) filter (family = a) + 1) / 2e0 as u, sum(c * c - 1) as t from r group by 1, 2), z as (select *, greatest((abs(u - na * nb / 2e0) - 0.5e0) / sqrt(na * nb / 12e0 * (na + nb + 1 - t / ((na + nb) * (na + nb - 1e0)))), 0) as z from u), p as (select *, {normal_sql('z')} as p from z), q as (select *, p * count(*) over () / row_number() over (order by p, a, b) as q, row_number() over (order by p, a, b) as k from p) select a, b, na, nb, round(med_a, 8) + 0 as med_a, round(med_b, 8) + 0 as med_b, round(u, 2) + 0 as u, round(p, 7) + 0 as p, round(least(min(q) over (order by k desc rows unbounded preceding), 1), 7) + 0 as q from q", "pvalues")
def t3(spark, sf):
    u = st.mann_whitney(view(spark, sf, "pvalues").withColumnRenamed("p", "v"), "family", [])
    u = st.benjamini_hochberg(u.withColumn("one", F.lit(1)), ["one"])
    return u.select("a", "b", "na", "nb", fixed("med_a", 8).alias("med_a"), fixed("med_b", 8).alias("med_b"), fixed("u", 2).alias("u"), fixed("p", 7).alias("p"), fixed("q", 7).alias("q"))


@query("t4_benjamini_hochberg", "with k as (select family, event_id, p, row_number() over (partition by family order by p, event_id) as k, count(p) over (partition by family) as m from pvalues), q as (select *, p * m / k as q from k) select family, event_id, round(least(greatest(min(q) over (partition by family order by k desc rows unbounded preceding), 0), 1), 8) + 0 as q from q", "pvalues")
def t4(spark, sf):
    return st.benjamini_hochberg(view(spark, sf, "pvalues"), ["family"]).select("family", "event_id", fixed("q", 8).alias("q"))


@query("t5_permutation_fve")
def t5(spark, sf):
    return st.permutation_fve(responses(spark, sf).withColumnRenamed("delta_mean", "v"), K)


@query("t6_manova")
def t6(spark, sf):
    return st.manova(view(spark, sf, "trials").withColumn("roi", F.lit(1)), ["roi"])


@query("t7_affine", "select session_id, roi, regr_count(v, i) as n, round(regr_slope(v, i), 6) + 0 as slope, round(regr_intercept(v, i), 4) + 0 as intercept, round(sqrt(regr_syy(v, i) * (1 - regr_r2(v, i)) / regr_count(v, i)), 4) + 0 as rmse from traces group by all", "traces")
def t7(spark, sf):
    a = st.affine(traces(spark, sf).select(*K, F.col("i").alias("src"), F.col("v").alias("dst")), K)
    return a.select(*K, "n", fixed("slope", 6).alias("slope"), fixed("intercept", 4).alias("intercept"), fixed("rmse", 4).alias("rmse"))


@query("t8_best_shift", "with a as (select session_id, row_number() over w - 1 as n, lead(t) over w - t as x from log where value = 'Frame' window w as (partition by session_id order by t)), b as (select session_id, row_number() over w - 1 as m, lead(t) over w - t as y from log where value = 'Omission' window w as (partition by session_id order by t)), f as (select a.session_id, s as shift, sqrt(avg((x - y) * (x - y))) as rmse from a, (select unnest(range(-10, 11)) as s) g, b where a.n < 20 and x is not null and y is not null and b.session_id = a.session_id and b.m = a.n + s group by all having count(*) >= 5) select session_id, arg_min(shift, (rmse, shift)) as shift, round(min(rmse), 3) + 0 as rmse from f group by 1", "log")
def t8(spark, sf):
    log = view(spark, sf, "log")
    s = st.best_shift(log.where("value = 'Frame'"), log.where("value = 'Omission'"))
    return s.select("session_id", F.col("shift").cast("bigint").alias("shift"), fixed("rmse", 3).alias("rmse"))


#: Frames, and the edges that every 30th of them makes on a clock that runs 0.1 % fast and jitters, in units of 1e5 s.
TRAINS = """z as (select session_id, min(t) as z from log group by 1), f as (select session_id, row_idx, (t - z) / 1e5 as t from log join z using (session_id) where value = 'Frame'),
fl as (select session_id, t, row_idx % 30 as phase, row_number() over (partition by session_id, row_idx % 30 order by t) - 1 as n from f),
e as (select session_id, dst, row_number() over (partition by session_id order by dst) - 1 as r, min(dst) over (partition by session_id) as seg_start from (select session_id, t * 1.001e0 + 0.3e0 + (row_idx * 7919 % 100) / 1e3 as dst from f where row_idx % 30 = 7) q),
l as (select fl.session_id, phase, s.r as start, s.seg_start, regr_count(e.dst, fl.t) as n, regr_slope(e.dst, fl.t) as slope, regr_intercept(e.dst, fl.t) as intercept, sqrt(greatest(regr_syy(e.dst, fl.t) * (1 - regr_r2(e.dst, fl.t)), 0) / regr_count(e.dst, fl.t)) as rmse from fl join e s on s.session_id = fl.session_id and (s.r = 0 or s.dst < 3.25) join e on e.session_id = fl.session_id and e.r = s.r + fl.n group by 1, 2, 3, 4),
c as (select * from l where n >= 3 and slope between 0.98 and 1.02 and abs(intercept) <= 3)"""


def trains(spark, sf):
    log = view(spark, sf, "log")
    z = log.groupBy("session_id").agg(F.min("t").alias("z"))
    f = log.where("value = 'Frame'").join(z, "session_id").select("session_id", F.col("row_idx").alias("frame"), ((F.col("t") - F.col("z")) / 1e5).alias("t"))
    e = f.where("frame % 30 = 7").select("session_id", (F.col("t") * 1.001 + 0.3 + (F.col("frame") * 7919 % 100) / 1e3).alias("t"))
    return f, e


@query("j10_candidates", f"with {TRAINS} select session_id, phase, start, n, round(slope, 6) + 0 as slope, round(intercept, 4) + 0 as intercept, round(rmse, 4) + 0 as rmse from c", "log")
def j10(spark, sf):
    c = st.alignment_candidates(*trains(spark, sf), least_pairs=3)
    return c.select("session_id", "phase", "start", "n", fixed("slope", 6).alias("slope"), fixed("intercept", 4).alias("intercept"), fixed("rmse", 4).alias("rmse"))


@query("t9_phase_alignment", f"with {TRAINS}, m as (select *, min(rmse) over (partition by session_id) as br, max(n) over (partition by session_id) as bn, rmse * rmse + pow((intercept - 0.3e0) / 0.25e0, 2) as score from c), k as (select *, row_number() over (partition by session_id order by seg_start, score, start, rmse, phase) as k from m where rmse <= 1.2 * br and n >= floor(0.95e0 * bn)) select session_id, phase, start, n, round(slope, 6) + 0 as slope, round(intercept, 4) + 0 as intercept, round(rmse, 4) + 0 as rmse from k where k = 1", "log")
def t9(spark, sf):
    a = st.phase_alignment(*trains(spark, sf), least_pairs=3)
    return a.select("session_id", "phase", "start", "n", fixed("slope", 6).alias("slope"), fixed("intercept", 4).alias("intercept"), fixed("rmse", 4).alias("rmse"))


ACTIVATION = f"{RESPONSES}, o as (select session_id, roi, case when stimulus in ('im0', 'im1', 'im2', 'im3') then 'low' else 'high' end as family, delta_mean as v from r where delta_mean is not null), g as (select session_id, roi, family, count(*) as n_events, quantile_cont(v, 0.5) as median, avg(v) as mean from o group by all), k as (select session_id, roi, family, v, abs(v) as a, rank() over (partition by session_id, roi, family order by abs(v)) + (count(*) over (partition by session_id, roi, family, abs(v)) - 1) / 2e0 as r, count(*) over (partition by session_id, roi, family, abs(v)) as c from o where v <> 0), sw as (select session_id, roi, family, count(*) as n, least(coalesce(sum(r) filter (v > 0), 0), coalesce(sum(r) filter (v < 0), 0)) as w, sum(c * c - 1) as t from k group by all), z as (select *, (w - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2 * n + 1) / 24e0 - t / 48e0) as z from sw), p as (select session_id, roi, family, n_events, median, mean, case when n_events >= 8 then {normal_sql('z')} end as p from g left join z using (session_id, roi, family)), q as (select *, count(p) over (partition by session_id, roi) as m, row_number() over (partition by session_id, roi order by p nulls last) as k from p), b as (select *, case when p is not null then least(min(p * m / k) over (partition by session_id, roi order by k desc rows unbounded preceding), 1) end as q from q)"


@query("t11_activation", f"with {ACTIVATION} select session_id, roi, family, n_events, round(median, 6) + 0 as median, round(mean, 6) + 0 as mean, round(p, 7) + 0 as p, round(q, 7) + 0 as q, case when q < 0.05 and median > 0 then 'activated' when q < 0.05 and median < 0 then 'suppressed' else 'no_change' end as response_class, case when median > 0 then 'up' when median < 0 then 'down' else 'none' end as direction from b", "traces", "onsets")
def t11(spark, sf):
    """By the normal approximation, which SQL can express; ``t11_activation_classes`` has exact p."""
    r = responses(spark, sf).withColumn("family", F.when(F.col("stimulus").isin("im0", "im1", "im2", "im3"), "low").otherwise("high")).withColumnRenamed("delta_mean", "v")
    a = st.activation(r.where("v is not null"), K, exact=0)
    return a.select(*K, "family", "n_events", fixed("median", 6).alias("median"), fixed("mean", 6).alias("mean"), fixed("p", 7).alias("p"), fixed("q", 7).alias("q"), "response_class", "direction")


@query("t11_activation_classes")
def t11c(spark, sf):
    r = responses(spark, sf).withColumn("family", F.lit("image")).withColumnRenamed("delta_mean", "v")
    return st.activation(r, K).select(*K, "p", "q", "response_class")


SEQ = f"{RESPONSES}, s as (select session_id, roi, stimulus, event_id, delta_mean as response, row_number() over (partition by session_id, roi, stimulus order by event_id) as position from r)"


def sequence(spark, sf):
    from pyspark.sql import Window

    r = responses(spark, sf)
    return r.select(*K, "stimulus", F.col("delta_mean").alias("response"), F.lit(1).alias("n"), F.row_number().over(Window.partitionBy(*K, "stimulus").orderBy("event_id")).alias("position"))


G = [*K, "stimulus"]


@query("t13_adaptation", f"with {SEQ}, a as (select session_id, roi, stimulus, arg_min(response, position) as r0, arg_max(response, position) as rlast, count(*) as n_positions from s group by all) select session_id, roi, stimulus, round(r0, 6) + 0 as r0, round(rlast, 6) + 0 as rlast, n_positions, round((r0 - rlast) / (abs(r0) + abs(rlast) + 1e-12), 8) + 0 as index from a", "traces", "onsets")
def t13(spark, sf):
    a = st.adaptation(sequence(spark, sf), G)
    return a.select(*G, fixed("r0", 6).alias("r0"), fixed("rlast", 6).alias("rlast"), "n_positions", fixed("index", 8).alias("index"))


@query("a40_adaptation_split", f"with {SEQ}, a as (select session_id, roi, stimulus, arg_min(response, position) as r0, arg_max(response, position) as rlast from s group by all) select session_id, rlast < r0 as adapting, count(*) as n, round(avg(rlast - r0), 6) + 0 as mean_change from a group by 1, 2", "traces", "onsets")
def a40(spark, sf):
    a = sl.adaptation_split(st.adaptation(sequence(spark, sf), G), ["session_id"])
    return a.select("session_id", "adapting", "n", fixed("mean_change", 6).alias("mean_change"))


BINS = f"{SEQ}, b as (select *, greatest(((position - 1) * 3 + greatest(c - 1, 1) - 1) // greatest(c - 1, 1) - 1, 0) as bin from (select *, count(*) over (partition by session_id, roi, stimulus) as c from s) q), m as (select session_id, roi, stimulus, bin, avg(position) as center, avg(response) as response, count(*) as n from b group by all)"


@query("t14_sequence_bins", f"with {BINS} select session_id, roi, stimulus, bin, round(center, 6) + 0 as center, round(response, 8) + 0 as response, n from m", "traces", "onsets")
def t14(spark, sf):
    b = st.sequence_bins(sequence(spark, sf), G)
    return b.select(*G, "bin", fixed("center", 6).alias("center"), fixed("response", 8).alias("response"), "n")


@query("t14_sequence_slopes", f"with {BINS}, st as (select *, (response - lag(response) over x) / nullif(center - lag(center) over x, 0) as step from m window x as (partition by session_id, roi, stimulus order by bin)), g as (select session_id, roi, stimulus, regr_slope(response, center) as o, arg_min(step, bin) filter (step is not null) as e, arg_max(step, bin) filter (step is not null) as l from st group by all), t as (select *, 0.25e0 * greatest(abs(e), abs(l), abs(o)) as bar from g), c as (select *, case when abs(e) < bar then 0 else sign(e) end as se, case when abs(l) < bar then 0 else sign(l) end as sl, case when abs(o) < bar then 0 else sign(o) end as so from t) select session_id, roi, stimulus, round(o, 7) + 0 as overall, round(e, 7) + 0 as early, round(l, 7) + 0 as late, case when se = 0 and sl = 0 and so = 0 then 'stable' when se * sl < 0 then 'biphasic' when (case when so <> 0 then so when se <> 0 then se else sl end) > 0 then 'facilitating' else 'adapting' end as pattern from c", "traces", "onsets")
def t14s(spark, sf):
    s = st.sequence_slopes(st.sequence_bins(sequence(spark, sf), G), G)
    return s.select(*G, fixed("overall", 7).alias("overall"), fixed("early", 7).alias("early"), fixed("late", 7).alias("late"), "pattern")


@query("t14_sequence_normalise", f"with {SEQ} select session_id, roi, stimulus, position, round(response / max(abs(response)) over (partition by session_id, roi, stimulus), 8) + 0 as normalised from s", "traces", "onsets")
def t14n(spark, sf):
    return st.sequence_normalise(sequence(spark, sf), G).select(*G, "position", fixed("normalised", 8).alias("normalised"))


@query("t14_sequence_rank", f"with {RESPONSES}, m as (select session_id, roi, stimulus, avg(delta_mean) as m from r group by all), s as (select *, m - (sum(m) over w - m) / (count(m) over w - 1) as sel from m window w as (partition by session_id, roi)) select session_id, roi, stimulus, round(sel, 6) + 0 as selectivity, row_number() over (partition by session_id, roi order by sel desc, stimulus) as image_rank from s", "traces", "onsets")
def t14r(spark, sf):
    p = rs.per_image(responses(spark, sf).withColumnRenamed("delta_mean", "v"), K)
    return st.sequence_rank(p, K).select(*G, fixed("selectivity", 6).alias("selectivity"), "image_rank")


@query("a41_slope_summary", f"with {BINS}, g as (select session_id, roi, stimulus, case when count(*) > 1 then regr_slope(response, center) end as o from m group by all) select session_id, roi, round(max(abs(o)), 7) + 0 as max_abs, round(quantile_cont(abs(o), 0.5), 7) + 0 as median_abs, round(asinh(max(abs(o)) / 0.001e0), 6) + 0 as scaled from g group by 1, 2", "traces", "onsets")
def a41(spark, sf):
    s = sl.slope_summary(st.sequence_slopes(st.sequence_bins(sequence(spark, sf), G), G), K)
    return s.select(*K, fixed("max_abs", 7).alias("max_abs"), fixed("median_abs", 7).alias("median_abs"), fixed("scaled", 6).alias("scaled"))


@query("t15_principal_components")
def t15(spark, sf):
    wide = view(spark, sf, "trials").groupBy("event_index").pivot("k", list(range(64))).agg(F.first("v"))
    names = [f"k{k}" for k in range(64)]
    pc = st.principal_components(wide.toDF("event_index", *names), names, 11)
    return pc.select("event_index", *[fixed(F.col("scores")[i], 6).alias(f"pc{i + 1}") for i in range(11)], fixed(F.col("cumulative")[10], 6).alias("cumulative"))


@query("t15_wide_components")
def t15w(spark, sf):
    rows = view(spark, sf, "trials").groupBy("event_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("x"))
    fitted = cp.fit_wide(rows, 3)
    return cp.scores(rows, fitted).select("event_index", *[F.col("scores")[i].alias(f"pc{i + 1}") for i in range(3)])


@query("t15_first_component")
def t15f(spark, sf):
    t = traces(spark, sf)
    shared = t.groupBy("session_id", "roi").agg(F.max("i").alias("n")).groupBy("session_id").agg(F.min("n").alias("n"))
    t = t.join(shared, "session_id").where(F.col("i") <= F.col("n")).drop("n")
    trace, order = cp.first_component(t, ["session_id"])
    best = order.where("place = 1").select("session_id", F.col("roi").alias("first_roi"))
    return trace.join(best, "session_id").groupBy("session_id", "first_roi").agg(F.count("*").alias("n"), fixed(F.sum(F.col("trace") * F.col("trace")), 6).alias("length"))


@query("l3_component_order")
def l3(spark, sf):
    return sl.places(t15(spark, sf).withColumn("group", F.col("event_index") % 10), ["group"], "pc1", "event_index").select("event_index", "group", "place")


@query("w27_regress_out", "with c as (select session_id, roi, covar_pop(v, x) / var_pop(x) as b, avg(v) as mv, avg(x) as mx from (select session_id, roi, v, ln(1 + i % 13) as x from traces) q group by all) select t.session_id, t.roi, i, round(v - mv - b * (ln(1 + i % 13) - mx), 2) + 0 as residual from traces t join c using (session_id, roi)", "traces")
def w27(spark, sf):
    t = traces(spark, sf).withColumn("x", F.log(1 + F.col("i") % 13))
    return st.regress_out(t, K, "v", ["x"], ridge=0.0).select(*K, "i", fixed("residual", 2).alias("residual"))
