"""Queries of image sequences and session time."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolock.catalog import query, view
from chronolock.functions import fixed
from chronolock.operators import events as ev
from chronolock.operators import sequences as sq
from chronolock.operators import signals as sg
from chronolock.plans.core import EPOCHS, POST, PRE, TARGETS, WINDOWS, epochs_of, windows
from chronolock.plans.signal import EDGES

SEQUENCES = f"""{TARGETS}, {WINDOWS}, im as (select session_id, event_id, c // 5 - 1 as e from onsets), sw as (select w.session_id, roi, im.e as event_idx, k, v from w join im using (session_id, event_id)),
o as (select session_id, row_idx, row_number() over (partition by session_id order by row_idx) - 1 as e from images),
s as (select o.session_id, o.e as start, lead(o.e) over (partition by o.session_id order by o.e) as nxt, row_number() over (partition by o.session_id order by o.e) as seq_id from o join targets using (session_id, row_idx) where o.e >= 2),
l as (select session_id, max(e) as last from o group by 1), b as (select s.*, last from s join l using (session_id)),
q as (select session_id, seq_id, 'prechange' as category, p as position, start - 2 + p as event_idx from b, (values (0), (1)) v(p)
union all select session_id, seq_id, 'repeated', e - start, e from (select session_id, seq_id, start, unnest(range(start, coalesce(nxt, last + 1))) as e from b)
union all select session_id, seq_id, 'terminal', 0, coalesce(nxt, last) from b),
th as (select distinct q.*, sw.roi from q join sw using (session_id, event_idx)),
nw as (select *, count(*) over (partition by session_id, roi, seq_id, category) as n, row_number() over (partition by session_id, roi, seq_id, category order by position) - 1 as place from th),
kp as (select session_id, roi, seq_id, category, event_idx, case category when 'terminal' then 999 when 'repeated' then place else position end as position from nw where category <> 'prechange' or n = 2),
sr as (select kp.*, k, v from kp join sw using (session_id, roi, event_idx))"""


def sequence_parts(spark, sf):
    """Traces, images with their centers, and sequences."""
    images = view(spark, sf, "onsets").select("session_id", (F.col("c") / 5 - 1).cast("int").alias("event_idx"), "c")
    return view(spark, sf, "traces"), images, ev.change_sequences(view(spark, sf, "log"))


@query("a3_sequence_windows", f"with {SEQUENCES} select session_id, roi, category, count(*) as n, count(distinct seq_id) as n_seq, cast(sum(position) as bigint) as positions from sr group by all", "log", "traces", "onsets")
def a3(spark, sf):
    return sq.sequence_samples(*sequence_parts(spark, sf), PRE, POST).groupBy("session_id", "roi", "category").agg(F.count("*").alias("n"), F.countDistinct("seq_id").alias("n_seq"), F.sum("position").cast("bigint").alias("positions"))


@query("a2_sequence_summary", f"with {SEQUENCES} select session_id, roi, category, position, k, round(avg(v), 8) + 0 as mean, round(stddev_pop(v), 5) + 0 as std, count(distinct seq_id) as n from sr group by all", "log", "traces", "onsets")
def a2(spark, sf):
    s = sq.sequence_curves(*sequence_parts(spark, sf), PRE, POST)
    return s.select("session_id", "roi", "category", "position", "k", fixed("mean", 8).alias("mean"), fixed("std", 5).alias("std"), "n")


@query("a35_mean_responses", f"with {WINDOWS}, m as (select session_id, roi, stimulus, k, avg(v) as m from w group by all) select stimulus, k, round(avg(m), 5) + 0 as mean, round(stddev_pop(m) / sqrt(count(m)), 5) + 0 as sem, count(m) as n from m group by 1, 2", "traces", "onsets")
def a35(spark, sf):
    return sq.mean_responses(windows(spark, sf)).select("stimulus", "k", fixed("mean", 5).alias("mean"), fixed("sem", 5).alias("sem"), "n")


@query("w46_session_zero", f"with {EPOCHS} select session_id, round(coalesce(min(case when session_id % 2 = 0 then e.start_time end), min(l.z)), 3) + 0 as zero from (select session_id, min(t) as z from log group by 1) l left join epochs e using (session_id) group by 1", "log")
def w46(spark, sf):
    e = epochs_of(spark, sf).where("session_id % 2 = 0")
    return sq.session_zero(view(spark, sf, "log"), e).withColumn("zero", fixed("zero", 3))


@query("w13_padded", "with n as (select session_id, max(i) + 1 as n from traces group by 1), o as (select session_id, roi, row_number() over (partition by session_id order by roi) - 1 as o from (select distinct session_id, roi from traces) q) select session_id, roi, i, o * n + i as session_i from traces join n using (session_id) join o using (session_id, roi)", "traces")
def w13(spark, sf):
    return sq.padded(view(spark, sf, "traces"), "roi").select("session_id", "roi", "i", F.col("session_i").cast("bigint").alias("session_i"))


@query("u3_one_train", f"with {EDGES} select session_id, round(t, 3) + 0 as t, row_number() over (partition by session_id order by t) as n from edges", "samples")
def u3(spark, sf):
    e = sg.edges(view(spark, sf, "samples"), ["session_id"])
    return sq.one_train(e.where("step = 1"), e.where("step = -1")).select("session_id", fixed("t", 3).alias("t"), "n")
