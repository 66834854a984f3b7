"""Queries of readers, writers and composites that unite tables: what Spark derives from the test tables is
written to the shared folder and read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronolock import sources
from chronolock.catalog import query, table, view
from chronolock.functions import fixed
from chronolock.functions.lineage import shared_folder, stored
from chronolock.operators import packaging as pg
from chronolock.operators import registry as rg

K = ["session_id", "roi"]


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def log_files(spark, sf) -> str:
    """Logs as CSV, in two orders of columns, one with a column that the other lacks; one file has no time."""
    at = folder(spark, "logs")
    log = view(spark, sf, "log").select(F.col("row_idx").cast("string").alias("Frame"), F.col("t").cast("decimal(20,6)").cast("string").alias("Timestamp"), F.col("value").alias("Value"), "session_id")
    for s, columns in ((0, ("Frame", "Timestamp", "Value")), (1, ("Value", "Timestamp", "Frame", "Extra")), (2, ("Timestamp", "Unnamed: 0", "Value", "Frame")), (3, ("Frame", "Value"))):
        own = log.where(F.col("session_id") == s).withColumn("Extra", F.upper("Value")).withColumn("Unnamed: 0", F.lit("x"))
        own.select(*[F.col(f"`{c}`") for c in columns]).write.option("header", True).csv(f"{at}/s{s}")
    return at


@query("s1_event_log", "select concat('s', session_id) as session_id, cast(row_idx as int) as frame, round(t, 5) + 0 as t, value, case when session_id = 1 then upper(value) end as extra from log where session_id < 3", "log")
def s1(spark, sf):
    got = sources.read_event_log(spark, f"{log_files(spark, sf)}/*/*.csv")
    return got.select("session_id", F.col("Frame").alias("frame"), fixed("Timestamp", 5).alias("t"), F.col("Value").alias("value"), F.col("Extra").alias("extra"))


@query("s13_concatenated", "select 'read' as status, cast(null as varchar) as reason, count(*) as n from log where session_id < 3 union all select 'skipped', 'lacks Timestamp', 0", "log")
def s13(spark, sf):
    rows, report = sources.concatenated_files(spark, f"{log_files(spark, sf)}/*/*.csv", ("Frame", "Timestamp", "Value"))
    n = rows.agg(F.count("*").alias("n"))
    said = report.select("status", "reason").distinct()
    return said.crossJoin(n).select("status", "reason", F.when(F.col("status") == "read", F.col("n")).otherwise(0).alias("n"))


@query("s2_corrected_log", "select concat('s', session_id) as session_id, value, round(t + 3, 5) + 0 as t_corr from log where session_id < 2", "log")
def s2(spark, sf):
    at = folder(spark, "corrected")
    log = view(spark, sf, "log").withColumn("at", (F.col("t") + 3).cast("decimal(20,6)").cast("string"))
    for s, columns in ((0, ("Value", "corrected_timestamps")), (1, ("corrected_timestamp", "Value"))):
        named = log.where(F.col("session_id") == s).select(F.col("value").alias("Value"), F.col("at").alias(next(c for c in columns if c != "Value")))
        named.select(*columns).write.option("header", True).csv(f"{at}/s{s}")
    return sources.read_corrected_log(spark, f"{at}/*/*.csv").select("session_id", "value", fixed("t_corr", 5).alias("t_corr"))


@query("s3_epochs", "select concat('s', cast(o_custkey % 4 as varchar)) as session_id, min(o_orderkey) * 1e0 as start, max(o_orderkey) + 2e0 as stop, 2e0 * count(*) as total_s, count(*) as n_epochs from orders group by 1")
def s3(spark, sf):
    at = folder(spark, "epochs")
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 4).alias("s"), F.col("o_orderkey").alias("start_time"), (F.col("o_orderkey") + 2).alias("end_time"))
    for s in range(4):
        own = o.where(F.col("s") == s)
        own.select(*(("start_time", "end_time") if s % 2 else ("end_time", "start_time"))).write.option("header", True).csv(f"{at}/s{s}")
    return sources.epoch_spans(sources.read_epochs(spark, f"{at}/*/*.csv"))


@query("s4_traces", "select session_id, roi, i, round(v, 4) + 0 as v from traces where session_id in (1, 3) and i >= 5 and i < 40", "traces")
def s4(spark, sf):
    at = folder(spark, "traces")
    t = view(spark, sf, "traces").withColumnRenamed("v", "dF")
    sources.write_tables({"traces": t}, at)
    got = sources.read_traces(spark, f"{at}/traces", sessions=[1, 3], first=5, last=40)
    return got.select(*K, "i", fixed("v", 4).alias("v"))


@query("s6_voltage", "select session_id, roi, i, case when i % 11 > 0 then round(v * 2, 4) + 0 end as v from traces", "traces")
def s6(spark, sf):
    at = folder(spark, "voltage")
    t = view(spark, sf, "traces")
    t.select(*K, "i", F.when(F.col("i") % 11 > 0, F.col("v") * 2).otherwise(F.lit(float("nan"))).alias("spike")).write.parquet(at)
    return sources.read_traces(spark, at, signal="spike").select(*K, "i", fixed("v", 4).alias("v"))


@query("s8_registry", "select cast(o_orderkey as varchar) as session_id, case when o_orderkey % 5 > 0 then cast(o_orderdate as date) end as session_date from orders")
def s8(spark, sf):
    at = folder(spark, "registry")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate").cast("date").cast("string")).otherwise("unknown").alias("session_date"))
    o.where("session_id % 2 = 0").write.option("header", True).csv(f"{at}/a")
    o.where("session_id % 2 = 1").select("session_date", "session_id").write.option("header", True).csv(f"{at}/b")
    return sources.read_registry(spark, f"{at}/*/*.csv").select("session_id", "session_date")


@query("s9_documents", "select count(*) as n, sum(c_custkey) as keys, sum(round(c_acctbal * 100)) as cents from customer")
def s9(spark, sf):
    at = folder(spark, "documents")
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    sources.write_documents(c, at)
    rows = spark.read.text(at).withColumnRenamed("value", "body")
    got = rg.flatten_json(rows, {"key": ["$.missing", "$.c_custkey"], "balance": ["$.c_acctbal"]})
    return got.agg(F.count("*").alias("n"), F.sum(F.col("key").cast("long")).alias("keys"), F.sum(F.round(F.col("balance").cast("double") * 100)).alias("cents"))


@query("s10_swc", "select neuron_id, node_id, parent_id, round(x, 5) + 0 as x, y, z from nodes", "nodes")
def s10(spark, sf):
    at = folder(spark, "swc")
    n = view(spark, sf, "nodes")
    line = F.concat_ws(" ", "node_id", F.lit("3"), "x", "y", "z", F.lit("1.0"), "parent_id")
    n.select(line.alias("value"), F.concat(F.lit("n"), "neuron_id").alias("neuron")).write.partitionBy("neuron").text(at)
    got = sources.read_swc(spark, f"{at}/*", by_folder=True)
    return got.select(F.regexp_extract("neuron_id", r"\d+", 0).cast("int").alias("neuron_id"), "node_id", "parent_id", fixed("x", 5).alias("x"), "y", "z")


@query("s11_measurements", "select concat('n', cast(neuron_id as varchar)) as neuron_id, cast(node_id as varchar) as node, case when neuron_id % 2 = 0 then cast(node_id % 7 as varchar) end as depth from nodes where neuron_id < 4", "nodes")
def s11(spark, sf):
    at = folder(spark, "measurements")
    n = view(spark, sf, "nodes").select("neuron_id", F.col("node_id").alias("node"), (F.col("node_id") % 7).alias("depth"))
    for k in range(4):
        n.where(F.col("neuron_id") == k).select(*(("depth", "node") if k % 2 == 0 else ("node",))).write.option("header", True).csv(f"{at}/n{k}")
    return sources.read_measurements(spark, f"{at}/*/*.csv").select("neuron_id", "node", "depth")


@query("s14_result_tables", "select session_id, roi, count(*) as n, 3 as copies from traces group by 1, 2", "traces")
def s14(spark, sf):
    at = folder(spark, "results")
    t = view(spark, sf, "traces").groupBy(*K).agg(F.count("*").alias("n"))
    t.write.option("header", True).csv(f"{at}/a.csv")
    t.write.json(f"{at}/a.json")
    t.write.parquet(f"{at}/a.parquet")
    got = sources.concatenated([sources.read_table(spark, f"{at}/a.{x}").select(F.col("session_id").cast("int").alias("session_id"), F.col("roi").cast("long").alias("roi"), F.col("n").cast("long").alias("n")) for x in ("csv", "json", "parquet")])
    return got.groupBy(*K, "n").agg(F.count("*").cast("int").alias("copies"))


@query("s17_assets", "select o_orderkey as session_id, case when o_orderkey % 4 = 1 then concat('/d/', o_orderkey, '/b/Summary', o_orderkey % 3 + 1, '.mat') when o_orderkey % 4 = 2 then concat('/f/', o_orderkey, '/old.mat') end as mat, case when o_orderkey % 4 = 1 then 0 when o_orderkey % 4 = 2 then 1 end as mat_rule, case when o_orderkey % 4 < 2 then concat('/d/', o_orderkey, '/k.harp/photodiode.pkl') end as photodiode from orders")
def s17(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("session_id"))
    s = o.select("session_id", F.concat(F.lit("/d/"), "session_id").alias("dir"), F.concat(F.lit("/f/"), "session_id", F.lit("/")).alias("spare"))
    key, mod = F.col("session_id"), F.col("session_id") % 4
    paths = F.array_compact(F.array(
        F.when(mod == 1, F.concat("dir", F.lit("/a/Summary9.mat"))),
        F.when(mod == 1, F.concat("dir", F.lit("/b/Summary"), key % 3 + 1, F.lit(".mat"))),
        F.when(mod == 2, F.concat("spare", F.lit("old.mat"))),
        F.when(mod < 2, F.concat("dir", F.lit("/k.harp/photodiode.pkl"))),
        F.concat("dir", F.lit("/photodiode.pkl")),
    ))
    files = s.select(F.posexplode(paths).alias("n", "path")).select("path", F.timestamp_seconds(F.col("n")).alias("mtime"))
    rules = {"mat": [("dir", r"Summary\d\.mat"), ("spare", r"old\.mat")], "harp": [("dir", r".*\.harp")], "photodiode": [("dir", r"photodiode\.pkl")]}
    return rg.resolved_assets(s, files, rules, {"photodiode": "harp"}).select("session_id", "mat", "mat_rule", "photodiode")


@query("s18_trials", "with t as (select distinct session_id, unnest(range(0, 12)) as trial from traces), x as (select session_id, roi, i // 10 as trial, v from traces where i // 10 not in (2, 5)) select t.session_id, cast(t.trial as bigint) as trial, count(v) as n from t left join x using (session_id, trial) group by all", "traces")
def s18(spark, sf):
    x = view(spark, sf, "traces").withColumn("trial", F.floor(F.col("i") / 10)).where(~F.col("trial").isin(2, 5))
    t = view(spark, sf, "traces").select("session_id").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    return sources.with_invalid_trials(t, x).groupBy("session_id", "trial").agg(F.count("v").alias("n"))


@query("k1_tables", "select session_id, count(*) as n, round(sum(v), 2) + 0 as total, 'csv,parquet' as formats, 1 as metadata from traces group by 1", "traces")
def k1(spark, sf):
    at = folder(spark, "tables")
    t = view(spark, sf, "traces")
    sources.write_tables({"traces": t}, at, formats=("parquet", "csv"), metadata={"rate": 200})
    a = spark.read.parquet(f"{at}/traces").groupBy("session_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    b = spark.read.option("header", True).option("inferSchema", True).csv(f"{at}/traces_csv").groupBy("session_id").agg(F.count("*").alias("m"))
    meta = spark.read.text(f"{at}/run_metadata").agg(F.count_if(F.get_json_object("value", "$.parameters.rate") == "200").cast("int").alias("metadata"))
    return a.join(b, "session_id").where("n = m").crossJoin(meta).select("session_id", "n", fixed("total", 2).alias("total"), F.lit("csv,parquet").alias("formats"), "metadata")


@query("k6_run_metadata", "select session_id, count(*) as n, '{\"rate\": 200}' as parameters, 'samples' as comment from traces group by 1", "traces")
def k6(spark, sf):
    t = view(spark, sf, "traces").groupBy("session_id").agg(F.count("*").alias("n"))
    out = sources.run_metadata(t, {"rate": 200}, {"n": "samples"})
    return out.withColumn("comment", F.lit(out.schema["n"].metadata["comment"]))


@query("u1_manifest", "select 'session' as level, cast(session_id as bigint) as session_id, subject_id, cast(null as bigint) as n from sessions union all select 'subject', null, subject_id, count(*) from sessions group by subject_id", "sessions")
def u1(spark, sf):
    s = view(spark, sf, "sessions")
    each = s.groupBy("subject_id").agg(F.count("*").alias("n"))
    return rg.manifest(each, s.select(F.col("session_id").cast("long").alias("session_id"), "subject_id")).select("level", "session_id", "subject_id", "n")


def trials(spark, sf):
    """Traces in two planes a session and trials of 50 samples; plane 2 of session 2 has no values."""
    t = view(spark, sf, "traces").select("session_id", (F.col("roi") % 2 + 1).cast("int").alias("dmd"), "roi", F.floor(F.col("i") / 50).cast("int").alias("trial"), (F.col("i") % 50).cast("int").alias("i"), "v")
    return t.withColumn("v", F.when(~((F.col("session_id") == 2) & (F.col("dmd") == 2)) & (F.col("trial") != 1), F.col("v")))


def planes(spark, sf):
    """Every session's planes, one without a rate, and a session without traces."""
    s = view(spark, sf, "traces").select("session_id").distinct().unionByName(spark.range(1).select(F.lit(9).alias("session_id")))
    p = s.withColumn("dmd", F.explode(F.array(F.lit(1), F.lit(2))))
    return p.withColumn("rate", F.when((F.col("session_id") == 3) & (F.col("dmd") == 1), 0.0).otherwise(200.0))


_PLANES = """x as (select session_id, cast(roi % 2 + 1 as int) as dmd, roi, i // 50 as trial, i % 50 as i, case when not (session_id = 2 and roi % 2 = 1) and i // 50 <> 1 then v end as v from traces),
p as (select session_id, dmd from (select distinct session_id from traces union all select 9) s cross join (values (1), (2)) d(dmd)),
c as (select session_id, dmd, count(distinct roi) as n_rois, count(v) as n_values from x group by all),
w as (select session_id, dmd, trial, count(v) > 0 as valid, max(i) + 1 as n from x group by all),
l as (select session_id, dmd, max(n) filter (valid) as slot from w group by all),
q as (select p.*, case when p.session_id = 3 and p.dmd = 1 then 'no valid rate' when n_rois is null then 'no traces' when n_values = 0 then 'no values' end as reason, coalesce(n_rois, 0) as n_rois from p left join c using (session_id, dmd))"""


@query("t17_packages", f"with {_PLANES}, r as (select session_id, dmd, count(x.v) as n, sum(x.v) as total, max(x.trial * l.slot + x.i) as last from x join w using (session_id, dmd, trial) join l using (session_id, dmd) where w.valid group by all) select session_id, dmd, case when reason is not null then 'skipped' when session_id = 0 then 'exists' else 'exported' end as status, reason, n_rois, case when reason is null then n end as n_values, case when reason is null then round(total / 1e3, 5) + 0 end as total, case when reason is null then last end as last from q left join r using (session_id, dmd)", "traces")
def t17p(spark, sf):
    at, t, p = folder(spark, "packages"), stored(trials(spark, sf)), planes(spark, sf)  # both runs read the trials several times

    def process(own):
        return own.withColumn("dff", F.col("v") / 1e3)

    pg.package(p.where("session_id = 0"), t, at, process)
    status = pg.package(p, t, at, process)
    there = spark.read.parquet(f"{at}/processed").where("v is not null").groupBy("session_id", "dmd").agg(F.count("v").alias("n_values"), fixed(F.sum("v"), 5).alias("total"), F.max("session_i").alias("last"))
    return status.drop("n_values").join(there, ["session_id", "dmd"], "left").select("session_id", "dmd", "status", "reason", "n_rois", "n_values", "total", "last")


_SPANS = {"image": (0.02, 0.04), "omission": (0.01, 0.02)}


@query("t17_planes", f"with {_PLANES}, z as (select session_id, min(t) as z from log group by 1), o as (select l.session_id, row_idx, case when value like '%.tiff' then 'image' when value = 'Omission' then 'omission' end as family, (t - z) / 5e6 as t from log l join z using (session_id)), y as (select x.*, x.trial * l.slot + x.i as s from x join w using (session_id, dmd, trial) join l using (session_id, dmd) where w.valid), b as (select session_id, dmd, roi, min(s) as lo, max(s) as hi from y group by all), f as (select *, case family when 'image' then 0.02e0 else 0.01e0 end as pre, case family when 'image' then 0.04e0 else 0.02e0 end as post from o where family is not null), e as (select session_id, family, row_idx, round_even(t * 200, 0)::bigint as c, round_even(pre * 200, 0)::bigint as pre, round_even(post * 200, 0)::bigint as post from f where t >= pre and t <= 0.6e0 - post), g as (select b.session_id, b.dmd, b.roi, family, row_idx, c, pre, post from e join b using (session_id) where c - pre >= lo and c + post - 1 <= hi), m as (select g.session_id, g.dmd, family, count(distinct row_idx) as n, count(y.v) as n_values, avg(y.v) as mean from g join y on y.session_id = g.session_id and y.dmd = g.dmd and y.roi = g.roi and y.s >= c - pre and y.s < c + post group by 1, 2, 3) select q.session_id, q.dmd, coalesce(reason, case when i.n is null and o.n is null then 'no events in epochs' end) as reason, case when reason is null then coalesce(i.n, 0) else 0 end as n_image, case when reason is null then coalesce(o.n, 0) else 0 end as n_omission, case when reason is null then i.n_values end as n_values, case when reason is null then round(i.mean, 6) + 0 end as mean from q left join (select * from m where family = 'image') i using (session_id, dmd) left join (select * from m where family = 'omission') o using (session_id, dmd)", "traces", "log")
def t17e(spark, sf):
    log = view(spark, sf, "log")
    zero = log.groupBy("session_id").agg(F.min("t").alias("z"))
    log = log.join(zero, "session_id").withColumn("t", (F.col("t") - F.col("z")) / 5e6)
    epochs = zero.select("session_id", F.lit(0.0).alias("start_time"), F.lit(0.6).alias("end_time")).unionByName(spark.createDataFrame([(9, 0.0, 0.6)], "session_id int, start_time double, end_time double"))
    got = pg.extract_planes(planes(spark, sf), trials(spark, sf), log, epochs, _SPANS)
    n = F.sum(F.when(F.col("v").isNotNull(), F.col("n_events")))
    mean = got["cut"].where("family = 'image'").groupBy("session_id", "dmd").agg(F.coalesce(n, F.lit(0)).alias("n_values"), fixed(F.sum(F.col("v") * F.col("n_events")) / n, 6).alias("mean"))
    return got["status"].drop("n_values").join(mean, ["session_id", "dmd"], "left").select("session_id", "dmd", "reason", "n_image", "n_omission", "n_values", "mean")
