"""Queries of neuron trees and pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolock.catalog import query, view
from chronolock.functions import fixed
from chronolock.operators import pixels as px
from chronolock.operators import trees as tr

EDGES = "edges as (select n.neuron_id, n.node_id, n.parent_id, n.x, n.y, n.z, p.x as px, p.y as py, p.z as pz, sqrt((n.x - p.x) ** 2 + (n.y - p.y) ** 2 + (n.z - p.z) ** 2) as length from nodes n join nodes p on p.neuron_id = n.neuron_id and p.node_id = n.parent_id)"
KINDS = "kids as (select neuron_id, parent_id as node_id, count(*) as n from nodes group by all), kinds as (select n.*, coalesce(k.n, 0) as n_children from nodes n left join kids k using (neuron_id, node_id))"


def nodes(spark, sf):
    return view(spark, sf, "nodes")


@query("g1_node_kinds", f"with {KINDS} select neuron_id, node_id, n_children, parent_id < 0 as is_root, n_children = 0 as is_tip, n_children > 1 as is_branch from kinds", "nodes")
def g1(spark, sf):
    return tr.node_kinds(nodes(spark, sf)).select("neuron_id", "node_id", "n_children", "is_root", "is_tip", "is_branch")


@query("j17_edges", f"with {EDGES} select neuron_id, node_id, round(length, 6) + 0 as length from edges", "nodes")
def j17(spark, sf):
    return tr.edges(nodes(spark, sf)).select("neuron_id", "node_id", fixed("length", 6).alias("length"))


@query("g2_cable", f"with {EDGES} select neuron_id, count(*) + 1 as n_nodes, round(sum(length), 4) + 0 as cable_um, round(avg(length), 5) + 0 as mean_edge_um, round(max(length), 5) + 0 as max_edge_um from edges group by 1", "nodes")
def g2(spark, sf):
    return tr.cable(nodes(spark, sf)).select("neuron_id", "n_nodes", fixed("cable_um", 4).alias("cable_um"), fixed("mean_edge_um", 5).alias("mean_edge_um"), fixed("max_edge_um", 5).alias("max_edge_um"))


WALK = f"{EDGES}, {KINDS}, walk as (select neuron_id, node_id, node_id as root, 0e0 as path_um, 0 as steps, 0 as branch_order from nodes where parent_id < 0 union all select e.neuron_id, e.node_id, w.root, w.path_um + e.length, w.steps + 1, w.branch_order + (k.n_children > 1)::int from walk w join edges e on e.neuron_id = w.neuron_id and e.parent_id = w.node_id join kinds k on k.neuron_id = e.neuron_id and k.node_id = e.parent_id)"


@query("g3_path_lengths", f"with {WALK} select neuron_id, node_id, root, round(path_um, 4) + 0 as path_um, steps from walk", "nodes")
def g3(spark, sf):
    return tr.path_lengths(nodes(spark, sf)).select("neuron_id", "node_id", "root", fixed("path_um", 4).alias("path_um"), "steps")


@query("g4_branch_orders", f"with {WALK} select neuron_id, node_id, branch_order from walk", "nodes")
def g4(spark, sf):
    return tr.branch_orders(nodes(spark, sf))


def strahler_sql(levels: int = 14) -> str:
    """Orders level by level: a node's order is over s if a node at or below it has two children of order s or
    more."""
    up = "above as (select neuron_id, node_id as low, node_id as node_id from nodes union select a.neuron_id, low, n.parent_id from above a join nodes n on n.neuron_id = a.neuron_id and n.node_id = a.node_id where n.parent_id >= 0)"
    steps = ["o1 as (select neuron_id, node_id from nodes)"]
    for s in range(1, levels):
        steps.append(f"b{s} as (select n.neuron_id, n.parent_id as low from o{s} o join nodes n using (neuron_id, node_id) where n.parent_id >= 0 group by 1, 2 having count(*) >= 2), o{s + 1} as (select distinct a.neuron_id, a.node_id from above a join b{s} using (neuron_id, low))")
    every = " union all ".join(f"select * from o{s}" for s in range(1, levels + 1))
    return f"{up}, {', '.join(steps)}, orders_ as (select neuron_id, node_id, count(*) as strahler from ({every}) group by 1, 2)"


@query("g5_strahler", f"with {strahler_sql()} select neuron_id, node_id, strahler from orders_", "nodes")
def g5(spark, sf):
    return tr.strahler(nodes(spark, sf))


@query("g6_annotated", f"with {WALK}, {strahler_sql()} select neuron_id, node_id, n_children, round(path_um, 4) + 0 as path_um, branch_order, strahler from walk join kinds using (neuron_id, node_id) join orders_ using (neuron_id, node_id)", "nodes")
def g6(spark, sf):
    return tr.annotated(nodes(spark, sf)).select("neuron_id", "node_id", "n_children", fixed("path_um", 4).alias("path_um"), "branch_order", "strahler")


@query("g7_segments", f"with {WALK}, ends as (select neuron_id, node_id from kinds where parent_id < 0 or n_children <> 1), up as (select e.neuron_id, e.node_id as end_id, d.parent_id as at, d.length as length_um, 2 as n_nodes from ends e join edges d using (neuron_id, node_id) union all select u.neuron_id, u.end_id, d.parent_id, u.length_um + d.length, u.n_nodes + 1 from up u join edges d on d.neuron_id = u.neuron_id and d.node_id = u.at where (u.neuron_id, u.at) not in (select neuron_id, node_id from ends)) select u.neuron_id, u.at as start_id, end_id, n_nodes, round(length_um, 4) + 0 as length_um from up u join ends x on x.neuron_id = u.neuron_id and x.node_id = u.at", "nodes")
def g7(spark, sf):
    return tr.segments(nodes(spark, sf)).withColumn("length_um", fixed("length_um", 4))


@query("g8_basic_metrics", f"with {WALK}, c as (select neuron_id, sum(length) as cable from edges group by 1) select neuron_id, count(*) as n_nodes, round(any_value(cable), 4) + 0 as cable_um, count(*) filter (n_children = 0) as n_tips, count(*) filter (n_children > 1) as n_branch_points, round(max(path_um), 4) + 0 as max_path_um, max(branch_order) as max_branch_order from walk join kinds using (neuron_id, node_id) join c using (neuron_id) group by 1", "nodes")
def g8(spark, sf):
    m = tr.basic_metrics(nodes(spark, sf))
    return m.select("neuron_id", "n_nodes", fixed("cable_um", 4).alias("cable_um"), "n_tips", "n_branch_points", fixed("max_path_um", 4).alias("max_path_um"), "max_branch_order")


SHOLL = f"{EDGES}, ro as (select neuron_id, x as rx, y as ry, z as rz from nodes where parent_id < 0), d as (select e.neuron_id, sqrt((x - rx) ** 2 + (y - ry) ** 2 + (z - rz) ** 2) as a, sqrt((px - rx) ** 2 + (py - ry) ** 2 + (pz - rz) ** 2) as b from edges e join ro using (neuron_id)), g as (select neuron_id, unnest(range(0, cast(ceil(max(greatest(a, b)) / 20) as bigint) + 1)) * 20e0 as radius from d group by 1), sholl as (select g.neuron_id, radius, count(d.a) as crossings from g left join d on d.neuron_id = g.neuron_id and ((a <= radius and b > radius) or (b <= radius and a > radius)) group by 1, 2)"


@query("g9_sholl", f"with {SHOLL} select * from sholl", "nodes")
def g9(spark, sf):
    return tr.sholl(nodes(spark, sf), 20.0)


@query("g10_compare", f"with {EDGES}, c as (select neuron_id, sum(length) as cable from edges group by 1) select neuron_id, round(cable - (cable * 0.5e0 + neuron_id), 4) + 0 as delta from c", "nodes")
def g10(spark, sf):
    c = tr.cable(nodes(spark, sf))
    other = c.select("neuron_id", (F.col("cable_um") * 0.5 + F.col("neuron_id")).alias("cable_um"))
    return tr.compare(c, other, ["cable_um"]).select("neuron_id", fixed("delta_cable_um", 4).alias("delta"))


@query("g11_average_curves", f"with {SHOLL}, c as (select neuron_id, neuron_id % 3 as cell_class, radius, crossings, lead(radius) over w as r1, lead(crossings) over w as y1 from sholl window w as (partition by neuron_id order by radius)), gr as (select unnest(range(0, 100)) * 7e0 as g), v as (select cell_class, g, case when r1 is null then crossings else crossings + (g - radius) * (y1 - crossings) / (r1 - radius) end as v from c join gr on g >= radius and (g < r1 or (r1 is null and g = radius))) select cell_class, g as radius, round(avg(v), 6) + 0 as mean, count(v) as n from v group by 1, 2", "nodes")
def g11(spark, sf):
    s = tr.sholl(nodes(spark, sf), 20.0).select("neuron_id", (F.col("neuron_id") % 3).alias("cell_class"), "radius", F.col("crossings").alias("inters"))
    return tr.average_curves(s, 7.0, 693.0).select("cell_class", "radius", fixed("mean", 6).alias("mean"), "n")


@query("g12_class_comparison", f"with {EDGES}, c as (select neuron_id % 3 as cell_class, sum(length) as cable from edges group by neuron_id) select cell_class, round(avg(cable), 4) + 0 as mean, round(stddev_samp(cable), 4) + 0 as sd, count(*) as n from c group by 1", "nodes")
def g12(spark, sf):
    c = tr.cable(nodes(spark, sf)).withColumn("cell_class", F.col("neuron_id") % 3)
    return tr.class_comparison(c, "cable_um").select("cell_class", fixed("mean", 4).alias("mean"), fixed("sd", 4).alias("sd"), "n")


@query("g13_smooth_lines")
def g13(spark, sf):
    p = nodes(spark, sf).select("neuron_id", F.col("node_id").alias("i"), "x", "y")
    return tr.smooth_lines(p, ["neuron_id"], 4).select("neuron_id", "j", fixed("sx", 5).alias("sx"), fixed("sy", 5).alias("sy"))


PIX = "p as (select session_id, roi, i % 5 as trial, cast(i // 20 as int) as y, cast((i // 5) % 4 as int) as x, v / 1e5 as w from traces)"


def pixels(spark, sf):
    return view(spark, sf, "traces").select("session_id", "roi", (F.col("i") % 5).alias("trial"), F.floor(F.col("i") / 20).cast("int").alias("y"), (F.floor(F.col("i") / 5) % 4).cast("int").alias("x"), (F.col("v") / 1e5).alias("w"))


@query("a36_mean_footprints", f"with {PIX} select session_id, roi, y, x, round(avg(w), 8) + 0 as w from p group by all", "traces")
def a36(spark, sf):
    return px.mean_footprints(pixels(spark, sf)).withColumn("w", fixed("w", 8))


@query("a36_centroids", f"with {PIX}, m as (select session_id, roi, y, x, avg(w) as w from p group by all) select session_id, roi, round(sum(y * w) / sum(w), 6) + 0 as cy, round(sum(x * w) / sum(w), 6) + 0 as cx from m group by 1, 2", "traces")
def a36c(spark, sf):
    c = px.centroids(px.mean_footprints(pixels(spark, sf)))
    return c.select("session_id", "roi", fixed("cy", 6).alias("cy"), fixed("cx", 6).alias("cx"))


@query("f23_boxes", f"with {PIX} select session_id, roi, greatest(min(y) - 1, 0) as y0, greatest(min(x) - 1, 0) as x0, max(y) + 1 as y1, max(x) + 1 as x1 from p where w > 0.9 group by all", "traces")
def f23(spark, sf):
    return px.bounding_boxes(pixels(spark, sf).where("w > 0.9"), 1)


@query("f23_orient", f"with {PIX}, t as (select session_id, roi, trial, x as y, y as x, w from p), b as (select session_id, max(x) as mx from t group by 1) select session_id, y, mx - x as x, count(*) as n from t join b using (session_id) group by all", "traces")
def f23o(spark, sf):
    o = px.orient(pixels(spark, sf), transpose=True, flip_x=True)
    return o.groupBy("session_id", "y", "x").agg(F.count("*").alias("n"))


@query("f23_crop", f"with {PIX}, b as (select session_id, min(y) + 0 as y0, min(x) as x0, max(y) as y1, max(x) as x1 from p where w > 1.02 group by 1) select p.session_id, y - y0 as y, x - x0 as x, count(*) as n from p join b using (session_id) where y between y0 and y1 and x between x0 and x1 group by all", "traces")
def f23c(spark, sf):
    p = pixels(spark, sf)
    return px.crop(p, px.bounding_boxes(p.where("w > 1.02"), 0, union=True)).groupBy("session_id", "y", "x").agg(F.count("*").alias("n"))


@query("s16_sparse_coordinates", "with m as (select distinct session_id, cast(roi % 10 as int) as y, cast(roi // 10 as int) as x from traces), o as (select *, row_number() over (partition by session_id order by x, y) - 1 as place from m) select session_id, place, y, x from o where y < 8", "traces")
def s16(spark, sf):
    m = view(spark, sf, "traces").select("session_id", (F.col("roi") % 10).cast("int").alias("y"), F.floor(F.col("roi") / 10).cast("int").alias("x")).distinct()
    v = m.groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("place"))
    return px.sparse_coordinates(m, v, 8).select("session_id", "place", "y", "x")


MOVIE = "mv as (select session_id, roi as y, i % 3 as x, i // 3 as t, case when i % 7 <> 0 then v end as v from traces)"


def movie(spark, sf):
    return view(spark, sf, "traces").select("session_id", F.col("roi").alias("y"), (F.col("i") % 3).alias("x"), F.floor(F.col("i") / 3).alias("t"), F.when(F.col("i") % 7 != 0, F.col("v")).alias("v"))


@query("a37_fill_movie", f"with {MOVIE}, m as (select session_id, y, x, avg(v) as m from mv group by all) select session_id, y, x, t, round(coalesce(v, m), 6) + 0 as v from mv join m using (session_id, y, x)", "traces")
def a37(spark, sf):
    return px.fill_movie(movie(spark, sf)).select("session_id", "y", "x", "t", fixed("v", 6).alias("v"))


@query("a38_movie_dff", f"with {MOVIE}, f as (select *, quantile_cont(v, 0.5) over (partition by session_id, y, x order by t rows between 10 preceding and 10 following) as f0 from mv) select session_id, y, x, t, round((v - f0) / greatest(50, f0 + 50), 7) + 0 as dff from f", "traces")
def a38(spark, sf):
    return px.movie_dff(movie(spark, sf), 10).select("session_id", "y", "x", "t", fixed("dff", 7).alias("dff"))


@query("l4_display_range", f"with {MOVIE} select session_id, round(quantile_cont(v, 0.02), 5) + 0 as low, round(quantile_cont(v, 0.98), 5) + 0 as high from mv group by 1", "traces")
def l4(spark, sf):
    return px.display_range(movie(spark, sf), ["session_id"]).select("session_id", fixed("low", 5).alias("low"), fixed("high", 5).alias("high"))
