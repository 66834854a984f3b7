"""Trees of reconstructed neurons: parent-pointer tables of many neurons at once.

Walks to the root go by pointer doubling: each round a node's pointer skips twice as far, so a tree of
depth d needs log2(d) joins.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from chronolock.functions import lerp
from chronolock.functions.lineage import stored as settled
from chronolock.functions.quantiles import HELD
from chronolock.functions.ranking import large_keys, running

KEY = ["neuron_id", "node_id"]
#: Open nodes up to which pointers jump twice a round.
SMALL = 1 << 20


def node_kinds(nodes: DataFrame) -> DataFrame:
    """G1: children of each node, and whether it is a root, a tip or a branch point."""
    return _kinds(nodes).drop("children")


def _kinds(nodes: DataFrame) -> DataFrame:
    """:func:`node_kinds`, and ``children``, the exclusive or of their ids: that of the children known but one
    taken away, it is the id of that one."""
    n = nodes.groupBy("neuron_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"), F.bit_xor("node_id").alias("children"))
    out = nodes.join(n, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return out.withColumn("is_root", F.col("parent_id") < 0).withColumn("is_tip", F.col("n_children") == 0).withColumn("is_branch", F.col("n_children") > 1)


def edges(nodes: DataFrame) -> DataFrame:
    """Each node with its parent's place and the length of the edge to it."""
    up = nodes.select("neuron_id", F.col("node_id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    e = nodes.join(up, ["neuron_id", "parent_id"])
    return e.withColumn("length", _distance())


def _distance() -> Column:
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    return F.sqrt(sq("x", "px") + sq("y", "py") + sq("z", "pz"))


def cable(nodes: DataFrame) -> DataFrame:
    """Per neuron: nodes, cable length, mean and longest edge, bounding box."""
    e = edges(nodes).groupBy("neuron_id").agg(F.sum("length").alias("cable_um"), F.avg("length").alias("mean_edge_um"), F.max("length").alias("max_edge_um"))
    box = nodes.groupBy("neuron_id").agg(F.count("*").alias("n_nodes"), *[(F.max(c) - F.min(c)).alias(f"span_{c}") for c in "xyz"])
    return box.join(e, "neuron_id", "left")


def to_root(nodes: DataFrame, weight: DataFrame, stop: DataFrame | None = None, sums: Mapping[str, str] = {"w": "total"}) -> DataFrame:
    """``top`` (the root, or the first node of ``stop`` above it), ``total`` (weights of the steps,
    from ``weight(neuron_id, node_id, w)``; other columns and their ``sums`` may be named, one walk for all) and
    ``steps`` of each node.  Raises where pointers form a cycle."""
    w = weight.select(*KEY, *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])
    halts = nodes.where("parent_id < 0").select(*KEY) if stop is None else stop.select(*KEY)
    halts = halts.distinct().withColumn("halt", F.lit(True))
    at = nodes.select(*KEY, "parent_id").join(w, KEY, "left")
    up = halts.select("neuron_id", F.col("node_id").alias("anc"), F.col("halt").alias("done"))
    now = at.withColumn("anc", F.when(F.col("parent_id") < 0, F.col("node_id")).otherwise(F.col("parent_id"))).withColumns({t: F.when(F.col("parent_id") < 0, 0).otherwise(F.coalesce(c, F.lit(0))) for c, t in sums.items()}).withColumn("steps", (F.col("parent_id") >= 0).cast("bigint"))
    now = settled(now.join(up, ["neuron_id", "anc"], "left").select("neuron_id", "node_id", "anc", *sums.values(), "steps", (F.coalesce("done", F.lit(False)) | (F.col("anc") == F.col("node_id"))).alias("done")))
    nodes_most = now.groupBy("neuron_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    added = [*sums.values(), "steps"]
    for _ in range(doubling_rounds(nodes_most) + 2):  # two more than the deepest tree needs
        if now.where("not done").isEmpty():
            return now.select(*KEY, F.col("anc").alias("top"), *added)
        skip = now.select("neuron_id", F.col("node_id").alias("anc"), F.col("anc").alias("anc2"), *[F.col(c).alias(f"{c}2") for c in added], F.col("done").alias("done2"))
        moved = now.where("not done").join(skip, ["neuron_id", "anc"]).select("neuron_id", "node_id", F.col("anc2").alias("anc"), *[(F.col(c) + F.col(f"{c}2")).alias(c) for c in added], F.col("done2").alias("done"))
        now = settled(now.where("done").unionByName(moved))
    raise ValueError("the parents of some nodes form a cycle")


def path_lengths(nodes: DataFrame) -> DataFrame:
    """Distance along the tree from each node to its root."""
    return to_root(nodes, edges(nodes).select(*KEY, F.col("length").alias("w"))).select(*KEY, F.col("top").alias("root"), F.col("total").alias("path_um"), "steps")


def branch_orders(nodes: DataFrame) -> DataFrame:
    """Branch points among the nodes above each node, in every root's tree."""
    kinds = node_kinds(nodes)
    above = nodes.join(kinds.select("neuron_id", F.col("node_id").alias("parent_id"), F.col("is_branch").cast("double").alias("w")), ["neuron_id", "parent_id"], "left")
    return to_root(nodes, above.select(*KEY, "w")).select(*KEY, F.col("total").cast("bigint").alias("branch_order"))


def _through(m: Column, a: Column, x: Column) -> Column:
    """The order of a node whose one open child has order ``x``: ``x`` over ``m``, else one more than ``m`` from
    ``a`` on, else ``m``."""
    return F.when(x > m, x).when(x >= a, m + 1).otherwise(m)


def _contracted(now: DataFrame, jumps: int) -> DataFrame:
    """One round of :func:`strahler`: known orders go to the parents that wait for several children; a node that
    waits for one takes its order if it is known, and else points where that child points, the dependences
    (:func:`_through`) composed, ``jumps`` times.  What was known before is left out: nobody points there any
    more."""
    columns = now.columns
    known, open_ = F.col("strahler").isNotNull(), F.col("strahler").isNull()
    fresh = now.where(known)
    same = fresh.where("parent_id >= 0").groupBy("neuron_id", F.col("parent_id").alias("node_id"), "strahler").agg(F.count("*").alias("n"), F.bit_xor("node_id").alias("x"))
    kids = same.groupBy(*KEY).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.max("strahler").alias("best"), F.max_by("n", "strahler").alias("most"))
    met = now.where(open_ & (F.col("waits") > 1)).drop("strahler").join(kids, KEY, "left")
    waits = F.col("waits") - F.coalesce("n", F.lit(0))
    low = F.col("best").isNull() | (F.col("best") < F.col("m"))
    a = F.when(low, F.col("a")).when((F.col("best") == F.col("m")) | (F.col("most") > 1), 0).otherwise(F.col("best"))
    met = met.select(*KEY, "parent_id", waits.alias("waits"), F.col("child").bitwiseXOR(F.coalesce("x", F.lit(0))).alias("child"), F.greatest("m", "best").alias("m"), a.alias("a"))
    met = met.withColumn("strahler", F.when(F.col("waits") == 0, F.col("m") + (F.col("a") == 0).cast("int"))).select(*columns)
    chain = now.where(open_ & (F.col("waits") == 1)).unionByName(met.where(open_ & (F.col("waits") == 1)))
    there = fresh.unionByName(met.where(known)).select("neuron_id", F.col("node_id").alias("child"), F.col("strahler").alias("order"))
    chain = chain.drop("strahler").join(there, ["neuron_id", "child"], "left").withColumn("strahler", F.when(F.col("order").isNotNull(), _through(F.col("m"), F.col("a"), F.col("order")))).select(*columns)
    for _ in range(jumps):
        chain = _jumped(chain).select(*columns)
    return met.where(known | (F.col("waits") > 1)).unionByName(chain)


def _jumped(chain: DataFrame) -> DataFrame:
    """Nodes that wait for one child, each pointing where what it points to does."""
    there = chain.select("neuron_id", F.col("node_id").alias("child"), F.col("strahler").alias("order"), F.col("child").alias("next"), F.col("m").alias("m1"), F.col("a").alias("a1"))
    ahead = chain.join(there, ["neuron_id", "child"], "left")
    m, a, m1, a1 = (F.col(c) for c in ("m", "a", "m1", "a1"))
    both = F.when(m1 > m, a1).when(a <= m1, 0).when((m1 == m) | (a == m1 + 1), a1).otherwise(a)
    order = F.coalesce("strahler", F.when(F.col("order").isNotNull(), _through(m, a, F.col("order"))))
    return ahead.select(*KEY, "parent_id", "waits", F.coalesce("next", "child").alias("child"), F.greatest(m, m1).alias("m"), F.when(m1.isNull(), a).otherwise(both).alias("a"), order.alias("strahler"))


def strahler(nodes: DataFrame) -> DataFrame:
    """Strahler order: 1 at tips; else the largest of the children's, and one more if two have it.

    Trees are contracted, all neurons together: tips are raked off and chains halved in each round, so
    rounds grow with the logarithm of the nodes, however high a tree is; a node whose order is known leaves
    the next rounds.  A node's dependence on the one child it waits for is two numbers.  Raises where
    parents form a cycle."""
    return _orders(_kinds(nodes), nodes.schema["node_id"].dataType)


def _orders(kinds: DataFrame, kind: DataType) -> DataFrame:
    own = kinds.select("neuron_id", F.col("node_id").cast("bigint").alias("node_id"), F.col("parent_id").cast("bigint").alias("parent_id"), F.col("n_children").alias("waits"), F.coalesce("children", F.lit(0)).cast("bigint").alias("child"))
    now = settled(own.select("*", F.lit(0).alias("m"), F.lit(1).alias("a"), F.when(F.col("waits") == 0, 1).alias("strahler")))
    done = []
    while True:
        n = now.agg(F.count_if(F.col("strahler").isNull()).alias("open"), F.count("strahler").alias("known")).first()
        done.append(now.where("strahler is not null").select("neuron_id", F.col("node_id").cast(kind).alias("node_id"), "strahler"))
        if not n.open:
            return reduce(DataFrame.unionByName, done)
        if not n.known:  # in a tree each round finds the order of a node whose children are known
            raise ValueError("the parents of some nodes form a cycle")
        now = settled(_contracted(now, 1 if n.open > SMALL else 2))


def annotated(nodes: DataFrame) -> DataFrame:
    """Every node with its kind, distance to the root, branch order and Strahler order."""
    nodes = settled(nodes)
    kinds = settled(_kinds(nodes))
    up = kinds.select("neuron_id", F.col("node_id").alias("parent_id"), F.col("is_branch").cast("bigint").alias("branches"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    step = kinds.join(up, ["neuron_id", "parent_id"]).select(*KEY, _distance().alias("w"), "branches")
    walk = to_root(nodes, step, sums={"w": "path_um", "branches": "branch_order"}).drop("top")
    return kinds.drop("children").join(walk, KEY, "left").join(_orders(kinds, nodes.schema["node_id"].dataType), KEY, "left")


def segments(nodes: DataFrame) -> DataFrame:
    """Unbranched stretches between roots, branch points and tips: their ends, nodes and length."""
    kinds = node_kinds(nodes)
    ends = kinds.where("is_root or is_branch or is_tip").select(*KEY)
    walk = to_root(nodes, edges(nodes).select(*KEY, F.col("length").alias("w")), ends)
    bottoms = walk.join(ends, KEY, "left_semi").where("steps > 0")
    return bottoms.select("neuron_id", F.col("top").alias("start_id"), F.col("node_id").alias("end_id"), (F.col("steps") + 1).alias("n_nodes"), F.col("total").alias("length_um"))


def basic_metrics(nodes: DataFrame) -> DataFrame:
    """One row a neuron: cable, tips, branch points, largest path and orders."""
    k = node_kinds(nodes).groupBy("neuron_id").agg(F.count_if("is_tip").alias("n_tips"), F.count_if("is_branch").alias("n_branch_points"), F.count_if("is_root").alias("n_roots"))
    p = path_lengths(nodes).groupBy("neuron_id").agg(F.max("path_um").alias("max_path_um"))
    o = branch_orders(nodes).groupBy("neuron_id").agg(F.max("branch_order").alias("max_branch_order"))
    return cable(nodes).join(k, "neuron_id").join(p, "neuron_id").join(o, "neuron_id")


def sholl(nodes: DataFrame, step: float = 5.0, held: int = HELD) -> DataFrame:
    """Crossings of spheres round the root at multiples of ``step``, zeros included.  An edge adds one at the
    first radius it crosses and takes it away after the last; crossings are the running sums, so a long edge costs
    no more than a short one.  Neurons of more than ``held`` radii are added up over all tasks."""
    root = nodes.where("parent_id < 0").groupBy("neuron_id").agg(*[F.min_by(c, "node_id").alias(f"r{c}") for c in "xyz"])
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    e = edges(nodes).join(root, "neuron_id")
    d = e.withColumn("a", F.sqrt(sq("x", "rx") + sq("y", "ry") + sq("z", "rz"))).withColumn("b", F.sqrt(sq("px", "rx") + sq("py", "ry") + sq("pz", "rz")))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    ends = F.array(F.struct(F.ceil(low / step).alias("n"), F.lit(1).alias("d")), F.struct(F.ceil(high / step).alias("n"), F.lit(-1).alias("d")))
    turns = d.select("neuron_id", F.explode(ends).alias("e")).where("e.n is not null").groupBy("neuron_id", "e.n").agg(F.sum("e.d").alias("d"))
    turns = settled(turns)
    far = turns.groupBy("neuron_id").agg(F.max("n").alias("last"))
    grid = far.select("neuron_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("n"), F.lit(0).cast("bigint").alias("d"))
    at = turns.unionByName(grid).groupBy("neuron_id", "n").agg(F.sum("d").alias("d"))
    at = running(at, ["neuron_id"], "n", "d", held and large_keys(at, ["neuron_id"], "n", held))
    return at.select("neuron_id", (F.col("n") * F.lit(float(step))).alias("radius"), (F.col("below") + F.col("d")).alias("crossings"))


def compare(own: DataFrame, measured: DataFrame, names: list[str]) -> DataFrame:
    """Own metrics, measured ones and their differences."""
    m = measured.select("neuron_id", *[F.col(c).alias(f"measured_{c}") for c in names])
    return own.select("neuron_id", *names).join(m, "neuron_id").withColumns({f"delta_{c}": F.col(c) - F.col(f"measured_{c}") for c in names})


def average_curves(curves: DataFrame, step: float, last: float) -> DataFrame:
    """Curves (radius, inters) along lines onto a grid, within their range; mean, median, standard
    error and number by class and grid radius.  A repeated radius counts once."""
    once = curves.groupBy("neuron_id", "cell_class", "radius").agg(F.min("inters").alias("inters"))
    order = W.partitionBy("neuron_id").orderBy("radius")
    line = once.withColumn("r1", F.lead("radius").over(order)).withColumn("y1", F.lead("inters").over(order)).withColumn("final", F.lead("radius").over(order).isNull())
    n0 = F.ceil(F.col("radius") / step)
    n1 = F.when(F.col("final"), F.floor(F.col("radius") / step)).otherwise(F.ceil(F.col("r1") / step) - 1)
    at = line.withColumn("n0", n0).withColumn("n1", F.least(n1, F.lit(int(last / step)).cast("bigint"))).where("n1 >= n0").withColumn("n", F.explode(F.sequence("n0", "n1"))).withColumn("g", F.col("n") * F.lit(float(step)))
    v = at.withColumn("v", F.when(F.col("final"), F.col("inters").cast("double")).otherwise(lerp(F.col("g"), F.col("radius"), F.col("inters"), F.col("r1"), F.col("y1"))))
    return v.groupBy("cell_class", F.col("g").alias("radius")).agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("sem"), F.count("v").alias("n"))


def class_comparison(metrics: DataFrame, value: str) -> DataFrame:
    """Mean and deviation of a metric by class."""
    return metrics.groupBy("cell_class").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def smooth_lines(points: DataFrame, keys: list[str], times: int = 20, half: int = 2) -> DataFrame:
    """Lines of points (``i, x, y``) with ``times`` steps between points, then a moving mean whose
    window repeats the ends; the first and last point stay."""
    order = W.partitionBy(*keys).orderBy("i")
    nxt = points.withColumn("x1", F.lead("x").over(order)).withColumn("y1", F.lead("y").over(order))
    steps = F.when(F.col("x1").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(times - 1)))
    fine = nxt.withColumn("s", F.explode(steps))

    def between(a: str, b: str) -> Column:
        return F.col(a) + (F.coalesce(F.col(b), F.col(a)) - F.col(a)) * F.col("s") / times

    fine = fine.select(*keys, (F.col("i") * times + F.col("s")).alias("j"), between("x", "x1").alias("x"), between("y", "y1").alias("y"))
    span = W.partitionBy(*keys).orderBy("j")
    whole = span.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    fine = fine.withColumn("_f", F.row_number().over(span)).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    out = {}
    for c in ("x", "y"):
        first, last = F.first(c).over(whole), F.last(c).over(whole)
        terms = [F.col(c)] + [F.coalesce(F.lag(c, d).over(span), first) for d in range(1, half + 1)] + [F.coalesce(F.lead(c, d).over(span), last) for d in range(1, half + 1)]
        mean = sum(terms[1:], terms[0]) / len(terms)
        out[f"s{c}"] = F.when((F.col("_f") == 1) | (F.col("_f") == F.col("_n")), F.col(c)).otherwise(mean)
    return fine.withColumns(out).drop("_f", "_n")


def doubling_rounds(depth: int) -> int:
    """Joins that a walk of ``depth`` steps takes."""
    return max(1, math.ceil(math.log2(max(2, depth))))
