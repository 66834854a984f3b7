"""Peaks of long series: plateaus, distance, prominence and width, block by block."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronolock.functions import lerp
from chronolock.functions.blocks import BLOCK, Block, by_blocks
from chronolock.functions.lineage import settled, stored

UNDECIDED, KEPT, GONE = range(3)


def maxima(signal: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Runs of equal values above the values on both sides: ``i`` (the middle, the earlier of two),
    ``v``, ``left`` and ``right`` end.  A run at an end of the series or beside a null is none."""
    order = W.partitionBy(*keys).orderBy("i")
    before = signal.select(*keys, F.col("i").cast("long").alias("i"), F.col(value).alias("v")).withColumn("_b", F.lag("v").over(order)).withColumn("_first", F.row_number().over(order) == 1)
    runs = before.where(F.col("_first") | ~F.col("v").eqNullSafe(F.col("_b")))
    runs = runs.withColumn("_a", F.lead("v").over(order)).withColumn("right", F.lead("i").over(order) - 1)
    top = runs.where(~F.col("_first") & (F.col("v") > F.col("_b")) & (F.col("v") > F.col("_a")))
    return top.select(*keys, F.floor((F.col("i") + F.col("right")) / 2).alias("i"), "v", F.col("i").alias("left"), "right")


def _suppressed(b: Block, distance: int) -> np.ndarray:
    """What a block can tell of its peaks, from the highest down: a peak goes if a higher one that stays is
    nearer than ``distance``, and stays if all higher ones that near have gone."""
    at, v, state = (b.column(c) for c in ("i", "v", "state"))
    state, doubt = state.astype(int), np.zeros(len(at), bool)
    low, high = np.searchsorted(at, at - distance, side="right"), np.searchsorted(at, at + distance)
    for p in np.lexsort((at, v))[::-1]:
        near = slice(low[p], high[p])
        own = b.own[0] <= p < b.own[1]
        if state[p] == UNDECIDED and own and not doubt[p]:
            state[p] = KEPT
        if state[p] == KEPT:
            state[near][state[near] == UNDECIDED] = GONE
        elif state[p] == UNDECIDED:
            doubt[near] = True
    return state[slice(*b.own)].astype(float)


def apart(peaks: DataFrame, keys: Sequence[str], distance: int, block: int = BLOCK) -> DataFrame:
    """The peaks that stay if from the highest down (the later of equal ones first) each removes those nearer
    than ``distance``.

    Rounds over blocks: each decides what its own peaks and the near ones beyond its borders allow, until all
    are decided; most need one or two, a chain of rising peaks one for each border it crosses."""
    now = settled(peaks.withColumn("state", F.lit(UNDECIDED).cast("bigint")))
    while now.where(F.col("state") == UNDECIDED).limit(1).count():
        decided = by_blocks(now, keys, distance, {"_state": "bigint"}, lambda b: [_suppressed(b, distance)], block=block)
        now = settled(decided.drop("state").withColumnRenamed("_state", "state"))
    return now.where(F.col("state") == KEPT).drop("state")


def nearest(samples: DataFrame, queries: DataFrame, keys: Sequence[str], left: bool = True, above: bool = True, block: int = BLOCK) -> DataFrame:
    """For each query (``keys``, place ``i``, ``level``): ``at`` and ``found``, the nearest sample before it
    (``left``, else behind it) whose value is over ``level`` (``above``, else not over it), and ``low``, the
    least value in between; ``at`` is null where there is none.

    A block answers from its own samples.  What is left asks the extremes of other blocks, whose tables over
    2, 4, 8, ... blocks are joined from the widest down, so a query takes as many joins as the logarithm of
    the blocks; and then the one block that has the answer."""
    keys = list(keys)
    sign = 1 if left else -1
    own = samples.where("v is not null").select(*keys, (F.col("i").cast("long") * sign).alias("_p"), F.col("v").cast("double").alias("v"))
    own = own.withColumn("_block", F.floor(F.col("_p") / block))
    asked = queries.withColumn("_p", F.col("i").cast("long") * sign).withColumn("_block", F.floor(F.col("_p") / block)).withColumn("low", F.lit(None).cast("double"))
    fields = StructType([*asked.schema.fields, *StructType.fromDDL("at bigint, found double").fields])
    names = [f.name for f in fields]

    def answer(table: pa.Table) -> pa.Table:
        mine = table.filter(table.column("_sample"))
        q = table.filter(pa.compute.invert(table.column("_sample")))
        p, v = (mine.column(c).to_numpy() for c in ("_p", "v"))
        order = np.argsort(p)
        p, v = p[order], v[order]
        place, level = q.column("_p").to_numpy(), q.column("level").to_numpy()
        low = q.column("low").to_numpy(zero_copy_only=False).astype(float)
        at, found = np.full(len(place), -1), np.full(len(place), np.nan)
        hi = np.searchsorted(p, place)
        for k in range(len(place)):
            start, step = hi[k], 64
            while start > 0:  # backwards in growing steps
                first = max(0, start - step)
                hit = np.flatnonzero(v[first:start] > level[k] if above else v[first:start] <= level[k])
                if len(hit):
                    at[k] = first + hit[-1]
                    break
                start, step = first, 2 * step
            between = v[at[k] + 1 : hi[k]]
            if len(between):
                low[k] = np.fmin(low[k], between.min())
            if at[k] >= 0:
                found[k] = v[at[k]]
        where = p[at] * sign if len(p) else at
        new = [pa.array(where, pa.int64(), mask=at < 0), pa.array(found, mask=at < 0)]
        q = q.set_column(q.schema.get_field_index("low"), "low", pa.array(low, mask=np.isnan(low)))
        return q.append_column("at", new[0]).append_column("found", new[1]).select(names)

    def ask(open_: DataFrame) -> DataFrame:
        """Queries against the samples of their block."""
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in asked.schema if f.name not in (*keys, "_p", "_block")]
        there = own.join(open_.select(*keys, "_block").distinct(), [*keys, "_block"], "left_semi")
        rows = there.select(*keys, "_p", "_block", *blank, "v").withColumn("_sample", F.lit(True))
        both = rows.unionByName(open_.select(*asked.columns).withColumn("v", F.lit(None).cast("double")).withColumn("_sample", F.lit(False)))
        return both.groupBy(*keys, "_block").applyInArrow(answer, fields)

    if "v" in queries.columns:
        raise ValueError("nearest: queries must not have a column v")
    first = settled(ask(asked))
    summary = own.groupBy(*keys, F.col("_block").alias("_b")).agg((F.max("v") if above else -F.min("v")).alias("_far"), F.min("v").alias("_least"))
    lows = F.min("_b").over(W.partitionBy(*keys))
    tables = [settled(summary.withColumn("_first", lows))]
    open_ = first.where("at is null").drop("at", "found").withColumn("_block", F.col("_block") - 1)
    span = tables[0].agg(F.max(F.col("_b") - F.col("_first"))).first()[0] or 0
    while 1 << (len(tables) - 1) < span:
        width = 1 << (len(tables) - 1)
        last = tables[-1]
        other = last.select(*keys, (F.col("_b") + width).alias("_b"), F.col("_far").alias("_f2"), F.col("_least").alias("_l2"))
        tables.append(settled(last.join(other, [*keys, "_b"], "left").select(*keys, "_b", F.greatest("_far", "_f2").alias("_far"), F.least("_least", "_l2").alias("_least"), "_first")))
    if not span or not open_.limit(1).count():
        return first.drop("_p", "_block")
    for k in range(len(tables) - 1, -1, -1):
        there = tables[k].withColumnRenamed("_b", "_block")
        met = open_.join(there, [*keys, "_block"], "left")
        # blocks without samples, and stretches without an answer, are passed
        none = F.col("_far").isNull() | ((F.col("_far") <= F.col("level")) if above else (F.col("_far") < -F.col("level")))
        open_ = met.withColumn("low", F.when(none, F.least("low", "_least")).otherwise(F.col("low"))).withColumn("_block", F.when(none, F.col("_block") - (1 << k)).otherwise(F.col("_block"))).select(*asked.columns)
    rest = ask(settled(open_))
    return first.where("at is not null").unionByName(rest).drop("_p", "_block")


def _extremes(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The largest and the least of 1, 2, 4, ... values from each place on."""
    out = [(x, x)]
    while len(out[-1][0]) > 1 << (len(out) - 1):
        width, (high, low) = 1 << (len(out) - 1), out[-1]
        out.append((np.maximum(high[:-width], high[width:]), np.minimum(low[:-width], low[width:])))
    return out


def _passed(tables: list[tuple[np.ndarray, np.ndarray]], end: np.ndarray, level: np.ndarray, above: bool) -> tuple[np.ndarray, np.ndarray]:
    """From ``end`` (excluded) back over all values that are not over ``level`` (``above``, else that are): the
    first of these, and the least."""
    at, least = end, np.full(len(end), np.nan)
    for k in range(len(tables) - 1, -1, -1):
        start = at - (1 << k)
        high, low = (t[np.maximum(start, 0)] for t in tables[k])
        ok = (start >= 0) & ((high <= level) if above else (low > level))
        at, least = np.where(ok, start, at), np.where(ok, np.fmin(least, low), least)
    return at, least


def _measured(b: Block, share: float) -> list[np.ndarray]:
    """Prominence and width of the peaks (rows with a ``level``) of a block by its samples, and whether these
    tell all: on either side there is a higher one, or the series ends (``_first``, ``_last``)."""
    place, v, level = (b.column(c) for c in ("i", "v", "level"))
    mine, asked = ~np.isnan(v), ~np.isnan(level)
    out = [np.full(len(place), np.nan) for _ in range(3)]
    if not mine.any() or not asked.any():
        return out
    p, x, q, top = place[mine], v[mine], place[asked], level[asked]
    sides = [(_extremes(x), np.searchsorted(p, q), p[0] <= b.column("_first")[asked]), (_extremes(x[::-1]), len(p) - np.searchsorted(p, q, side="right"), p[-1] >= b.column("_last")[asked])]
    done, lows, ends = np.ones(len(q), bool), [], []
    for tables, end, last in sides:
        at, least = _passed(tables, end, top, True)
        done &= (at > 0) | last
        lows.append(least)
    prominence = top - np.fmax(*lows)
    half = top - share * prominence
    for step, (tables, end, last) in zip((1, -1), sides):
        at = _passed(tables, end, half, False)[0] - 1
        done &= (at >= 0) | last
        at_ = at if step > 0 else len(p) - 1 - at
        there = (at >= 0) & ~np.isnan(half)
        at_ = np.where(there, at_, 0)
        x0, y0, n = p[at_], x[at_], p[at_] + step
        near = np.minimum(np.searchsorted(p, n), len(p) - 1)
        y1 = np.where(p[near] == n, x[near], np.nan)
        with np.errstate(invalid="ignore", divide="ignore"):
            line = np.where(y1 == y0, x0, x0 + (half - y0) * (n - x0) / (y1 - y0))
        ends.append(np.where(there, np.where(y0 < half, line, x0), np.nan))
    for o, c in zip(out, (prominence, ends[1] - ends[0], done.astype(float))):
        o[asked] = c
    return out


def peaks(signal: DataFrame, keys: Sequence[str], height: float | None = None, distance: int | None = None, width: float | None = None, share: float = 0.5, value: str = "v", block: int = BLOCK) -> DataFrame:
    """Peaks (:func:`maxima`) of at least ``height``, thinned to ``distance`` (:func:`apart`), and, where
    ``width`` is given, at least that wide: also ``prominence`` and ``width``.

    The prominence is the height over the higher of the two lowest values between a peak and the nearest
    higher sample, or the end, on either side.  The width is that of the stretch above ``share`` of the
    prominence below the peak, its ends on the lines between samples.  A series of any length spreads over
    blocks; nulls count as no samples.  Samples are stored once and meet the peaks of their block; only peaks
    that a block can't tell all about ask other blocks (:func:`nearest`)."""
    keys = list(keys)
    if width is not None:
        signal, value = stored(signal.select(*keys, "i", F.col(value).alias("v"))), "v"
    found = maxima(signal, keys, value)
    if height is not None:
        found = found.where(F.col("v") >= height)
    if distance is not None and distance > 1:
        found = apart(found, keys, distance, block)
    if width is None:
        return found
    named = [F.col(k).alias(f"_{k}") for k in keys]
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    span = signal.where("v is not null").groupBy(*named).agg(F.min("i").cast("long").alias("_first"), F.max("i").cast("long").alias("_last"))
    found = found.withColumnRenamed("v", "level").withColumnRenamed("left", "from").withColumnRenamed("right", "to").join(span, on).drop(*[f"_{k}" for k in keys])
    rows = signal.select(*keys, F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v")).where("v is not null").unionByName(found, allowMissingColumns=True)
    told = stored(by_blocks(rows, keys, 0, {"prominence": "double", "width": "double", "_done": "bigint"}, lambda b: [c[slice(*b.own)] for c in _measured(b, share)], block=block, only="level"))
    columns = [*keys, "i", F.col("level").alias("v"), F.col("from").alias("left"), F.col("to").alias("right"), "prominence", "width"]
    wide = told.where((F.col("_done") == 1) & (F.col("width") >= width)).select(*columns)
    rest = told.where("_done = 0 or _done is null").select(*keys, "i", "level", "from", "to")
    return wide.unionByName(_by_other_blocks(signal, rest, keys, width, share, block)) if rest.limit(1).count() else wide


def _by_other_blocks(samples: DataFrame, held: DataFrame, keys: list[str], width: float, share: float, block: int) -> DataFrame:
    """Prominence and width of the peaks ``held`` (``i``, ``level``, ``from``, ``to``), wherever their answers lie."""
    one = nearest(samples, held, keys, left=True, above=True, block=block).withColumnRenamed("low", "_low").drop("at", "found")
    two = nearest(samples, one, keys, left=False, above=True, block=block).drop("at", "found")
    two = two.withColumn("prominence", F.col("level") - F.greatest("_low", "low")).drop("_low", "low").withColumnRenamed("level", "_v")
    ends = two.withColumn("level", F.col("_v") - share * F.col("prominence"))
    for side in ("left", "right"):
        met = nearest(samples, ends, keys, left=side == "left", above=False, block=block).withColumnRenamed("at", "_at").withColumnRenamed("found", "_y").drop("low")
        inner = samples.select(*keys, F.col("i").cast("long").alias("_n"), F.col("v").alias("_w"))
        met = met.withColumn("_n", F.col("_at") + (1 if side == "left" else -1)).join(inner, [*keys, "_n"], "left")
        ends = met.withColumn(side, F.when(F.col("_y") < F.col("level"), lerp(F.col("level"), F.col("_y"), F.col("_at").cast("double"), F.col("_w"), F.col("_n").cast("double"))).otherwise(F.col("_at").cast("double"))).drop("_at", "_y", "_n", "_w")
    wide = ends.withColumn("width", F.col("right") - F.col("left")).where(F.col("width") >= width)
    return wide.select(*keys, "i", F.col("_v").alias("v"), F.col("from").alias("left"), F.col("to").alias("right"), "prominence", "width")
