"""Joins in time: windows of samples round events, containment, as-of and warping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolock.functions import lerp


#: Samples of a piece of a trace, at least: pieces of a window's length or more, so that a window meets two at most.
PIECE = 128
#: Samples of a piece that windows are cut from whole.
WHOLE = 1024


def centers(events: DataFrame, rate: float, start: float = 0.0, time: str = "t") -> DataFrame:
    """The sample of each event: its time since ``start`` by the rate, halves to even."""
    return events.withColumn("c", F.rint((F.col(time) - F.lit(float(start))) * F.lit(float(rate))).cast("int"))


def event_windows(traces: DataFrame, events: DataFrame, pre: int, post: int, keys: tuple[str, ...] = ("session_id",), roi: tuple[str, ...] = ("roi",), keep: tuple[str, ...] = ()) -> DataFrame:
    """Samples ``c - pre`` up to ``c + post`` (exclusive) of every trace round each event, as
    ``k`` from 0.  A window that leaves a trace is dropped for it.

    The window is a span of :func:`spans_cut`.
    """
    spans = events.withColumn("_from", F.col("c") - pre).withColumn("_to", F.col("c") + post - 1).drop("c")
    return spans_cut(traces, spans, keys, roi, keep, max(PIECE, pre + post))


def spans_cut(traces: DataFrame, spans: DataFrame, keys: Sequence[str], roi: Sequence[str], keep: Sequence[str] = (), size: int = PIECE) -> DataFrame:
    """Samples of every trace of a span's key from ``_from`` to ``_to``, both included, as ``k`` from 0; none where
    the span leaves the trace.

    Traces are held in pieces of ``size``, a row each.  Spans meet the traces that have samples in the piece
    where they start, so the work grows with the windows there are and not with spans times traces; then they
    meet the pieces they lie in and are cut from them: samples move once, in pieces, and of a window only
    its place."""
    pieces = held(traces, keys, roi, size, keep)
    reach = _reached(pieces.groupBy(*keys, *roi).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high")), size)
    own = [c for c in spans.columns if c not in (*keys, "_from", "_to")]
    starts = spans.withColumn("_piece", F.floor(F.col("_from") / size))
    fits = starts.join(reach, [*keys, "_piece"]).where((F.col("_from") >= F.col("_low")) & (F.col("_to") <= F.col("_high"))).drop("_low", "_high")
    placed = fits.withColumn("_piece", F.explode(F.sequence("_piece", F.floor(F.col("_to") / size))))
    low, high = F.greatest("_from", "_low"), F.least("_to", "_high")
    sliced = F.slice("_samples", (low - F.col("_low") + 1).cast("int"), F.greatest(high - low + 1, F.lit(0)).cast("int"))
    # a piece with gaps, or a sample twice, is looked through
    cut = F.when(F.col("_plain"), sliced).otherwise(F.filter("_samples", lambda s: s["i"].between(F.col("_from"), F.col("_to"))))
    met = placed.join(pieces, [*keys, *roi, "_piece"]).select(*keys, *roi, *own, "_from", F.inline(cut))
    return met.select(*keys, *roi, "i", *keep, "v", *own, (F.col("i") - F.col("_from")).cast("int").alias("k"))


def held(traces: DataFrame, keys: Sequence[str], roi: Sequence[str], size: int, keep: Sequence[str] = (), halo: int = 0) -> DataFrame:
    """Traces in pieces of ``size`` samples and the ``halo`` next ones, a row each: ``_piece, _samples``, the first and
    last place, and whether each place between is there once.

    What has no key, trace or place goes here already: otherwise joins leave it out by filters of their own, and what reads
    pieces twice makes them twice."""
    traces = traces.where(reduce(and_, (F.col(c).isNotNull() for c in (*keys, *roi, "i"))))
    piece = F.floor(F.col("i") / size)
    if halo:
        piece = F.explode(F.when(F.pmod(F.col("i"), F.lit(size)) < halo, F.array(piece, piece - 1)).otherwise(F.array(piece)))
    pieces = traces.select(*keys, *roi, piece.alias("_piece"), F.struct("i", *keep, "v").alias("_s")).where("_piece is not null").groupBy(*keys, *roi, "_piece").agg(F.sort_array(F.collect_list("_s")).alias("_samples"))
    pieces = pieces.withColumn("_low", F.get("_samples", F.lit(0))["i"]).withColumn("_high", F.element_at("_samples", -1)["i"])
    places = F.array_distinct(F.transform("_samples", lambda s: s["i"]))
    return pieces.withColumn("_plain", (F.size(places) == F.size("_samples")) & (F.col("_high") - F.col("_low") + 1 == F.size("_samples")))


def _reached(reach: DataFrame, size: int) -> DataFrame:
    """A row for each piece that a trace reaches over."""
    return reach.withColumn("_piece", F.explode(F.sequence(F.floor(F.col("_low") / size), F.floor(F.col("_high") / size))))


def span_places(pieces: DataFrame, spans: DataFrame, keys: Sequence[str], roi: Sequence[str], width: int, size: int = PIECE) -> DataFrame:
    """Spans of ``width`` samples with each trace (:func:`held`) that :func:`spans_cut` cuts a sample of them from, without
    the samples: a span that leaves a trace is not there, nor one that lies in a gap."""
    step = F.transform(F.sequence(F.lit(1), F.size("_samples") - 1), lambda j: F.struct(F.get("_samples", j - 1)["i"].alias("a"), F.get("_samples", j)["i"].alias("b")))
    wide = lambda gaps: F.filter(gaps, lambda g: g["b"] - g["a"] > width)
    none = F.array().cast("array<struct<a:int,b:int>>")
    inner = F.when(F.col("_plain") | (F.size("_samples") < 2), none).otherwise(wide(step).cast("array<struct<a:int,b:int>>"))
    ends = F.array_sort(F.collect_list(F.struct("_low", "_high")))
    reach = pieces.withColumn("_inner", inner).groupBy(*keys, *roi).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), ends.alias("_ends"), F.flatten(F.collect_list("_inner")).alias("_inner"))
    between = F.transform(F.sequence(F.lit(1), F.size("_ends") - 1), lambda j: F.struct(F.get("_ends", j - 1)["_high"].alias("a"), F.get("_ends", j)["_low"].alias("b")))
    gaps = F.when(F.size("_ends") < 2, F.col("_inner")).otherwise(F.concat("_inner", wide(between).cast("array<struct<a:int,b:int>>")))
    reach = _reached(reach.select(*keys, *roi, "_low", "_high", gaps.alias("_gaps")), size)
    met = spans.withColumn("_piece", F.floor(F.col("_from") / size)).join(reach, [*keys, "_piece"])
    inside = (F.col("_from") >= F.col("_low")) & (F.col("_to") <= F.col("_high"))
    hidden = F.exists("_gaps", lambda g: (g["a"] < F.col("_from")) & (g["b"] > F.col("_to")))
    return met.where(inside & ~hidden).drop("_piece", "_low", "_high", "_gaps")


def whole_windows(traces: DataFrame, events: DataFrame, pre: int, post: int, keys: Sequence[str] = ("session_id",), roi: Sequence[str] = ("roi",)) -> DataFrame:
    """The windows of :func:`event_windows`, a row each: ``samples`` has their ``k`` and ``v`` in order.

    A piece has the samples that windows which start in it reach over, so each is cut from one piece, and none has to be
    put together again.  An event has one center."""
    width = pre + post
    size = max(WHOLE, width)
    spans = events.withColumn("_from", F.col("c") - pre).withColumn("_to", F.col("c") + post - 1).drop("c")
    pieces = held(traces, keys, roi, size, halo=width - 1)
    at = span_places(pieces, spans, keys, roi, width).withColumn("_piece", F.floor(F.col("_from") / size))
    low = F.greatest("_from", "_low")
    sliced = F.slice("_samples", (low - F.col("_low") + 1).cast("int"), F.greatest(F.least("_to", "_high") - low + 1, F.lit(0)).cast("int"))
    cut = F.when(F.col("_plain"), sliced).otherwise(F.filter("_samples", lambda s: s["i"].between(F.col("_from"), F.col("_to"))))
    samples = F.transform(cut, lambda s: F.struct((s["i"] - F.col("_from")).cast("int").alias("k"), s["v"].alias("v")))
    own = [c for c in events.columns if c not in (*keys, "c")]
    return at.join(pieces, [*keys, *roi, "_piece"]).select(*keys, *roi, *own, samples.alias("samples"))


def bounds_within(epochs: DataFrame, pre: float = 0.0, post: float = 0.0) -> DataFrame:
    """Epochs shrunk by ``pre`` and ``post``; those that vanish go."""
    shrunk = epochs.select("session_id", (F.col("start_time") + pre).alias("a"), (F.col("end_time") - post).alias("b"))
    return shrunk.where("a < b")


def in_epochs(events: DataFrame, epochs: DataFrame, pre: float = 0.0, post: float = 0.0) -> DataFrame:
    """Events inside any epoch, both ends included."""
    e = bounds_within(epochs, pre, post).withColumnRenamed("session_id", "s")
    return events.join(e, (events["session_id"] == F.col("s")) & (F.col("t") >= F.col("a")) & (F.col("t") <= F.col("b")), "left_semi")


def as_of(left: DataFrame, right: DataFrame, key: str, value: list[str], backward: bool = True) -> DataFrame:
    """To each row of ``left(key, t)`` the latest row of ``right`` at or before it (or, forward, the
    first at or after), by one union and one ordered window."""
    both = left.withColumns({f"_{c}": F.lit(None).cast(right.schema[c].dataType) for c in value} | {"_side": F.lit(1)})
    other = right.select(key, "t", *[F.col(c).alias(f"_{c}") for c in value]).withColumn("_side", F.lit(0 if backward else 2))
    both = both.unionByName(other, allowMissingColumns=True)
    # forward runs from the latest row back: a frame that grows costs one step a row, one that shrinks all that is left
    order = ("t", "_side") if backward else (F.desc("t"), F.desc("_side"))
    span = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = F.struct(*[F.col(f"_{c}").alias(c) for c in value])
    got = both.withColumn("_got", F.last(F.when(F.col("_side") != 1, found), ignorenulls=True).over(span)).where("_side = 1")
    return got.select(*left.columns, *[F.col(f"_got.{c}").alias(f"right_{c}") for c in value])


def lower_bound_centers(events: DataFrame, samples: DataFrame) -> DataFrame:
    """The first sample at or after each event, as ``c``."""
    return as_of(events, samples, "session_id", ["i"], backward=False).withColumnRenamed("right_i", "c")


def piecewise_warp(events: DataFrame, anchors: DataFrame, key: str = "session_id") -> DataFrame:
    """Event times carried from ``src`` to ``dst`` along the line between the anchors round them;
    before the first and after the last anchor along the first and last line."""
    order = W.partitionBy(key).orderBy("src")
    lines = anchors.select(key, "src", "dst", F.lead("src").over(order).alias("src1"), F.lead("dst").over(order).alias("dst1"), F.row_number().over(order).alias("n")).where("src1 is not null")
    first = lines.where("n = 1").select(F.col(key).alias("_key"), F.struct("src", "dst", "src1", "dst1").alias("_first"))
    found = as_of(events, lines.withColumnRenamed("src", "t").withColumn("src", F.col("t")), key, ["src", "dst", "src1", "dst1"])
    found = found.join(first, F.col(key) == F.col("_key"))
    use = {c: F.coalesce(f"right_{c}", F.col(f"_first.{c}")) for c in ("src", "dst", "src1", "dst1")}
    return found.withColumn("warped", lerp(F.col("t"), use["src"], use["dst"], use["src1"], use["dst1"])).select(*events.columns, "warped")


def ordinal_pairs(left: DataFrame, right: DataFrame, shift: int = 0, key: str = "session_id") -> DataFrame:
    """The n-th edge of one train with the (n + shift)-th of the other."""
    order = W.partitionBy(key).orderBy("t")
    a = left.select(key, F.row_number().over(order).alias("n"), F.col("t").alias("src"))
    b = right.select(key, (F.row_number().over(order) - F.lit(shift)).alias("n"), F.col("t").alias("dst"))
    return a.join(b, [key, "n"])


def resample_linear(source: DataFrame, lengths: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A series of m values spread over n samples: sample i reads place i (m - 1) / (n - 1)."""
    m = source.groupBy(*keys).agg(F.count("*").alias("m"))
    grid = lengths.join(m, list(keys)).select(*keys, "m", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "n")
    x = F.when(F.col("n") > 1, F.col("i") * (F.col("m") - 1) / F.when(F.col("n") > 1, F.col("n") - 1)).otherwise(F.lit(0.0))
    grid = grid.select(*keys, "i", x.alias("x"), F.least(F.floor(x), F.col("m") - 1).cast("int").alias("j")).withColumn("j1", F.col("j") + 1)
    low = source.select(*keys, "j", F.col("v").alias("y0"))
    high = source.select(*keys, F.col("j").alias("j1"), F.col("v").alias("y1"))
    both = grid.join(low, [*keys, "j"]).join(high, [*keys, "j1"], "left")
    return both.select(*keys, "i", (F.col("y0") + (F.col("x") - F.col("j")) * (F.coalesce("y1", "y0") - F.col("y0"))).alias("v"))


def session_timeline(trials: DataFrame, rate: float) -> DataFrame:
    """Where each trial starts on its session's timeline; trials without samples take the rounded
    median length of the valid ones."""
    usual = trials.where("valid").groupBy("session_id").agg(F.rint(F.percentile("n_samples", F.lit(0.5))).cast("int").alias("usual"))
    filled = trials.join(usual, "session_id").withColumn("length", F.when(F.col("valid"), F.col("n_samples")).otherwise(F.col("usual")))
    before = W.partitionBy("session_id").orderBy("trial").rowsBetween(W.unboundedPreceding, -1)
    return filled.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumn("start_s", F.col("offset") / F.lit(float(rate))).drop("usual")
