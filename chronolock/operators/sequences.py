"""Windows of image sequences: packages and summaries by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolock.functions import ratio
from chronolock.operators import windows as wn

#: Position that a terminal image gets.
TERMINAL = 999


#: Samples of a piece of a trace that is summed up by position.
PIECE = 1024

STEP = ["session_id", "roi", "category", "position"]


def _positions(there: DataFrame) -> DataFrame:
    """``there`` (``session_id, roi, seq_id, category, position``, a row for each image that has its window) with
    final positions."""
    span = W.partitionBy("session_id", "roi", "seq_id", "category")
    there = there.withColumn("_place", F.dense_rank().over(span.orderBy("position")) - 1).withColumn("_both", F.min("position").over(span) < F.max("position").over(span))
    there = there.where((F.col("category") != "prechange") | F.col("_both"))
    position = F.when(F.col("category") == "terminal", F.lit(TERMINAL)).when(F.col("category") == "repeated", F.col("_place")).otherwise(F.col("position"))
    return there.withColumn("position", position).drop("_place", "_both")


def sequence_windows(windows: DataFrame, sequences: DataFrame) -> DataFrame:
    """Samples of each sequence's images (``session_id, roi, seq_id, category, position, k, v``).
    Before a change both images must be there; repeated images close up where one lacks its window.  Sequences
    meet windows by name only; samples move once."""
    named = windows.select("session_id", "roi", "event_idx").distinct()
    kept = _positions(sequences.join(named, ["session_id", "event_idx"]))
    return kept.select("session_id", "roi", "seq_id", "category", "event_idx", "position").join(windows, ["session_id", "roi", "event_idx"])


def sequence_places(pieces: DataFrame, images: DataFrame, sequences: DataFrame, pre: int, post: int) -> DataFrame:
    """Where the windows of :func:`sequence_windows` lie in their traces (:func:`~chronolock.operators.windows.held`) as
    ``_from, _to``, before any sample is cut; ``images`` has a center ``c`` for each ``event_idx``."""
    spans = images.select("session_id", "event_idx", (F.col("c") - pre).alias("_from"), (F.col("c") + post - 1).alias("_to"))
    spans = sequences.join(spans, ["session_id", "event_idx"]).select("session_id", "seq_id", "category", "position", "_from", "_to")
    return _positions(wn.span_places(pieces, spans, ["session_id"], ["roi"], pre + post))


def sequence_samples(traces: DataFrame, images: DataFrame, sequences: DataFrame, pre: int, post: int) -> DataFrame:
    """:func:`sequence_windows` of windows round ``images``, cut once their positions are known."""
    size = max(wn.PIECE, pre + post)
    at = sequence_places(wn.held(traces, ["session_id"], ["roi"], size), images, sequences, pre, post)
    return wn.spans_cut(traces, at, ["session_id", "roi"], [], size=size)


def sequence_summary(rows: DataFrame) -> DataFrame:
    """A2: mean, population deviation and number of sequences at each position and sample, whatever their
    lengths."""
    return rows.groupBy(*STEP, "k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.countDistinct(F.when(F.col("v").isNotNull(), F.col("seq_id"))).alias("n"))


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where the lists of a column begin and end, and what they hold."""
    return np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())), column.flatten()


def _summed(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that sums up, for each piece of a trace, the windows that start in it: for each category and
    position a row whose ``cells``, one a sample of a window, have the rows, the values, their sum and squares about their
    mean, and the sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (v_at, v), (i_at, i), (w_at, w) = (_lists(b.column(c)) for c in ("_v", "_i", "_plan"))
            v, i = v.to_numpy(zero_copy_only=False).astype(float), i.to_numpy(zero_copy_only=False)
            names = w.field("category").dictionary_encode()
            kind, position, seq, start = names.indices.to_numpy(), *(w.field(c).to_numpy() for c in ("position", "seq_id", "_from"))
            low = b.column("_low").to_numpy()
            row, kinds, positions, cells = [], [], [], []
            for r in range(b.num_rows):
                mine, x = slice(w_at[r], w_at[r + 1]), v[v_at[r] : v_at[r + 1]]
                at = i[i_at[r] : i_at[r + 1]] if i_at[r] < i_at[r + 1] else np.arange(low[r], low[r] + len(x))
                a = start[mine]
                own, g = np.unique(kind[mine].astype(np.int64) << 32 | position[mine], return_inverse=True)
                left, right = np.searchsorted(at, a), np.searchsorted(at, a + width)
                n = right - left
                window = np.repeat(np.arange(len(a)), n)
                found = np.arange(n.sum()) + np.repeat(left - (np.cumsum(n) - n), n)
                cell, x, size = g[window] * width + at[found] - a[window], x[found], len(own) * width
                rows = np.bincount(cell, minlength=size)
                some = ~np.isnan(x)
                if not some.all():
                    cell, x, window = cell[some], x[some], window[some]
                count, total = np.bincount(cell, minlength=size), np.bincount(cell, x, size)
                squares = np.bincount(cell, (x - (total / np.maximum(count, 1))[cell]) ** 2, size)
                # of a sequence each cell has one value, but for samples or images that are there twice
                number = np.unique(seq[mine], return_inverse=True)[1]
                once = len(np.unique(g * len(a) + number)) == len(a) and (at[1:] > at[:-1]).all()
                sequences = count if once else np.bincount(np.unique(cell * len(a) + number[window]) // len(a), minlength=size)
                row += [r] * len(own)
                kinds.append(own >> 32)
                positions.append(own & 0xFFFFFFFF)
                cells.append((rows, count, total, squares, sequences))
            if not row:
                continue
            fields = [pa.array(np.concatenate(c)) for c in zip(*cells)]
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * width, pa.int32()), pa.StructArray.from_arrays([f.cast(pa.float64() if n in ("s", "w") else pa.int64()) for f, n in zip(fields, "cnswq")], list("cnswq")))
            own = [b.column(c).take(pa.array(row)) for c in ("session_id", "roi", "_piece")]
            yield pa.RecordBatch.from_arrays([*own, names.dictionary.take(pa.array(np.concatenate(kinds))), pa.array(np.concatenate(positions), pa.int32()), made], names=["session_id", "roi", "_piece", "category", "position", "cells"])

    return run


def sequence_curves(traces: DataFrame, images: DataFrame, sequences: DataFrame, pre: int, post: int) -> DataFrame:
    """A2: :func:`sequence_summary` of :func:`sequence_samples`, without a row a sample: windows meet the piece of
    the trace that they start in as places, and a piece gives its sums."""
    width = pre + post
    size = max(PIECE, width)
    held = wn.held(traces, ["session_id"], ["roi"], size, halo=width - 1)
    at = sequence_places(held, images, sequences, pre, post)
    plan = at.groupBy("session_id", "roi", F.floor(F.col("_from") / size).alias("_piece")).agg(F.collect_list(F.struct("category", F.col("position").cast("int").alias("position"), "seq_id", "_from")).alias("_plan"))
    held = held.select("session_id", "roi", "_piece", "_low", F.transform("_samples", lambda s: s["v"].cast("double")).alias("_v"), F.when(~F.col("_plain"), F.transform("_samples", lambda s: s["i"])).alias("_i"))
    met = held.join(plan, ["session_id", "roi", "_piece"])
    kind = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in met.select("session_id", "roi", "_piece").schema)
    parts = met.mapInArrow(_summed(width), f"{kind}, category string, position int, cells array<struct<c:bigint,n:bigint,s:double,w:double,q:bigint>>")

    def added(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], ratio(a["s"], a["n"]) - ratio(b["s"], b["n"])
        between = F.coalesce(ratio(apart * apart * a["n"] * b["n"], n), F.lit(0.0))
        return F.struct((a["c"] + b["c"]).alias("c"), n.alias("n"), (a["s"] + b["s"]).alias("s"), (a["w"] + b["w"] + between).alias("w"), (a["q"] + b["q"]).alias("q"))

    whole = parts.groupBy(*STEP).agg(F.array_sort(F.collect_list(F.struct("_piece", "cells"))).alias("p"))
    cells = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.get("p", F.lit(0))["cells"], lambda a, p: F.zip_with(a, p["cells"], added))
    each = whole.select(*STEP, F.posexplode(cells).alias("k", "e")).where("e.c > 0")
    return each.select(*STEP, "k", ratio(F.col("e.s"), F.col("e.n")).alias("mean"), F.sqrt(ratio(F.col("e.w"), F.col("e.n"))).alias("std"), F.col("e.q").alias("n"))


def mean_responses(windows: DataFrame) -> DataFrame:
    """Per stimulus and sample the mean over traces of their mean responses, and its error."""
    own = windows.groupBy("session_id", "roi", "stimulus", "k").agg(F.avg("v").alias("m"))
    return own.groupBy("stimulus", "k").agg(F.avg("m").alias("mean"), (F.stddev_pop("m") / F.sqrt(F.greatest(F.count("m"), F.lit(1)))).alias("sem"), F.count("m").alias("n"))


def session_zero(log: DataFrame, epochs: DataFrame) -> DataFrame:
    """Where a session's time starts: its first epoch, else its first row."""
    first = log.groupBy("session_id").agg(F.min("t").alias("t0"))
    start = epochs.groupBy("session_id").agg(F.min("start_time").alias("e0"))
    return first.join(start, "session_id", "left").select("session_id", F.coalesce("e0", "t0").alias("zero"))


def padded(traces: DataFrame, trial: str) -> DataFrame:
    """Samples of trials one after another, each as long as the session's longest."""
    longest = traces.groupBy("session_id").agg((F.max("i") + 1).alias("_n"))
    order = traces.select("session_id", trial).distinct().withColumn("_o", F.row_number().over(W.partitionBy("session_id").orderBy(trial)) - 1)
    return traces.join(longest, "session_id").join(order, ["session_id", trial]).withColumn("session_i", F.col("_o") * F.col("_n") + F.col("i")).drop("_o", "_n")


def one_train(rises: DataFrame, falls: DataFrame) -> DataFrame:
    """Two trains of edges as one, numbered in time."""
    both = rises.select("session_id", "t").unionByName(falls.select("session_id", "t"))
    return both.withColumn("n", F.row_number().over(W.partitionBy("session_id").orderBy("t")))
