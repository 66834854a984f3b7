"""Principal components of wide rows, and the first one's course in time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolock.functions.lineage import settled
from chronolock.operators.signals import fill_stat, gaussian

#: Rows that a task holds at a time; vectors of a piece of a session; partial sums that are put together at a time.
BLOCK, PIECE, FAN = 1024, 4096, 32
#: Numbers of a piece, about; numbers of all sessions' components that are broadcast.
CELLS, HELD = 1 << 23, 1 << 22


@dataclass
class Components:
    """Count, means and scales of columns (scale 0: constant), components as columns of ``loads``, their shares
    of variance."""

    n: int
    mean: np.ndarray
    scale: np.ndarray
    loads: np.ndarray
    shares: np.ndarray


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors of a column, a row each; those with a null are left out."""
    lists = column.filter(column.is_valid())
    flat = lists.flatten()
    m = flat.to_numpy(zero_copy_only=False).astype(float)
    wide = width or (len(m) // len(lists) if len(lists) else 0)
    if wide * len(lists) != len(m):
        raise ValueError("components: rows of different lengths")
    m = m.reshape(len(lists), wide) if wide else np.zeros((0, 0))
    return m[~np.isnan(m).any(axis=1)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for k in range(0, b.num_rows, BLOCK):
            m = _matrix(b.column(0).slice(k, BLOCK))
            if len(m):
                yield m


def _total(rows: DataFrame, part) -> np.ndarray | None:
    """The sum of ``part(block)`` over all rows, a tree of partial sums; its size does not grow with the rows."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for m in _blocks(batches):
            x = part(m)
            total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([list(total.shape)], pa.list_(pa.int64()))], ["sum", "shape"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shape = None, None
        for b in batches:
            for x, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, shape = np.frombuffer(x), s
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([shape], pa.list_(pa.int64()))], ["sum", "shape"])

    kind = "sum binary, shape array<long>"
    sums = rows.mapInArrow(own, kind)
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while many > FAN:
        many = -(-many // FAN)
        sums = sums.repartition(many).mapInArrow(added, kind)
    got = sums.repartition(1).mapInArrow(added, kind).first()
    return None if got is None else np.frombuffer(got["sum"]).reshape(got["shape"])


def _triangle(rows: DataFrame, part) -> np.ndarray:
    """The triangle R of a QR decomposition of ``part(block)`` over all rows: that of each task, then, as a tree,
    of triangles stacked on each other."""

    def stacked(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = None
        for y in blocks:
            r = np.linalg.qr(y if r is None else np.vstack([r, y]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()]), pa.array([r.shape[1]], pa.int64())], ["r", "width"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stacked(np.frombuffer(x).reshape(-1, w) for b in batches for x, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

    kind = "r binary, width long"
    tree = rows.mapInArrow(lambda batches: stacked(part(m) for m in _blocks(batches)), kind)
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while many > FAN:
        many = -(-many // FAN)
        tree = tree.repartition(many).mapInArrow(again, kind)
    got = tree.repartition(1).mapInArrow(again, kind).first()
    return np.frombuffer(got["r"]).reshape(-1, got["width"])


def fit_wide(rows: DataFrame, k: int, value: str = "x", standardise: bool = True, spare: int = 10, passes: int = 60, tolerance: float = 1e-10, seed: int = 0) -> Components | None:
    """The first ``k`` components of ``rows``, whose ``value`` is an array of one length; None without two
    whole rows (those with a null don't count).

    A randomised range finder: rows are projected on ``k + spare`` directions, made orthonormal by a tree of
    small QR decompositions, and projected back; that is repeated until the shares of variance stand still.  Only
    matrices of columns by directions reach the driver, none of columns by columns.  Each pass reads the
    rows twice.  Constant columns count nothing; the largest loading of a component is positive."""
    x = settled(rows.select(F.col(value).cast("array<double>").alias("x")))
    first = _total(x, lambda m: np.vstack([np.full(m.shape[1], len(m), float), m.sum(0)]))
    if first is None or first[0, 0] < 2:
        return None
    n, d = int(first[0, 0]), first.shape[1]
    mean = first[1] / n
    spread = np.sqrt(_total(x, lambda m: ((m - mean) ** 2).sum(0)) / n)
    live = spread > 1e-12 * np.maximum(np.abs(mean), 1)
    scale = np.where(live, 1 / np.where(live, spread, 1), 0.0) if standardise else live.astype(float)
    total = float(n * ((spread * scale) ** 2).sum())
    if total == 0:
        return Components(n, mean, scale, np.zeros((d, 0)), np.zeros(0))
    wide = min(d, n, k + spare)
    rng = np.random.default_rng(seed)
    basis, last = np.linalg.qr(rng.normal(size=(d, wide)))[0], None
    for _ in range(passes):
        now = scale[:, None] * basis
        r = _triangle(x, lambda m, now=now: (m - mean) @ now)
        u, s, vt = np.linalg.svd(r)
        rank = int((s > 1e-13 * s[0]).sum())
        turn = now @ (vt[:rank].T / s[:rank])  # rows times this are orthonormal
        back = _total(x, lambda m, turn=turn: ((m - mean) @ turn).T @ (m - mean)) * scale
        u, s, vt = np.linalg.svd(back, full_matrices=False)
        shares, basis = s**2 / total, vt.T
        if last is not None and len(last) == len(shares) and np.abs(shares[:k] - last[:k]).max() < tolerance:
            break
        last = shares
    keep = min(k, int((shares > 1e-12 * shares[0]).sum()))
    loads = basis[:, :keep]
    loads = loads * np.sign(loads[np.abs(loads).argmax(0), np.arange(keep)])
    return Components(n, mean, scale, loads, shares[:keep])


def scores(rows: DataFrame, fitted: Components, value: str = "x") -> DataFrame:
    """``rows`` with ``scores``, an array of a number for each component; null for rows with a null."""
    mean, turn = fitted.mean, fitted.scale[:, None] * fitted.loads

    @F.pandas_udf("array<double>")
    def on(x: pd.Series) -> pd.Series:
        m = np.array([np.full(len(mean), np.nan) if v is None else np.asarray(v, float) for v in x]).reshape(len(x), len(mean))
        return pd.Series([None if np.isnan(y).any() else y.tolist() for y in (m - mean) @ turn], dtype=object)

    return rows.withColumn("scores", on(F.col(value).cast("array<double>")))


def _sides(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``_rois`` traces of each session, and whether they are more than its samples (``_by_trace``)."""
    one = rows.groupBy(*keys, "roi").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.count("*").alias("_rois"), F.max("_n").alias("_n"))
    return one.select(*[F.col(k).alias(f"_{k}") for k in keys], "_rois", (F.col("_rois") > F.col("_n")).alias("_by_trace"))


def _gram(rows: DataFrame, keys: list[str], plain: str) -> DataFrame:
    """``keys, a, g``: the rows (8-byte numbers) of the sum over a session of the products of ``x`` with itself.

    A ``_piece`` gives a row for each place of ``x``, and those of one place are added up."""

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["x"].tolist(), float)
        return pd.DataFrame({k: [pdf[k].iloc[0]] * m.shape[1] for k in keys} | {"a": range(m.shape[1]), "g": [g.tobytes() for g in m.T @ m]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), pdf["a"].iloc[0], np.sum([np.frombuffer(g) for g in pdf["g"]], axis=0).tobytes()]], columns=[*keys, "a", "g"])

    kind = f"{plain}, a int, g binary"
    cells = rows.groupBy(*keys, "_piece").applyInPandas(products, kind)
    return cells.groupBy(*keys, "a").applyInPandas(added, kind)


def first_component(signal: DataFrame, keys: Sequence[str], sigma: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Of each session (``keys``) the course in time of the first component of its traces (``keys, i, trace``,
    of unit length), and the traces by their score (``keys, roi, score, place``, largest first).

    ``signal`` has ``roi, i, v``, each trace all places.  Nulls take their trace's median, traces are smoothed
    (``sigma`` samples) and each sample is centred over traces.  Only a matrix of the shorter side is decomposed:
    of traces by traces, or, in a session of more traces than samples, of samples by samples.  Products are
    summed over blocks of the longer side, so a session spreads over tasks.  The score of largest size is positive;
    a session without variance has zeros."""
    keys = list(keys)
    own = [*keys, "roi"]
    smooth = fill_stat(signal.select(*own, "i", "v"), own).select(*own, "i", F.col("filled").alias("v"))
    smooth = gaussian(smooth, own, sigma).select(*own, "i", F.col("smooth").alias("v")) if sigma > 0 else smooth
    smooth = settled(smooth)
    mid = smooth.groupBy(*keys, "i").agg(F.avg("v").alias("_m")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("i").alias("_i"), "_m")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    sides = settled(_sides(smooth, keys))
    centred = smooth.join(mid, [*same, F.col("i") == F.col("_i")]).select(*own, "i", (F.col("v") - F.col("_m")).alias("v"))
    # a row for each place of the longer side: its vector along the shorter one
    named = sides.where("_by_trace").drop("_by_trace")
    block = F.greatest(F.least(F.lit(PIECE), F.floor(F.lit(CELLS) / F.size("x"))), F.lit(1))
    tall = centred.join(named, same, "left_anti").groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct("roi", "v"))).alias("e"))
    tall = tall.select(*keys, "i", F.transform("e", lambda x: x["roi"]).alias("names"), F.transform("e", lambda x: x["v"]).alias("x"))
    tall = settled(tall.withColumn("_piece", F.floor(F.col("i") / block)))
    wide = centred.join(named, same, "left_semi").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("e"))
    wide = wide.select(*own, F.transform("e", lambda x: x["i"]).alias("names"), F.transform("e", lambda x: x["v"]).alias("x"))
    wide = wide.join(named, same).withColumn("_piece", F.pmod(F.xxhash64("roi"), F.ceil(F.col("_rois") / block)))
    wide = settled(wide.select(*own, "names", "x", "_piece"))
    plain = signal.select(*keys).schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.array([np.frombuffer(x) for x in pdf.sort_values("a")["g"]])
        values, axes = np.linalg.eigh((g + g.T) / 2)
        u, s = axes[:, -1], float(np.sqrt(max(values[-1], 0)))
        u = u * np.sign(u[np.abs(u).argmax()]) if s > 1e-12 else np.zeros(len(g))
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), u.tolist(), s]], columns=[*keys, "u", "s"])

    dot = F.aggregate(F.zip_with("x", "u", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    def met(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with the product of their vector and their session's component; and that component by names."""
        found = settled(_gram(rows, keys, plain).groupBy(*keys).applyInPandas(solve, f"{plain}, u array<double>, s double"))
        axis = found.select(*[F.col(k).alias(f"_{k}") for k in keys], "u", "s")
        sized = found.agg(F.sum(F.size("u"))).first()[0] or 0
        both = rows.join(F.broadcast(axis) if sized <= HELD else axis, same).withColumn("dot", dot)
        names = rows.groupBy(*keys).agg(F.first("names").alias("names"))
        return both, names.join(axis, same).select(*keys, F.explode(F.arrays_zip("names", "u")).alias("e"), "s").select(*keys, F.col("e.names").alias("name"), F.col("e.u").alias("u"), "s")

    by_sample, rois = met(tall)
    trace = by_sample.select(*keys, "i", F.when(F.col("s") > 1e-12, F.col("dot") / F.col("s")).otherwise(0.0).alias("trace"))
    each = rois.select(*keys, F.col("name").alias("roi"), (F.col("u") * F.col("s")).alias("score"))
    if not wide.isEmpty():
        by_trace, samples = met(wide)
        by_trace = settled(by_trace.select(*keys, "roi", F.when(F.col("s") > 1e-12, F.col("dot")).otherwise(0.0).alias("score")))
        turn = by_trace.groupBy(*keys).agg(F.when(F.min_by("score", F.struct(-F.abs("score"), "roi")) < 0, -1.0).otherwise(1.0).alias("turn"))
        turn = turn.select(*[F.col(k).alias(f"_{k}") for k in keys], "turn")
        trace = trace.unionByName(samples.join(turn, same).select(*keys, F.col("name").alias("i"), (F.col("u") * F.col("turn")).alias("trace")))
        each = each.unionByName(by_trace.join(turn, same).select(*keys, "roi", (F.col("score") * F.col("turn")).alias("score")))
    return trace, each.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "roi")))
