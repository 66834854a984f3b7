"""Whitening of embeddings.

Entries become whole numbers, so counts, sums and deviations are exact.  The centred scatter is summed
over partitions; pivoted Cholesky factors it, and one-sided Jacobi turns the columns of that triangular
factor until they are orthogonal: their squared norms are the eigenvalues of the scatter, and they
themselves, normalised, its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolock.llm.common import require, settle

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries of a larger size are refused: past it doubles and longs would no longer be exact.
LARGEST = float(1 << 30)
#: Vectors that a task holds at a time.
BLOCK = 4096


@dataclass
class Basis:
    """Count, sums, eigenvalues of the covariance in falling order, unit components as columns, trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float


def pivoted_cholesky(a: np.ndarray, tolerance: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """``l`` (lower trapezoidal) and ``order`` with ``a[order][:, order] = l @ l.T``; the columns end
    where the largest remaining diagonal entry is below ``tolerance`` times the first."""
    a = a.copy()
    d = len(a)
    order = np.arange(d)
    l_ = np.zeros((d, d))
    first = float(a.diagonal().max()) if d else 0.0
    for k in range(d):
        p = k + int(a.diagonal()[k:].argmax())
        if a[p, p] <= tolerance * first or a[p, p] <= 0:
            return l_[:, :k], order
        if p != k:
            a[[k, p]] = a[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
            l_[[k, p]] = l_[[p, k]]
            order[[k, p]] = order[[p, k]]
        l_[k, k] = np.sqrt(a[k, k])
        l_[k + 1 :, k] = a[k + 1 :, k] / l_[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(l_[k + 1 :, k], l_[k + 1 :, k])
    return l_, order


def one_sided_jacobi(l_: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> np.ndarray:
    """``l_`` with its columns turned in pairs until all are orthogonal.  The pairs of a round are
    disjoint and turn at once; a sweep meets every pair."""
    g = l_.copy()
    r = g.shape[1]
    if r < 2:
        return g
    ring = [*range(r), *([-1] if r % 2 else [])]
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], ring[::-1]) if a >= 0 and b >= 0]
            p, q = (np.array(x) for x in zip(*pairs))
            gp, gq = g[:, p], g[:, q]
            alpha, beta, gamma = (gp * gp).sum(0), (gq * gq).sum(0), (gp * gq).sum(0)
            size = np.sqrt(alpha * beta)
            lean = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, float(lean.max()))
            turn = lean > tolerance
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            g[:, p], g[:, q] = c * gp - s * gq, s * gp + c * gq
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if worst <= tolerance * 4:
            break
    return g


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding in falling order, and unit eigenvectors as columns."""
    l_, order = pivoted_cholesky(scatter)
    g = one_sided_jacobi(l_)
    norms = np.sqrt((g * g).sum(0))
    keep = [i for i in np.argsort(-norms, kind="stable") if norms[i] > 1e-7 * norms.max()]
    axes = np.zeros((len(scatter), len(keep)))
    axes[order] = g[:, keep] / norms[keep]
    return norms[keep] ** 2, axes


def _matrix(column: pa.Array) -> np.ndarray:
    """Whole numbers of a column of vectors, a row each."""
    width = len(column[0])
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(c) != width * len(column) or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("whitening: vectors of different lengths")
    if len(c) and np.abs(c).max() >= LARGEST:
        raise ValueError(f"whitening: an entry of {LARGEST} or more")
    return (np.floor(SCALE * c).astype(np.int64) + SHIFT).reshape(-1, width)


def _centred(m: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exact."""
    if m.shape[1] != len(sums):
        raise ValueError("whitening: vectors of different lengths")
    if m.size and n * int(np.abs(m).max()) >= 1 << 62:
        raise OverflowError("whitening: count times entry does not fit 63 bits")
    return n * m - sums


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for k in range(0, b.num_rows, BLOCK):
            part = b.slice(k, BLOCK)
            yield part, _matrix(part.column(at))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` of the rows whose vector is neither null nor holds null, NaN or
    infinite entries, nor is empty."""
    require(vectors, ("vec_id", "embedding"), "embeddings")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return kept.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~odd)


def _added(df: DataFrame, run, keys: list[str], kind: str) -> DataFrame:
    """What tasks have summed up, cell by cell."""
    return df.mapInArrow(run, ", ".join(f"{k} int" for k in keys) + f", value {kind}").groupBy(*keys).agg(F.sum("value").alias("value"))


def fit(vectors: DataFrame) -> Basis | None:
    """The basis of all usable vectors; None where there are none.  Two scans; only sums by dimension
    and by pair of dimensions reach the driver."""
    x = usable(vectors).select("embedding")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, m in _blocks(batches, 0):
            if total is not None and len(total) != m.shape[1]:
                raise ValueError("whitening: vectors of different lengths")
            n, total = n + len(m), m.sum(0) if total is None else total + m.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], ["i", "value"])

    first = {r.i: r.value for r in _added(x, sums, ["i"], "long").collect()}
    if not first:
        return None
    n, d = first.pop(-1), len(first)
    s = np.array([first[i] for i in range(d)], np.int64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, m in _blocks(batches, 0):
            c = _centred(m, n, s) / n
            total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], ["i", "j", "value"])

    a = np.zeros((d, d))
    for r in _added(x, scatter, ["i", "j"], "double").toLocalIterator():
        a[r.i, r.j] = a[r.j, r.i] = r.value
    values, axes = eigen(a)
    return Basis(n, s, values / n, axes, float(a.trace() / n))


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable vector
    and the first ``k`` components.

    Vectors that are null or empty, or hold null, NaN or infinite entries, are left out.  Components
    whose eigenvalue is rounding error (vectors in a smaller space, fewer vectors than ``k`` + 1) don't
    exist: then rows have fewer, and a single or constant vector none.  An empty table gives no rows;
    repeated rows and null ids are kept; ties of eigenvalues stand in any order; other columns are left
    behind.  Vectors of different lengths, entries of 2**30 or more and a deviation over 63 bits raise an
    error.  Time is linear in rows; one matrix of dimensions by dimensions is decomposed on the driver.
    """
    schema = "vec_id long, deviation long, w array<double>"
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    basis = fit(vectors)
    if basis is None or not len(basis.values):
        return spark.createDataFrame([], out)
    k = min(k, len(basis.values))
    n, sums, axes, width = basis.n, basis.sums, basis.axes[:, :k], np.sqrt(basis.values[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, m in _blocks(batches, 1):
            c = _centred(m, n, sums)
            if c.size and float(np.abs(c).max()) ** 2 * c.shape[1] >= 2.0**63:
                dev = [sum(y * y for y in row) for row in c.tolist()]
                if max(dev) >= 1 << 63:
                    raise OverflowError("whitening: a deviation does not fit 63 bits")
            else:
                dev = (c * c).sum(1)
            w = (c / n) @ axes / width
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dev, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), k).cast(pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    rows = settle(usable(vectors).mapInArrow(run, schema), "whitened")
    mean = rows.agg(*[F.avg(F.col("w")[i]) for i in range(k)]).first()
    c = [F.col("w")[i] - F.lit(mean[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.agg(*[F.avg(c[i] * c[j]) for i, j in pairs]).first()
    error = max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))
    share = F.array(*[F.lit(float(e / basis.trace)) for e in basis.values[:k]])
    each = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))
