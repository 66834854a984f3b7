"""Tests and fits: sums and ranks in Spark, tails of distributions in small vectorised functions."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chronolock.functions import median, ratio
from chronolock.functions.blocks import samples_of
from chronolock.functions.lineage import settled
from chronolock.functions.quantiles import HELD
from chronolock.functions.ranking import large_keys, ranked, running, suffix_least


def _normal_tails(z: pd.Series) -> pd.Series:
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else None).astype(float)


def normal_tail(z: Column | str) -> Column:
    """Two-sided p of a normal deviate."""
    return F.pandas_udf(_normal_tails, "double")(z)


def _gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma, by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return 1 - total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 1000):
        for e in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + e * d), 1 + e / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def f_tail_value(f: float, n: float, d: float) -> float:
    return _beta_share(d / 2, n / 2, d / (d + n * f)) if f > 0 else 1.0


def _chi_square_tails(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_gamma_tail(d / 2, v / 2) if v == v and d == d and d > 0 else None for v, d in zip(x, df)], dtype=float)


def chi_square_tail(x: Column | str, df: Column | str) -> Column:
    return F.pandas_udf(_chi_square_tails, "double")(x, df)


@lru_cache(maxsize=128)
def _signed_rank_shares(n: int) -> np.ndarray:
    """Of all signs of the ranks 1 to ``n``: the share whose sum of positive ranks is each number or less."""
    ways = np.ones(1)
    for r in range(1, n + 1):
        grown = np.zeros(len(ways) + r)
        grown[: len(ways)] += ways
        grown[r:] += ways
        ways = grown / 2
    return np.cumsum(ways)


def signed_rank_tail(statistic: Column | str, n: Column | str) -> Column:
    """Exact two-sided p of the smaller sum of signed ranks of ``n`` untied values."""

    def run(w: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, 2 * float(_signed_rank_shares(int(m))[int(round(x))])) if x == x and m == m else None for x, m in zip(w, n)], dtype=float)

    return F.pandas_udf(run, "double")(statistic, n)


def wilcoxon(values: DataFrame, keys: list[str], value: str = "v", exact: int = 50, held: int | None = HELD) -> DataFrame:
    """Signed ranks against 0: sum of ranks above and below, and the two-sided p.

    p is exact for ``exact`` values at most if none is 0 and no sizes tie, else by the normal
    approximation with its correction for ties.  Zeros are left out; p is 1 where only zeros are.
    Values of one size are counted before they are ranked; keys of more than ``held`` values (None: there are
    none) are ranked over all tasks."""
    every = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).withColumn("_a", F.abs("_v"))
    marked = every.where(F.col("_v") != 0)
    c = ranked(marked, keys, "_a", held and large_keys(marked, keys, "_a", held), (F.count_if(F.col("_v") > 0).alias("_p"),))
    rank = F.col("below") + (F.col("n") + 1) / F.lit(2.0)
    w = c.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("_p") * rank).alias("w_plus"), F.sum((F.col("n") - F.col("_p")) * rank).alias("w_minus"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    mean, var = F.col("n") * (F.col("n") + 1) / 4, F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48
    w = w.withColumn("z", (F.least("w_plus", "w_minus") - mean) / F.sqrt(F.when(var > 0, var))).withColumn("statistic", F.least("w_plus", "w_minus"))
    whole = every.groupBy(*keys).agg(F.count("*").alias("_every"))
    out = whole.join(w, keys, "left")
    small = (F.col("n") <= exact) & (F.col("ties") == 0) & (F.col("n") == F.col("_every"))
    tail = signed_rank_tail(F.when(small, F.col("statistic")), F.when(small, F.col("n")))
    return out.withColumn("p", F.when(F.col("n").isNull(), F.lit(1.0)).when(small, tail).otherwise(normal_tail("z"))).drop("_every")


def kruskal(values: DataFrame, keys: list[str], group: str = "stimulus", value: str = "v", held: int | None = HELD) -> DataFrame:
    """Kruskal-Wallis H over groups, corrected for ties, and its chi-square p; two groups at least.

    Groups meet through the counts of each value; keys of more than ``held`` values are ranked over all tasks."""
    there = values.where(F.col(value).isNotNull()).select(*keys, group, F.col(value).alias("_v"))
    c = ranked(there, keys, "_v", held and large_keys(there, keys, "_v", held)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_v").alias("_x"), (F.col("below") + (F.col("n") + 1) / F.lit(2.0)).alias("_r"), F.col("n").alias("_c"))
    own = there.groupBy(*keys, group, "_v").agg(F.count("*").alias("_n"))
    r = own.join(c, [*[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_v") == F.col("_x")])
    g = r.groupBy(*keys, group).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_r")).alias("s"), F.sum(F.col("_n") * (F.pow("_c", F.lit(2)) - 1)).alias("t"))
    h = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("t").alias("t"), F.count("*").alias("groups")).where("groups >= 2")
    n = F.col("n")
    raw = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    h = h.withColumn("h", raw / (1 - ratio(F.col("t"), n * n * n - n))).withColumn("df", F.col("groups") - 1)
    return h.select(*keys, "n", "groups", "h").withColumn("p", chi_square_tail("h", (F.col("groups") - 1).cast("double")))


def mann_whitney(values: DataFrame, group: str, keys: list[str], value: str = "v", held: int | None = HELD) -> DataFrame:
    """U of every pair of groups within a key, with sizes, medians and the normal p corrected for
    ties.  Pairs meet through the counts of each value, so no row meets another; pairs of more than ``held``
    values are ranked over all tasks."""
    there = values.where(F.col(value).isNotNull())
    counts = there.groupBy(*keys, group, F.col(value).alias("x")).agg(F.count("*").alias("c"))
    sizes = there.groupBy(*keys, group).agg(F.count("*").alias("n"), median(value).alias("med"))
    # the groups of a key in one row, and from it a row for each pair
    every = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "n", "med"))).alias("e"))
    both = F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: b["g"] > a["g"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = every.select(*keys, F.explode(both).alias("p")).select(*keys, F.col("p.a.g").alias("a"), F.col("p.b.g").alias("b"), F.col("p.a.n").alias("na"), F.col("p.b.n").alias("nb"), F.col("p.a.med").alias("med_a"), F.col("p.b.med").alias("med_b"))
    named = ["a", "b", "na", "nb", "med_a", "med_b"]
    met = pairs.withColumn("g", F.explode(F.array("a", "b"))).join(counts.withColumnRenamed(group, "g"), [*keys, "g"])
    at = met.groupBy(*keys, *named, "x").agg(F.sum("c").alias("c"), F.coalesce(F.sum(F.when(F.col("g") == F.col("a"), F.col("c"))), F.lit(0)).alias("ca"))
    pair = [*keys, *named]
    large = held and large_keys(at, pair, "x", held)
    at = running(at, pair, "x", "c", large).withColumn("rank", F.col("below") + (F.col("c") + 1) / 2)
    u = at.groupBy(*keys, "a", "b", "na", "nb", "med_a", "med_b").agg(F.sum(F.col("ca") * F.col("rank")).alias("r"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("t"))
    n, m = F.col("na"), F.col("nb")
    u = u.withColumn("u", F.col("r") - n * (n + 1) / 2)
    var = n * m / 12 * ((n + m + 1) - F.col("t") / ((n + m) * (n + m - 1)))
    u = u.withColumn("z", (F.abs(F.col("u") - n * m / 2) - 0.5) / F.sqrt(F.when(var > 0, var)))
    return u.withColumn("p", normal_tail(F.greatest("z", F.lit(0.0)))).drop("r", "t")


def benjamini_hochberg(rows: DataFrame, keys: list[str], p: str = "p", held: int | None = HELD) -> DataFrame:
    """T4: ``q``: false-discovery adjusted p within keys; null p stay null and don't count.

    Equal p share their q, so it is found for each p that occurs and brought back to the rows; keys of more
    than ``held`` rows (None: there are none) are ranked over all tasks."""
    large = held and large_keys(rows, keys, p, held)
    c = ranked(rows.select(*keys, F.col(p).alias("_p")), keys, "_p", large)
    c = c.withColumn("_raw", F.col("_p") * F.col("total") / (F.col("below") + F.col("n")))
    q = suffix_least(c, keys, "_p", "_raw", large).select(*[F.col(k).alias(f"_{k}") for k in keys], "_p", F.least(F.greatest("least", F.lit(0.0)), F.lit(1.0)).alias("q"))
    return rows.join(q, [*[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col(p) == F.col("_p")], "left").drop(*[f"_{k}" for k in keys], "_p")


#: Events of a piece, shuffles of a block.
PIECE, BLOCK = 1 << 16, 250


def labels_dealt(counts: np.ndarray, n: int, piece: int, size: int, seed: list[int], block: int, shuffles: int) -> np.ndarray:
    """How many of each label a piece of ``size`` events gets under each shuffle of a block (a row each).

    The labels of all pieces are split in two by a draw without replacement, then those of each half, and so
    on; a split's draws come from its own seed, so every piece that shares it makes the same ones, and
    a piece asks for as many splits as the logarithm of the pieces."""
    have = np.tile(np.asarray(counts, np.int64), (shuffles, 1))
    low, high = 0, -(-n // size)
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([*seed, 0, block, low, high])
        drawn = np.array([rng.multivariate_hypergeometric(h, (mid - low) * size) for h in have])
        have, low, high = (drawn, low, mid) if piece < mid else (have - drawn, mid, high)
    return have


def sums_by_label(v: np.ndarray, have: np.ndarray, piece: int, seed: list[int], block: int) -> np.ndarray:
    """Sums of a piece's values by label under each shuffle of a block: the values are shuffled, and the first
    go to the first label, as many as it has (``have``), and so on."""
    rng = np.random.default_rng([*seed, 1, block, piece])
    out, step = np.empty(have.shape), max(1, (1 << 20) // max(len(v), 1))
    for at in range(0, len(have), step):
        mine = have[at : at + step]
        dealt = rng.permuted(np.broadcast_to(v, (len(mine), len(v))), axis=1)
        if (have == have[0]).all() and have[0].all():
            out[at : at + step] = np.add.reduceat(dealt, np.append(0, np.cumsum(have[0])[:-1]), axis=1)
            continue
        upto = np.pad(np.cumsum(dealt, axis=1), ((0, 0), (1, 0)))
        ends = np.pad(np.cumsum(mine, axis=1), ((0, 0), (1, 0)))
        out[at : at + step] = np.diff(np.take_along_axis(upto, ends, axis=1), axis=1)
    return out


def permutation_fve(values: DataFrame, keys: list[str], shuffles: int = 2000, seed: int = 0, group: str = "stimulus", value: str = "v", event: str = "event_id", held: int = HELD) -> DataFrame:
    """T5: the share of variance between groups, and how often shuffled labels reach it:
    p = (1 + reached) / (shuffles + 1).  Rows without a value or a label are left out.

    The events of a key (those of one trace) are numbered and dealt in pieces of ``PIECE``.  A shuffle first
    deals each piece its share of the labels (:func:`labels_dealt`), then shuffles within the piece: all orders
    of the whole are equally likely, yet a piece needs only the counts of labels, and its sums by shuffle and
    label are added up.  Seeds come from the key.  Keys of up to 1e9 events."""
    there = values.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*keys, F.struct(F.col(event).alias("e"), F.col(value).cast("double").alias("v"), F.col(group).alias("g")).alias("_row"))
    there = settled(there)
    large = large_keys(there, keys, "_row", held)
    deal = ranked(there, keys, "_row", large).select(*keys, "_row", F.explode(F.sequence("below", F.col("below") + F.col("n") - 1)).alias("_i"))
    named = [F.col(k).alias(f"_{k}") for k in keys]
    each = there.groupBy(*keys, F.col("_row.g").alias("g")).agg(F.count("*").alias("n"), F.sum("_row.v").alias("s"))
    labels = each.groupBy(*named).agg(F.array_sort(F.collect_list(F.struct("g", "n"))).alias("_labels"), (F.sum("s") / F.sum("n")).alias("_mean"), F.sum("n").alias("_all"))
    rows = deal.join(labels, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    code = (F.array_position(F.transform("_labels", lambda x: x["g"]), F.col("_row.g")) - 1).cast("int")
    rows = rows.select(*keys, "_i", (F.col("_row.v") - F.col("_mean")).alias("_v"), code.alias("_code"), F.col("_all").alias("_n"), F.transform("_labels", lambda x: x["n"]).alias("_counts"), F.floor(F.col("_i") / PIECE).alias("_piece"))
    plain = values.select(*keys).schema.simpleString()[len("struct<") : -1].replace(":", " ")

    kinds = StructType.fromDDL(f"{plain}, block int, n bigint, fve double, reached bigint, counts binary, total double, seen binary, sums binary")
    arrow = to_arrow_schema(kinds)

    def piece(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("_i").to_numpy(), kind="stable")
        n, counts, v, code = t.column("_n")[0].as_py(), np.asarray(t.column("_counts")[0].as_py()), t.column("_v").to_numpy()[order], t.column("_code").to_numpy()[order]
        own = [seed, *[zlib.crc32(str(t.column(k)[0].as_py()).encode()) for k in keys]]
        number, out, sums = t.column("_piece")[0].as_py(), [], []
        seen, own_total = np.bincount(code, v, len(counts)), float(v @ v)
        for block in range(-(-shuffles // BLOCK)):
            have = labels_dealt(counts, n, number, PIECE, own, block, min(BLOCK, shuffles - block * BLOCK))
            found = sums_by_label(v, have, number, own, block)
            if n <= PIECE:
                sums.append(found.ravel())
            else:
                out.append([block, n, None, None, counts.astype(np.int64).tobytes(), own_total, seen.tobytes(), found.tobytes()])
        if n <= PIECE:  # the piece is the key
            out.append([None, n, *verdict(np.concatenate(sums or [np.empty(0)]), seen, counts, own_total), None, None, None, None])
        named = [t.column(k).combine_chunks().take(pa.array([0] * len(out))).cast(arrow.field(k).type) for k in keys]
        return pa.Table.from_arrays([*named, *[pa.array(c, f.type) for c, f in zip(zip(*out), list(arrow)[len(keys) :])]], schema=arrow)

    def verdict(sums: np.ndarray, seen: np.ndarray, counts: np.ndarray, total: float) -> tuple[float, int]:
        """The share of variance, and how many shuffles reach it."""
        own = float((seen**2 / counts).sum())
        between = (sums.reshape(-1, len(counts)) ** 2 / counts).sum(1)
        return own / total if total > 1e-12 else 0.0, int((between >= own - 1e-12 * max(total, 1)).sum())

    solved = settled(rows.groupBy(*keys, "_piece").applyInArrow(piece, kinds))

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        sums, seen = (np.sum([np.frombuffer(x) for x in pdf[c]], axis=0) for c in ("sums", "seen"))
        found = verdict(sums, seen, np.frombuffer(pdf["counts"].iloc[0], np.int64), float(pdf["total"].sum()))
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), int(pdf["n"].iloc[0]), *found]], columns=[*keys, "n", "fve", "reached"])

    pieced = solved.where("block is not null").groupBy(*keys, "block").applyInPandas(added, f"{plain}, n bigint, fve double, reached bigint")
    blocks = solved.where("block is null").select(*keys, "n", "fve", "reached").unionByName(pieced)
    return blocks.groupBy(*keys).agg(F.first("n").alias("n"), F.first("fve").alias("fve"), ((1 + F.sum("reached")) / F.lit(shuffles + 1)).alias("p"))


def spaced(n: int, most: int = 20) -> list[int]:
    """``most`` evenly spaced ones of ``n`` samples, or all."""
    return sorted(set(np.linspace(0, n - 1, min(most, n), dtype=int).tolist()))


def manova(windows: DataFrame, keys: list[str], samples: list[int] | None = None, group: str = "stimulus", event: str = "event_index", most: int = 20, gap_share: float = 0.1, only: DataFrame | None = None) -> DataFrame:
    """Wilks' lambda of samples of the windows over groups, with Rao's F and p.

    Trials with a larger share of gaps than ``gap_share`` go; smaller gaps are filled along the line
    (W31).  ``samples`` are ``most`` evenly spaced ones if not given, fewer where trials are few;
    constant samples don't count, nor do groups of one trial.  ``windows`` has ``k, v``, a row a sample, or
    ``samples``, a row a trial (:func:`~chronolock.operators.windows.whole_windows`).  Only the keys and groups in
    ``only`` are tested, if given.  Tasks add up the cross products of their trials, and one small matrix a key is solved."""
    trial = [*keys, group, event]
    there = windows.where(reduce(and_, (F.col(c).isNotNull() for c in trial)))
    # a row a trial: its samples in order
    if "samples" in windows.columns:
        rows = there.select(*keys, group, "samples")
    else:  # trials of a key are put together anywhere: in order, those of a group are added up
        rows = there.groupBy(*trial).agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("samples")).select(*keys, group, "samples").sortWithinPartitions(*keys, group)
    if samples is None:
        tested = rows if only is None else rows.join(only, [*keys, group], "left_semi")
        last = tested.where(F.size(F.filter("samples", lambda s: s["v"].isNull())) / F.size("samples") <= gap_share).agg(F.max(F.element_at("samples", -1)["k"])).first()[0] or 0
        samples = spaced(last + 1, most)
    d, wanted = len(samples), np.asarray(samples)
    first, second = np.triu_indices(d + 1)
    named = StructType([*rows.select(*keys, group).schema.fields, *StructType.fromDDL("xy array<double>").fields])

    def trials(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The rows that count, and their samples and a one: products with it are the sums, and the trials."""
        row, k, v, valid = samples_of(column)
        size, gaps = np.bincount(row, minlength=len(column)), np.bincount(row[~valid], minlength=len(column))
        at = np.minimum(np.searchsorted(wanted, k), d - 1)
        own = wanted[at] == k
        x, seen = np.ones((len(column), d + 1)), np.zeros((len(column), d), int)
        x[row[own], at[own]] = v[own]
        np.add.at(seen, (row[own], at[own]), 1)
        keep = (size > 0) & (gaps <= gap_share * size) & (gaps < size) & (seen == 1).all(1)
        ends = np.append(0, np.cumsum(size))
        for r in np.flatnonzero(keep & (gaps > 0)):  # W31: the line between the samples round a gap, the nearest at the ends
            mine = slice(ends[r], ends[r + 1])
            known, missing = valid[mine], own[mine] & ~valid[mine]
            x[r, at[mine][missing]] = np.interp(k[mine][missing], k[mine][known], v[mine][known])
        return np.flatnonzero(keep), x[keep]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of products of each two samples over the trials of a key and group, for each batch."""
        for b in batches:
            if not b.num_rows:
                continue
            kept, x = trials(b.column("samples"))
            if not len(kept):
                continue
            code = np.zeros(b.num_rows, np.int64)
            for c in (*keys, group):
                own = b.column(c).dictionary_encode("encode")
                code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(code[kept], kind="stable")
            starts = np.flatnonzero(np.diff(code[kept][order], prepend=-1))
            x = x[order]
            sums = np.stack([p[first, second] for p in (y.T @ y for y in np.split(x, starts[1:]))])
            at = pa.array(kept[order[starts]])
            xy = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * len(first), pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in (*keys, group)], xy], names=[*keys, group, "xy"])

    cells = rows.mapInArrow(products, named)
    if only is not None:
        by_key = only.groupBy(*keys).agg(F.collect_set(group).alias("_only"))
        cells = cells.join(by_key, keys).where(F.array_contains("_only", F.col(group))).drop("_only")
    schema = StructType([*cells.select(*keys).schema.fields, *StructType.fromDDL("n bigint, groups bigint, used int, wilks double, f double, p double").fields])
    arrow = to_arrow_schema(schema)

    def solved(t: pa.Table) -> pa.Table:
        values = solve(t)
        named = [t.column(k).combine_chunks().slice(0, 1).cast(arrow.field(k).type) for k in keys]
        return pa.Table.from_arrays([*named, *[pa.array([v], f.type) for v, f in zip(values, list(arrow)[len(keys) :])]], schema=arrow)

    def solve(t: pa.Table) -> tuple:
        code = t.column(group).combine_chunks().dictionary_encode()
        sums = np.zeros((len(code.dictionary), len(first)))
        np.add.at(sums, code.indices.to_numpy(), t.column("xy").combine_chunks().flatten().to_numpy().reshape(t.num_rows, len(first)))
        each = np.zeros((len(sums), d + 1, d + 1))
        each[:, first, second] = each[:, second, first] = sums
        each = each[each[:, d, d] >= 2]
        n, s = each[:, d, d], each[:, d, :d]
        if not len(each):
            return 0, 0, 0, None, None, None
        total = each[:, :d, :d].sum(0)
        within = total - sum(np.outer(a, a) / m for a, m in zip(s, n))
        all_ = total - np.outer(s.sum(0), s.sum(0)) / n.sum()
        g, big = len(each), n.sum()
        use = np.flatnonzero(np.diag(all_) > 1e-12 * np.maximum(np.diag(total), 1e-300))
        fit = max(2, min(len(use), int(big - g - 1)))
        use = use[np.unique(np.linspace(0, len(use) - 1, fit, dtype=int))] if len(use) >= 2 else use
        row = int(big), g, len(use)
        if g < 2 or big <= g + 2 or len(use) < 2:
            return *row, None, None, None
        unit = 1 / np.sqrt(np.diag(all_)[use])
        values, axes = np.linalg.eigh(all_[np.ix_(use, use)] * np.outer(unit, unit))
        axes = (axes[:, values > 1e-10 * values.max()].T * unit).T  # samples that follow from others add nothing
        inner, outer = (np.linalg.eigvalsh(axes.T @ m[np.ix_(use, use)] @ axes) for m in (within, all_))
        logdet, logdet2 = (float(np.log(np.maximum(e, 1e-15 * outer.max())).sum()) for e in (inner, outer))
        wide, wilks, h = axes.shape[1], math.exp(logdet - logdet2), g - 1
        t = math.sqrt((wide * wide * h * h - 4) / (wide * wide + h * h - 5)) if wide * wide + h * h > 5 else 1.0
        df1, df2 = wide * h, (big - 1 - (wide + g) / 2) * t - (wide * h - 2) / 2
        f = (1 - wilks ** (1 / t)) / wilks ** (1 / t) * df2 / df1
        return *row, wilks, float(f), f_tail_value(f, df1, df2) if df2 > 0 else None

    return cells.groupBy(*keys).applyInArrow(solved, schema)


def affine(pairs: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Least-squares line of ``dst`` on ``src`` and its root mean square error."""
    g = pairs.groupBy(*keys).agg(F.regr_count("dst", "src").alias("n"), F.regr_slope("dst", "src").alias("slope"), F.regr_intercept("dst", "src").alias("intercept"), F.regr_syy("dst", "src").alias("syy"), F.regr_r2("dst", "src").alias("r2"))
    return g.where(F.col("n") >= least).select(*keys, "n", "slope", "intercept", F.sqrt(F.greatest(F.col("syy") * (1 - F.col("r2")), F.lit(0.0)) / F.col("n")).alias("rmse"))


def best_shift(left: DataFrame, right: DataFrame, key: str = "session_id", reach: int = 10, first: int = 20, least: int = 5) -> DataFrame:
    """The shift by which the first intervals of two edge trains agree best (least root mean square,
    the smaller shift on ties)."""
    order = W.partitionBy(key).orderBy("t")
    def gaps(x: DataFrame) -> DataFrame:
        return x.select(key, (F.row_number().over(order) - 1).alias("n"), (F.lead("t").over(order) - F.col("t")).alias("gap")).where("gap is not null")

    a = gaps(left).where(F.col("n") < first).withColumn("shift", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    a = a.select(key, "n", "shift", F.col("gap").alias("x"), (F.col("n") + F.col("shift")).alias("m"))
    b = gaps(right).select(key, F.col("n").alias("m"), F.col("gap").alias("y"))
    fit = a.join(b, [key, "m"]).groupBy(key, "shift").agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("rmse")).where(F.col("n") >= least)
    return fit.groupBy(key).agg(F.min_by("shift", F.struct("rmse", "shift")).alias("shift"), F.min("rmse").alias("rmse"))


#: Frames of a block, and edges of one.
SPAN = 1024


def _moments(span: int):
    """A function that gives, of each row's frames (``x``) and the edges from each of its starts on, the count, means
    and centred products."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = [c for c in pdf.columns if c not in ("x", "starts", "y")]
            for row in pdf.to_dict("records"):
                x, starts = np.asarray(row["x"], float), np.asarray(row["starts"], int)
                y = np.pad(np.asarray(row["y"], float), (0, 2 * span), constant_values=np.nan)
                y = np.lib.stride_tricks.sliding_window_view(y, len(x))[starts]
                x = np.broadcast_to(x, y.shape)
                there = ~(np.isnan(x) | np.isnan(y))
                n = there.sum(1)
                some = n > 0
                if not some.any():
                    continue
                x, y, there, n = x[some], y[some], there[some], n[some]
                mx, my = (np.where(there, v, 0).sum(1) / n for v in (x, y))
                dx, dy = np.where(there, x - mx[:, None], 0), np.where(there, y - my[:, None], 0)
                out = {"start": row["_chunk"] * span + starts[some], "n": n, "mx": mx, "my": my, "xx": (dx * dx).sum(1), "yy": (dy * dy).sum(1), "xy": (dx * dy).sum(1)}
                yield pd.DataFrame({c: [row[c]] * len(n) for c in names if c != "_chunk"} | out)

    return run


def _shifted_lines(frames: DataFrame, starts: DataFrame, edges: DataFrame, key: str, least: int) -> DataFrame:
    """As :func:`affine` of the pairs of the n-th frame of a phase (``n, t``) and the edge ``start + n`` (``r, dst``),
    from each start, without a row a pair: blocks of frames meet chunks of starts and the two blocks of edges
    that they can reach, a row gives the moments of all its pairs, and those of a line's blocks are put together."""
    f = frames.groupBy(key, "phase", F.floor(F.col("n") / SPAN).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("x")).withColumn("x", F.transform("x", lambda e: e["t"].cast("double")))
    s = starts.groupBy(key, "segment", "seg_start", F.floor(F.col("start") / SPAN).alias("_chunk")).agg(F.array_sort(F.collect_list(F.pmod("start", F.lit(SPAN)).cast("int"))).alias("starts"))
    at = F.floor(F.col("r") / SPAN)
    e = edges.withColumn("_edge", F.explode(F.array(at, at - 1))).groupBy(key, "segment", "_edge").agg(F.array_sort(F.collect_list(F.struct("r", "dst"))).alias("y"))
    # edges are ranked without gaps: a span starts at its first place, but for the one before the first block
    e = e.where("_edge >= 0").withColumn("y", F.transform("y", lambda v: v["dst"].cast("double")))
    many = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = f.join(s, key).withColumn("_edge", F.col("_block") + F.col("_chunk")).join(e, [key, "segment", "_edge"]).drop("_edge")
    met = met.repartition(many, key, "phase", "segment", "_block", "_chunk")
    names = [key, "phase", "segment", "seg_start", "_block"]
    kept = met.select(*names).schema
    kind = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in kept) + ", start bigint, n bigint, mx double, my double, xx double, yy double, xy double"
    parts = met.select(*names, "_chunk", "x", "starts", "y").mapInPandas(_moments(SPAN), kind)
    line = [key, "phase", "segment", "start", "seg_start"]
    own = F.struct("n", "mx", "my", "xx", "yy", "xy")
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), *[F.lit(0.0).alias(c) for c in ("mx", "my", "xx", "yy", "xy")])

    def added(a: Column, b: Column) -> Column:
        b = b["m"]
        n, dx, dy = a["n"] + b["n"], b["mx"] - a["mx"], b["my"] - a["my"]
        w = a["n"] * b["n"] / n
        return F.struct(n.alias("n"), (a["mx"] + dx * b["n"] / n).alias("mx"), (a["my"] + dy * b["n"] / n).alias("my"), (a["xx"] + b["xx"] + dx * dx * w).alias("xx"), (a["yy"] + b["yy"] + dy * dy * w).alias("yy"), (a["xy"] + b["xy"] + dx * dy * w).alias("xy"))

    m = parts.groupBy(*line).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("_block", own.alias("m")))), zero, added).alias("m")).select(*line, "m.*").where(F.col("n") >= least)
    slope = ratio(F.col("xy"), F.col("xx"))
    unexplained = F.col("yy") * (1 - F.when(F.col("yy") == 0, 1.0).otherwise(F.col("xy") * F.col("xy") / F.col("yy") / F.when(F.col("xx") != 0, F.col("xx"))))
    return m.select(*line, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.sqrt(F.greatest(unexplained, F.lit(0.0)) / F.col("n")).alias("rmse"))


def alignment_candidates(frames: DataFrame, edges: DataFrame, period: int = 30, key: str = "session_id", slopes: tuple[float, float] = (0.98, 1.02), most_intercept: float = 3.0, least_pairs: int = 20) -> DataFrame:
    """Lines from every ``period``-th frame (at each phase) to the edges of each segment from each
    start: ``phase, segment, start, seg_start, n, slope, intercept, rmse``.

    ``edges`` has ``segment`` (W7), or is one.  An edge can only be the first of a line whose
    intercept is within bounds if it comes before ``most_intercept`` (and a quarter second), or is the
    segment's first, so starts are few; pairs are summed up in blocks and are no rows (:func:`_shifted_lines`)."""
    edges = edges if "segment" in edges.columns else edges.withColumn("segment", F.lit(0))
    order = W.partitionBy(key, "segment").orderBy("t")
    e = edges.select(key, "segment", F.col("t").alias("dst"), (F.row_number().over(order) - 1).alias("r"), F.min("t").over(W.partitionBy(key, "segment")).alias("seg_start"))
    starts = e.where((F.col("r") == 0) | (F.col("dst") < most_intercept + 0.25)).select(key, "segment", "seg_start", F.col("r").alias("start"))
    f = frames.select(key, "t", F.pmod("frame", F.lit(period)).alias("phase")).withColumn("n", F.row_number().over(W.partitionBy(key, "phase").orderBy("t")) - 1)
    fit = _shifted_lines(f, starts, e.select(key, "segment", "r", "dst"), key, least_pairs)
    return fit.where(F.col("slope").between(*slopes) & (F.abs("intercept") <= most_intercept))


def phase_alignment(frames: DataFrame, edges: DataFrame, period: int = 30, key: str = "session_id", slopes: tuple[float, float] = (0.98, 1.02), most_intercept: float = 3.0, least_pairs: int = 20, prior: tuple[float, float] = (0.3, 0.25), over_best: float = 1.2, cover: float = 0.95) -> DataFrame:
    """The best line of :func:`alignment_candidates` for each session.

    Of those with a root mean square error within ``over_best`` times the least and ``cover`` of the most
    pairs, the one in the earliest segment, then with the least squared error plus squared deviation of
    its intercept from ``prior`` (mean, width), then the earliest start."""
    c = alignment_candidates(frames, edges, period, key, slopes, most_intercept, least_pairs)
    c = c.withColumn("score", F.col("rmse") * F.col("rmse") + F.pow((F.col("intercept") - prior[0]) / prior[1], F.lit(2)))
    span = W.partitionBy(key)
    c = c.withColumn("_r", F.min("rmse").over(span)).withColumn("_n", F.max("n").over(span)).where((F.col("rmse") <= over_best * F.col("_r")) & (F.col("n") >= F.floor(cover * F.col("_n"))))
    best = span.orderBy("seg_start", "score", "start", "rmse", "phase")
    return c.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "_r", "_n")


def activation(responses: DataFrame, keys: list[str], families: str = "family", least: int = 8, alpha: float = 0.05, exact: int = 50) -> DataFrame:
    """Per trace and family: events, median and mean response, signed-rank p (``least`` events), q
    over the families of a trace, and the class by q and the median's sign."""
    responses = settled(responses.select(*keys, families, "v"))  # read several times below
    stats = responses.groupBy(*keys, families).agg(F.count("v").alias("n_events"), median("v").alias("median"), F.avg("v").alias("mean"))
    test = wilcoxon(responses, [*keys, families], exact=exact).select(*keys, families, "p")
    both = stats.join(test, [*keys, families], "left").withColumn("p", F.when(F.col("n_events") >= least, F.col("p")))
    q = benjamini_hochberg(both, keys, held=None)  # the families of a trace are few
    kind = F.when((F.col("q") < alpha) & (F.col("median") > 0), "activated").when((F.col("q") < alpha) & (F.col("median") < 0), "suppressed").otherwise("no_change")
    return q.withColumn("response_class", kind).withColumn("direction", F.when(F.col("median") > 0, "up").when(F.col("median") < 0, "down").otherwise("none"))


# Sequences.


def sequence_rank(images: DataFrame, keys: list[str]) -> DataFrame:
    """Selectivity of a stimulus (its mean less the mean of the others) and its rank."""
    span = W.partitionBy(*keys)
    others = (F.sum("mean_response").over(span) - F.col("mean_response")) / F.when(F.count("mean_response").over(span) > 1, F.count("mean_response").over(span) - 1)
    s = images.withColumn("selectivity", F.col("mean_response") - others)
    return s.withColumn("image_rank", F.row_number().over(span.orderBy(F.desc_nulls_last("selectivity"), "stimulus")))


def sequence_normalise(rows: DataFrame, keys: list[str], how: str = "max_abs") -> DataFrame:
    """Responses over positions by the first (``r0_abs``) or largest (``max_abs``) one's size."""
    span = W.partitionBy(*keys)
    by = {"r0_abs": F.abs(F.min_by("response", "position").over(span)), "max_abs": F.max(F.abs("response")).over(span), "none": F.lit(1.0)}[how]
    return rows.withColumn("normalised", F.col("response") / F.when(by > 1e-12, by))


def sequence_bins(rows: DataFrame, keys: list[str], bins: int = 3) -> DataFrame:
    """Early, middle and late bins of positions: mean place and mean response by counts."""
    from chronolock.operators.signals import quantile_bin

    span = W.partitionBy(*keys)
    r = rows.withColumn("_r", F.row_number().over(span.orderBy("position")) - 1).withColumn("_n", F.count("*").over(span))
    b = r.withColumn("bin", quantile_bin(F.col("_r"), F.col("_n"), bins))
    return b.groupBy(*keys, "bin").agg(F.avg("position").alias("center"), (F.sum(F.col("n") * F.col("response")) / F.sum("n")).alias("response"), F.sum("n").alias("n"))


def sequence_slopes(binned: DataFrame, keys: list[str], least_slope: float = 0.0, share: float = 0.25) -> DataFrame:
    """Overall, early and late slope over bins, and the pattern's label."""
    order = W.partitionBy(*keys).orderBy("bin")
    step = (F.col("response") - F.lag("response").over(order)) / F.expr("nullif(center - lag(center) over (partition by " + ", ".join(keys) + " order by bin), 0)")
    s = binned.withColumn("step", step)
    g = s.groupBy(*keys).agg(F.regr_slope("response", "center").alias("overall"), F.min_by("step", F.when(F.col("step").isNotNull(), F.col("bin"))).alias("early"), F.max_by("step", F.when(F.col("step").isNotNull(), F.col("bin"))).alias("late"), F.min_by("response", "bin").alias("early_mean"), F.max_by("response", "bin").alias("late_mean"))
    bar = F.greatest(F.lit(least_slope), F.lit(share) * F.greatest(F.abs("early"), F.abs("late"), F.abs("overall")))

    def sign(c: str) -> Column:
        return F.when(F.abs(c) < bar, F.lit(0)).otherwise(F.signum(c).cast("int"))

    e, l_, o = sign("early"), sign("late"), sign("overall")
    any_ = F.when(o != 0, o).when(e != 0, e).otherwise(l_)
    label = F.when((e == 0) & (l_ == 0) & (o == 0), "stable").when(e * l_ < 0, "biphasic").when(any_ > 0, "facilitating").otherwise("adapting")
    return g.withColumn("pattern", label)


def adaptation(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First and last response of each sequence position table and the adaptation index
    (r0 - rlast) / (|r0| + |rlast| + 1e-12)."""
    g = rows.groupBy(*keys).agg(F.min_by("response", "position").alias("r0"), F.max_by("response", "position").alias("rlast"), F.count("*").alias("n_positions"))
    return g.withColumn("index", (F.col("r0") - F.col("rlast")) / (F.abs("r0") + F.abs("rlast") + 1e-12))


def principal_components(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Standardised columns on their ``k`` first components (``scores``), the sign of each such that
    its largest loading is positive; their shares of variance (``explained``), and those added up
    (``cumulative``).

    Rows with a null column have null scores and don't count; constant columns count nothing.  Cross
    products are summed over partitions; one matrix of as many columns is decomposed."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    whole = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(rows.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    n = whole.count()
    if n < 2:
        empty = F.lit(None).cast("array<double>")
        return rows.withColumn("scores", empty).withColumn("explained", empty).withColumn("cumulative", empty)
    scale = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_z").fit(whole)
    made = PCA(k=k, inputCol="_z", outputCol="_s").fit(scale.transform(whole))
    loads = [v * np.sign(v[np.argmax(np.abs(v))]) for v in made.pc.toArray().T]
    width = math.sqrt(n / (n - 1))  # scores are in units of the population's deviation
    z = [(F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s) if s else 1.0) * F.lit(width if s else 0.0) for c, m, s in zip(columns, scale.mean.toArray(), scale.std.toArray())]
    z = F.when(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0, F.array(*z))
    share = made.explainedVariance.toArray()

    def constant(x: np.ndarray) -> Column:
        return F.array(*[F.lit(float(y)) for y in x])

    scores = F.when(z.isNotNull(), F.array(*[F.aggregate(F.zip_with(z, constant(v), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for v in loads]))
    return rows.withColumn("scores", scores).withColumn("explained", constant(share)).withColumn("cumulative", constant(np.cumsum(share)))


def regress_out(rows: DataFrame, keys: list[str], y: str, xs: list[str], ridge: float = 1e-6, least: int = 10) -> DataFrame:
    """``residual`` of ``y`` on columns ``xs`` with an intercept, by ridge regression (none on the
    intercept); ``y`` itself where rows are too few.  Sums in Spark, one small solve a key."""
    terms = [F.lit(1.0), *map(F.col, xs)]
    d = len(terms)
    ok = F.col(y).isNotNull()
    for x in xs:
        ok &= F.col(x).isNotNull()
    aggs = [F.sum(F.when(ok, a * b)).alias(f"c{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j] + [F.sum(F.when(ok, a * F.col(y))).alias(f"y{i}") for i, a in enumerate(terms)]
    sums = rows.groupBy(*keys).agg(F.count(F.when(ok, 1)).alias("n"), *aggs)
    names = [f"c{i}_{j}" for i in range(d) for j in range(d) if i <= j] + [f"y{i}" for i in range(d)]

    @F.pandas_udf("array<double>")
    def solve(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for n, *cols in parts:
            out = []
            for row in zip(n, *cols):
                if row[0] < max(least, d + 1) or any(x is None or x != x for x in row[1:]):
                    out.append([0.0] * d)
                    continue
                at = dict(zip(names, row[1:]))
                m = np.array([[at[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) + ridge * np.diag([0.0] + [1.0] * (d - 1))
                out.append(np.linalg.solve(m, [at[f"y{i}"] for i in range(d)]).tolist())
            yield pd.Series(out)

    fits = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], solve("n", *names).alias("_beta"))
    both = rows.join(fits, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    fitted = sum((F.col("_beta")[i] * t for i, t in enumerate(terms)), F.lit(0.0))
    return both.withColumn("residual", F.col(y) - fitted).drop("_beta", *[f"_{k}" for k in keys])
