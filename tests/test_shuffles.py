"""T5: shuffles of keys in pieces."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np

from chronolock.operators import statistics as st


def test_pieces_share_out_all_labels():
    counts, n = np.array([30, 1, 26]), 57
    for size in (8, 16, 57, 100):
        pieces = -(-n // size)
        got = [st.labels_dealt(counts, n, p, size, [3, 4], 1, 40) for p in range(pieces)]
        assert (sum(got) == counts).all() and all((g >= 0).all() for g in got)
        assert [int(g[0].sum()) for g in got] == [min(size, n - p * size) for p in range(pieces)]
        assert (got[-1].sum(1) == n - (pieces - 1) * size).all()


def test_all_orders_are_equally_likely():
    """Four events in pieces of two, labels a, b, b, c: twelve orders."""
    counts, shuffles = np.array([1, 2, 1]), 24000
    orders = [[] for _ in range(shuffles)]
    for piece in (0, 1):
        have = st.labels_dealt(counts, 4, piece, 2, [0], 0, shuffles)
        marks = st.sums_by_label(np.array([1.0, 2.0]), have, piece, [0], 0)  # which of the two a label got
        for s in range(shuffles):
            where = {}
            for g in range(3):
                for x in {0.0: (), 1.0: (1,), 2.0: (2,), 3.0: (1, 2)}[marks[s, g]]:
                    where[x] = g
            orders[s] += [where[1], where[2]]
    seen = Counter(map(tuple, orders))
    assert len(seen) == 12 and max(abs(c - 2000) for c in seen.values()) < 250


def plain_sums(v, labels, size, seed, block, shuffles):
    """Each label's sum under each shuffle, with the labels of the whole key laid out event by event."""
    counts, n = np.bincount(labels), len(v)
    out = np.zeros((shuffles, len(counts)))
    for piece in range(-(-n // size)):
        own = v[piece * size : (piece + 1) * size]
        have = st.labels_dealt(counts, n, piece, size, seed, block, shuffles)
        rng = np.random.default_rng([*seed, 1, block, piece])
        for s in range(shuffles):
            dealt = rng.permuted(own)
            for label, x in zip(np.repeat(np.arange(len(counts)), have[s]), dealt):
                out[s, label] += x
    return out


def test_p_is_that_of_the_plain_shuffles(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, rng.choice("abc"), e, rng.gauss(0, 1) + 1e6 + (0.8 if k == "y" and e % 3 == 0 else 0)) for k, n in (("x", 90), ("y", 60), ("z", 2), ("w", 1)) for e in range(n)]
    rows += [("x", None, 200, 1.0), ("x", "a", 201, None), ("x", "a", 5, 1e6), ("x", "a", 5, 1e6), ("v", "a", 1, 2.0), ("v", "a", 2, 2.0)]
    df = spark.createDataFrame(rows, "k string, stimulus string, event_id int, v double").repartition(3)
    for size, held in ((1 << 16, 10**9), (16, 20)):
        monkeypatch.setattr(st, "PIECE", size)
        got = {r.k: (r.n, r.fve, r.p) for r in st.permutation_fve(df, ["k"], 300, held=held).collect()}
        assert set(got) == set("xyzwv")
        for k in got:
            own = sorted((e, v, g) for key, g, e, v in rows if key == k and g is not None and v is not None)
            names = sorted({g for *_, g in own})
            codes = np.array([names.index(g) for *_, g in own])
            v = np.array([x for _, x, _ in own])
            v -= v.mean()
            counts = np.bincount(codes)
            total, seen = float(v @ v), float((np.bincount(codes, v) ** 2 / counts).sum())
            seed = [0, zlib.crc32(k.encode())]
            between = np.concatenate([(plain_sums(v, codes, size, seed, block, m) ** 2 / counts).sum(1) for block, m in ((0, 250), (1, 50))])
            reached = int((between >= seen - 1e-12 * max(total, 1)).sum())
            assert got[k][0] == len(own) and abs(got[k][2] - (1 + reached) / 301) < 1e-12
            assert abs(got[k][1] - (seen / total if total > 1e-12 else 0)) < 1e-6


def test_p_is_near_that_of_true_shuffles(spark):
    rng = np.random.default_rng(5)
    v, g = rng.normal(size=60), np.arange(60) % 4
    v[g == 1] += 0.55
    df = spark.createDataFrame([("k", int(a), i, float(x)) for i, (a, x) in enumerate(zip(g, v))], "k string, stimulus int, event_id int, v double")
    p = st.permutation_fve(df, ["k"], 8000).first().p
    c = v - v.mean()

    def share(x):
        return (np.bincount(g, x) ** 2 / 15).sum()

    true = np.mean([share(rng.permutation(c)) >= share(c) for _ in range(8000)])
    assert abs(p - true) < 0.02


def test_shares_of_variance_need_no_windows(spark, monkeypatch):
    """T16 by ``fve``: no MANOVA, for which each window would move a second time."""
    from chronolock.operators import composites

    def asked(*_, **__):
        raise AssertionError("MANOVA was asked for")

    monkeypatch.setattr(composites.st, "manova", asked)
    w = spark.createDataFrame([(1, 1, "image", e, f"im{e % 4}", k, float(k * (e % 4) + e % 3)) for e in range(24) for k in range(2)], "session_id int, roi int, family string, event_id int, stimulus string, k int, v double")
    known = spark.createDataFrame([(1, 1, "image", "activated")], "session_id int, roi int, family string, response_class string")
    got = composites.analyse(w, (0, 1), (1, 2), 19, method="fve", activation=known)["tuning_summary"].first()
    assert got.n_images == 4 and got.preferred == "im3" and abs(got.fve - 1) < 1e-12
