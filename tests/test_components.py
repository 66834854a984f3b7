"""Components of wide rows and of sessions against plain decompositions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chronolock.operators import components as cp


def test_wide_rows_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 200)) + 0.3 * rng.normal(size=(80, 200)) + 50
    x[:, 7] = 4.0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(98, [None] + [1.0] * 199), (99, None)]
    df = spark.createDataFrame(rows, "id int, x array<double>").repartition(5)
    fitted = cp.fit_wide(df, 5)
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), np.inf)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert fitted.n == 80 and fitted.scale[7] == 0
    assert np.abs(fitted.shares - s[:5] ** 2 / (s**2).sum()).max() < 1e-6
    got = {r.id: r.scores for r in cp.scores(df, fitted).collect()}
    assert got[98] is None and got[99] is None
    for k in range(5):
        v = vt[k] * np.sign(vt[k][np.abs(vt[k]).argmax()])
        assert np.allclose(fitted.loads[:, k], v, atol=1e-4) and np.allclose([got[i][k] for i in range(80)], z @ v, atol=1e-2)
    assert cp.fit_wide(df.limit(0), 2) is None and cp.fit_wide(df.where("id = 1"), 2) is None
    flat = cp.fit_wide(spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0],)], "x array<double>"), 2)
    assert flat.loads.shape == (2, 0)


def test_twenty_thousand_columns(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(2, 20_000))
    df = spark.createDataFrame([([float(v) for v in a * base[0] + b * base[1]],) for a, b in rng.normal(size=(24, 2))], "x array<double>")
    fitted = cp.fit_wide(df, 3)
    assert len(fitted.shares) == 2 and abs(fitted.shares.sum() - 1) < 1e-9


def test_first_component_in_time(spark, monkeypatch):
    monkeypatch.setattr(cp, "PIECE", 30)
    rng = np.random.default_rng(7)
    held = {s: np.sin(np.arange(100) / (4 + s))[None, :] * rng.normal(size=(6, 1)) * 3 + rng.normal(size=(6, 100)) for s in (1, 2)}
    rows = [(s, r, i, None if (s, r, i) == (1, 2, 5) else float(v)) for s, x in held.items() for r, row in enumerate(x) for i, v in enumerate(row)]
    rows += [(3, r, i, 1.0) for r in range(2) for i in range(10)]
    trace, order = cp.first_component(spark.createDataFrame(rows, "session_id int, roi int, i int, v double"), ["session_id"], 0.0)
    got = {(r.session_id, r.i): r.trace for r in trace.collect()}
    places = {(r.session_id, r.roi): (r.score, r.place) for r in order.collect()}
    for s, x in held.items():
        x = x.copy()
        if s == 1:
            x[2, 5] = np.median(np.delete(x[2], 5))
        x -= x.mean(0)
        u, d, vt = np.linalg.svd(x, full_matrices=False)
        sign = np.sign(u[np.abs(u[:, 0]).argmax(), 0])
        assert np.allclose([got[s, i] for i in range(100)], sign * vt[0], atol=1e-9)
        score = sign * u[:, 0] * d[0]
        assert np.allclose([places[s, r][0] for r in range(6)], score, atol=1e-9)
        assert [places[s, r][1] for r in np.argsort(-score)] == [1, 2, 3, 4, 5, 6]
    assert all(got[3, i] == 0 for i in range(10))


def test_first_component_of_more_traces_than_samples(spark, monkeypatch):
    """A matrix of samples by samples is decomposed; none of traces by traces."""
    monkeypatch.setattr(cp, "PIECE", 16)
    rng = np.random.default_rng(3)
    held = {s: np.outer(rng.normal(size=n), np.sin(np.arange(m) / 3)) * 2 + rng.normal(size=(n, m)) for s, n, m in ((1, 60, 20), (2, 20, 60), (3, 20, 20))}
    rows = [(s, r, i, float(v)) for s, x in held.items() for r, row in enumerate(x) for i, v in enumerate(row)] + [(4, r, i, 2.0) for r in range(6) for i in range(3)]
    made, real = [], cp._gram

    def seen(*a):
        made.append(real(*a))
        return made[-1]

    monkeypatch.setattr(cp, "_gram", seen)
    trace, order = cp.first_component(spark.createDataFrame(rows, "session_id int, roi int, i int, v double"), ["session_id"], 0.0)
    assert {(r.session_id, r.n) for g in made for r in g.groupBy("session_id").agg(F.count("*").alias("n")).collect()} == {(1, 20), (2, 20), (3, 20), (4, 3)}
    got = {(r.session_id, r.i): r.trace for r in trace.collect()}
    places = {(r.session_id, r.roi): (r.score, r.place) for r in order.collect()}
    for s, x in held.items():
        x = x - x.mean(0)
        u, d, vt = np.linalg.svd(x, full_matrices=False)
        sign = np.sign(u[np.abs(u[:, 0]).argmax(), 0])
        assert np.allclose([got[s, i] for i in range(x.shape[1])], sign * vt[0], atol=1e-9)
        score = sign * u[:, 0] * d[0]
        assert np.allclose([places[s, r][0] for r in range(len(x))], score, atol=1e-9)
        assert [places[s, r][1] for r in np.argsort(-score)] == list(range(1, len(x) + 1))
    assert all(got[4, i] == 0 for i in range(3)) and all(places[4, r] == (0, r + 1) for r in range(6))
