"""Windows over long sessions: a frame that ends at the last row is added up anew for every row."""

from __future__ import annotations

import contextlib
import io
import random

import numpy as np
import pytest

from chronolock.functions.ranking import suffix_least
from chronolock.operators import events, signals, statistics, trees, windows


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue().lower()


@pytest.fixture(scope="module")
def log(spark):
    values = ["a.tiff", "ChangeFlash", "Frame", "ChangeFlash", "b.tiff", "Frame", "c.tiff", "ChangeFlash"]
    return spark.createDataFrame([(s, i, float(i), v) for s in (1, 2) for i, v in enumerate(values)], "session_id int, row_idx long, t double, value string")


def test_no_frame_shrinks(spark, log):
    frames = log.where("value = 'Frame'").selectExpr("session_id", "t", "row_idx as i")
    series = spark.createDataFrame([("k", 0, None), ("k", 1, 2.0), ("k", 2, None), ("k", 3, 4.0)], "k string, i int, v double")
    made = [windows.lower_bound_centers(log, frames), events.change_targets(log), events.change_sequences(log), signals.fill_runs(series, ["k"]), suffix_least(series, ["k"], "i", "v", None)]
    for df in made:
        assert "currentrow$(), unboundedfollowing$()" not in plan(df) and "1, unboundedfollowing$()" not in plan(df)


def test_the_next_row_is_found_from_the_last_back(spark, log):
    frames = log.where("value = 'Frame'").selectExpr("session_id", "t", "row_idx as i")
    got = windows.lower_bound_centers(log, frames).where("session_id = 1").orderBy("row_idx").collect()
    assert [r.c for r in got] == [2, 2, 2, 5, 5, 5, None, None]
    targets = events.change_targets(log).where("session_id = 2").collect()
    assert [(r.row_idx, r.onset, r.value, r.n_changes) for r in targets] == [(4, 4.0, "b.tiff", 2)]


def test_windows_are_cut_from_pieces(spark):
    """Gaps, a sample twice, spans over several pieces and events far beyond every trace, against plain Python."""
    import random

    rng = random.Random(5)
    t = [(1, r, i, rng.random()) for r in (1, 2) for i in range(5, 900) if r == 1 or i % 7] + [(1, 2, 50, 0.25), (2, 1, -3, 1.0), (2, 1, -2, None)]
    e = [(s, n, rng.randrange(-20, 1000)) for s in (1, 2) for n in range(60)] + [(2, 99, -2), (1, 100, 10**6), (1, 101, None)]
    traces = spark.createDataFrame(t, "session_id int, roi int, i int, v double")
    spans = spark.createDataFrame(e, "session_id int, event_id int, c int")
    for pre, post in ((1, 1), (10, 20), (150, 200)):
        got = windows.event_windows(traces, spans, pre, post)
        assert got.columns == ["session_id", "roi", "i", "v", "event_id", "k"]
        want = []
        for s, n, c in e:
            for r in {x[1] for x in t if x[0] == s}:
                own = [x for x in t if x[:2] == (s, r)]
                if c is not None and c - pre >= min(x[2] for x in own) and c + post - 1 <= max(x[2] for x in own):
                    want += [(s, r, i, v, n, i - c + pre) for *_, i, v in own if c - pre <= i < c + post]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want


def test_events_do_not_meet_traces_they_cannot_reach(spark):
    """A join on the session alone makes a pair of each event and trace; this one has the piece in its key."""
    traces = spark.createDataFrame([(1, 1, 0, 1.0)], "session_id int, roi int, i int, v double")
    got = plan(windows.event_windows(traces, spark.createDataFrame([(1, 1, 0)], "session_id int, event_id int, c int"), 0, 1))
    joins = [x for x in got.split("== physical plan ==")[1].splitlines() if "join " in x]
    assert joins and all("_piece" in x for x in joins)


def test_a_value_on_the_middle_is_not_above_it_by_rounding(spark):
    """In doubles (0.01 + 0.09) / 2 is a bit under 0.05."""
    m = [0.01] * 12 + [0.05] * 12 + [0.09] * 12
    got = signals.edges(spark.createDataFrame([("k", i, float(i), x) for i, x in enumerate(m)], "k string, i int, t double, v double"), ["k"], half=0)
    assert [(r.i, r.step) for r in got.collect()] == [(24, 1)]


def test_sholl_does_not_list_the_radii_of_an_edge(spark):
    """Two edges that cross 50,000 spheres each; their crossings are running sums of edges' ends."""
    n = [(1, 0, -1, 0.0), (1, 1, 0, 100_000.5), (1, 2, 1, 3.0), (1, 3, 2, 3.5), (2, 0, -1, 0.0), (2, 1, 0, 4.0)]
    nodes = spark.createDataFrame([(k, i, p, x, 0.0, 0.0) for k, i, p, x in n], "neuron_id int, node_id int, parent_id int, x double, y double, z double")
    for held in (1 << 21, 1):
        got = trees.sholl(nodes, 2.0, held)
        seen = {(r.neuron_id, r.radius): r.crossings for r in got.collect()}
        assert seen == {(1, 2.0 * k): (1 if k < 2 else 2 if k < 50_001 else 0) for k in range(50_002)} | {(2, 0.0): 1, (2, 2.0): 1, (2, 4.0): 0}
    assert "sequence(ceil" not in plan(trees.sholl(nodes, 2.0))


def test_lines_of_many_starts_have_no_row_a_pair(spark, monkeypatch):
    """J10 in blocks of 8 against lines of listed pairs; some times are missing."""
    monkeypatch.setattr(statistics, "SPAN", 8)
    rng = random.Random(2)
    frames = [(s, 0.05 * i + rng.random() / 90, i) for s in (1, 2) for i in range(90)] + [(1, None, 4)]
    edges = [(s, g, 0.1 * i + rng.random() / 30) for s in (1, 2) for g in (0, 1) for i in range(50 - 20 * g)]
    f, e = spark.createDataFrame(frames, "session_id int, t double, frame long"), spark.createDataFrame(edges, "session_id int, segment int, t double")
    df = statistics.alignment_candidates(f, e, 2, slopes=(0.2, 3.0), least_pairs=3)
    got = {(r.session_id, r.phase, r.segment, r.start): r for r in df.collect()}
    want = {}
    for s in (1, 2):
        for p in (0, 1):
            x = sorted((t for k, t, i in frames if k == s and i % 2 == p), key=lambda t: (t is not None, t or 0))
            for g in (0, 1):
                y = sorted(t for k, h, t in edges if (k, h) == (s, g))
                for start in range(len(y)):
                    two = [(a, b) for a, b in zip(x, y[start:]) if a is not None]
                    if len(two) >= 3 and (start == 0 or y[start] < 3.25):
                        (slope, intercept), left, *_ = np.polyfit(*zip(*two), 1, full=True)
                        if 0.2 <= slope <= 3.0 and abs(intercept) <= 3:
                            want[s, p, g, start] = (len(two), slope, intercept, (left[0] / len(two)) ** 0.5, y[0])
    assert got.keys() == want.keys() and len(want) > 100
    for k, w in want.items():
        assert np.allclose([got[k].n, got[k].slope, got[k].intercept, got[k].rmse, got[k].seg_start], w, atol=1e-9)
    assert "regr_slope" not in plan(df)
