"""Windows of a row each give what their samples give, and no row moves to be put together."""

from __future__ import annotations

import contextlib
import io
import random
import re

from pyspark.sql import functions as F

import __spark_entry__
from chronolock.operators import responses, statistics, windows
from chronolock.operators.composites import analyse

KEYS = ["session_id", "roi"]


def test_whole_windows_give_what_samples_give(spark, monkeypatch):
    monkeypatch.setattr(windows, "WHOLE", 32)
    rng = random.Random(4)
    t = [(1, r, i, None if rng.random() < 0.02 else rng.gauss(r * (i % 5), 1)) for r in (1, 2, 3) for i in range(0, 700) if r == 1 or (i % 50 and not 300 <= i < 340)] + [(1, 2, 52, 0.25), (None, 1, 3, 1.0), (2, 1, 5, 1.0)]
    e = [(1, n, "im" + str(n % 4), 5 * n) for n in range(140)] + [(2, 0, "im0", 5), (1, 200, "im1", None)]
    traces = spark.createDataFrame(t, "session_id int, roi int, i int, v double").repartition(3)
    events = spark.createDataFrame(e, "session_id int, event_id int, stimulus string, c int")
    rows, whole = windows.event_windows(traces, events, 10, 20), windows.whole_windows(traces, events, 10, 20)
    names = [*KEYS, "event_id", "stimulus"]
    flat = whole.selectExpr(*names, "inline(samples)")
    assert sorted(map(tuple, flat.collect()), key=str) == sorted(map(tuple, rows.select(*names, "k", "v").collect()), key=str)
    want = {tuple(r)[:4]: r for r in responses.event_responses(rows, (0, 10), (10, 30), names).collect()}
    got = {tuple(r)[:4]: r for r in responses.event_responses(whole, (0, 10), (10, 30), names).collect()}
    assert got.keys() == want.keys() and len(got) > 300
    for k, r in want.items():
        for c in ("delta_auc", "delta_mean"):
            assert (got[k][c] is None) == (r[c] is None) and (r[c] is None or abs(got[k][c] - r[c]) < 1e-9)
    only = spark.createDataFrame([(1, r, f"im{n}") for r in (1, 2) for n in range(3)], "session_id int, roi int, stimulus string")
    for tested in (None, only):
        a, b = ({(r.session_id, r.roi): r for r in statistics.manova(w, KEYS, s, event="event_id", only=tested).collect()} for w, s in ((rows, None), (whole, statistics.spaced(30))))
        assert a.keys() == b.keys() and len(a) == (3 if tested is None else 2)
        for k, r in a.items():
            assert (r.n, r.groups, r.used) == (b[k].n, b[k].groups, b[k].used) and abs(r.wilks - b[k].wilks) < 1e-9 and abs(r.p - b[k].p) < 1e-9
    joined = {r.roi: r for r in statistics.manova(rows.join(only, [*KEYS, "stimulus"], "left_semi"), KEYS, event="event_id").collect()}
    assert all(abs(joined[k[1]].wilks - r.wilks) < 1e-9 and joined[k[1]].n == r.n for k, r in a.items())


def test_no_window_moves_for_its_response(spark):
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        __spark_entry__.queries()["a4_event_responses"](spark, "/root/testdata/sf0.001").explain()
    moves = re.findall(r"hashpartitioning\(([^)]*)\)", plan.getvalue())
    assert moves and not any("event_id#" in m and "stimulus#" in m for m in moves)


def test_an_analysis_of_whole_windows_is_that_of_their_samples(spark):
    rng = random.Random(9)
    t = [(1, r, i, rng.gauss(0, 1) + (3 * ((i // 5) % 4) if r == 1 else 0)) for r in (1, 2) for i in range(300)]
    traces = spark.createDataFrame(t, "session_id int, roi int, i int, v double")
    events = spark.createDataFrame([(1, n, "im" + str(n % 4), 5 * n) for n in range(60)], "session_id int, event_id int, stimulus string, c int")
    activation = spark.createDataFrame([(1, 1, "image", "activated"), (1, 2, "image", "no_change")], "session_id int, roi int, family string, response_class string")
    made = []
    for w in (windows.event_windows(traces, events, 2, 5), windows.whole_windows(traces, events, 2, 5)):
        got = analyse(w.withColumn("family", F.lit("image")), (0, 2), (2, 7), 19, activation=activation)["tuning_summary"]
        made.append([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got.collect()])
    assert made[0] == made[1] and len(made[0]) == 1 and made[0][0][1] == 1
