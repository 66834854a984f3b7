"""Sequences meet traces as places, and pieces of traces are summed up by position."""

from __future__ import annotations

import contextlib
import io
import math
import random
import re

import pytest

import __spark_entry__
from chronolock.operators import sequences as sq
from chronolock.operators import windows as wn

PRE, POST = 3, 5


@pytest.fixture(scope="module")
def parts(spark):
    """Traces with gaps (one hides a whole window), nulls, a sample twice and short ones; sequences that leave some."""
    rng = random.Random(3)
    t = [(s, r, i, None if rng.random() < 0.1 else 1e4 + rng.gauss(0, 50)) for s in (1, 2) for r in range(4) for i in range({0: 160, 1: 160, 2: 70, 3: 7}[r]) if r != 1 or (i % 11 and not 60 <= i < 75)]
    t += [(1, 0, 33, 3.0), (1, 0, 33, 4.0), (1, 0, 34, None)]
    images = [(s, e, 5 * e + 5) for s in (1, 2) for e in range(30)]
    q = []
    for s in (1, 2):
        for n, (a, b) in enumerate([(2, 6), (6, 7), (7, 15), (15, 29)], 1):
            q += [(s, n, "prechange", p, a - 2 + p) for p in (0, 1)] + [(s, n, "repeated", e - a, e) for e in range(a, b)] + [(s, n, "terminal", 0, b)]
    return spark.createDataFrame(t, "session_id int, roi int, i int, v double").repartition(5), spark.createDataFrame(images, "session_id int, event_idx int, c int"), spark.createDataFrame(q, "session_id int, seq_id bigint, category string, position int, event_idx int")


def by_hand(parts):
    """Mean, deviation and sequences of each cell, from rows in plain Python."""
    traces, images, sequences = (p.collect() for p in parts)
    at = {(r.session_id, r.event_idx): r.c for r in images}
    series, cells = {}, {}
    for r in traces:
        series.setdefault((r.session_id, r.roi), []).append((r.i, r.v))
    for (s, roi), own in series.items():
        low, high = min(own)[0], max(i for i, _ in own)
        names = sorted({(q.seq_id, q.category) for q in sequences if q.session_id == s})
        for seq, category in names:
            there = []
            for q in sorted((q for q in sequences if (q.session_id, q.seq_id, q.category) == (s, seq, category)), key=lambda q: q.position):
                a = at[s, q.event_idx] - PRE
                found = [(i - a, v) for i, v in own if a <= i < a + PRE + POST]
                if found and low <= a and a + PRE + POST - 1 <= high:
                    there.append((q.position, found))
            if category == "prechange" and len(there) < 2:
                continue
            for n, (position, found) in enumerate(there):
                for k, v in found:
                    cells.setdefault((s, roi, category, {"terminal": 999, "repeated": n, "prechange": position}[category], k), []).append((seq, v))
    return cells


@pytest.mark.parametrize("piece", [1, 20, 1024])
def test_curves_are_those_of_the_samples(spark, parts, monkeypatch, piece):
    monkeypatch.setattr(sq, "PIECE", piece)
    want = by_hand(parts)
    got = {tuple(r)[:5]: r for r in sq.sequence_curves(*parts, PRE, POST).collect()}
    assert got.keys() == want.keys() and len(want) > 300
    for cell, rows in want.items():
        v = [x for _, x in rows if x is not None]
        r = got[cell]
        assert r.n == len({q for q, x in rows if x is not None})
        assert (r["mean"] is None) == (r["std"] is None) == (not v)
        if v:
            m = sum(v) / len(v)
            assert abs(r["mean"] - m) < 1e-8 and abs(r["std"] - math.sqrt(sum((x - m) ** 2 for x in v) / len(v))) < 1e-8


def test_samples_are_those_of_windows_by_rows(spark, parts):
    traces, images, sequences = parts
    names = ["session_id", "roi", "seq_id", "category", "position", "k", "v"]
    windows = wn.event_windows(traces, images, PRE, POST)
    rows = sorted(map(tuple, sq.sequence_windows(windows, sequences).select(names).collect()), key=str)
    assert rows == sorted(map(tuple, sq.sequence_samples(*parts, PRE, POST).select(names).collect()), key=str)
    want = by_hand(parts)
    assert sorted(((*r[:2], *r[3:6]), (r[2], r[6])) for r in rows if r[6] is not None) == sorted((c, x) for c, xs in want.items() for x in xs if x[1] is not None)


def test_no_sample_of_a_window_moves(spark):
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        __spark_entry__.queries()["a2_sequence_summary"](spark, "/root/testdata/sf0.001").explain()
    moves = re.findall(r"hashpartitioning\(([^)]*)\)", plan.getvalue())
    assert moves and not any(re.search(r"\bk#", m) for m in moves)
