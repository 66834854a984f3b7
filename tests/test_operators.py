"""Hand-made cases at the edges of the operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolock import sources, streaming
from chronolock.functions import average_rank, finite
from chronolock.operators import baselines, events, pixels, quality, registry, responses, signals, statistics, trees, windows


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is None, x) for x in t))


def log(spark, values, session=1):
    return spark.createDataFrame([(session, i, float(i), v) for i, v in enumerate(values)], "session_id int, row_idx long, t double, value string")


def test_empty_window_sums_to_zero_but_has_no_mean(spark):
    w = spark.createDataFrame([(1, k, None) for k in range(6)] + [(2, k, float(k)) for k in range(6)], "event_id int, k int, v double")
    got = responses.event_responses(w, (0, 3), (3, 6), ["event_id"])
    assert rows(got, "event_id", "delta_auc", "delta_mean") == [(1, 0.0, None), (2, 9.0, 3.0)]


def test_half_samples_round_to_even(spark):
    e = spark.createDataFrame([(1.25,), (1.75,)], "t double")
    assert sorted(r.c for r in windows.centers(e, 2.0).collect()) == [2, 4]


def test_windows_that_leave_the_trace_are_dropped(spark):
    t = spark.createDataFrame([(1, 1, i, float(i)) for i in range(10)], "session_id int, roi int, i int, v double")
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 8), (1, 3, 9)], "session_id int, event_id int, c int")
    got = windows.event_windows(t, e, 2, 2)
    assert sorted({r.event_id for r in got.collect()}) == [1, 2]
    assert rows(got.where("event_id = 1"), "k", "v") == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0)]


def test_epochs_are_closed_and_vanish_when_shrunk(spark):
    epochs = spark.createDataFrame([(1, 0.0, 10.0), (1, 20.0, 21.0)], "session_id int, start_time double, end_time double")
    e = spark.createDataFrame([(1, 2.0), (1, 1.9), (1, 7.0), (1, 7.1), (1, 20.5)], "session_id int, t double")
    assert rows(windows.in_epochs(e, epochs, 2.0, 3.0), "t") == [(2.0,), (7.0,)]


def test_change_targets_and_sequences(spark):
    one = log(spark, ["ChangeFlash", "ChangeFlash", "a.tiff", "b.tiff"])
    assert rows(events.change_targets(one), "row_idx", "n_changes") == [(2, 2)]
    early = log(spark, ["a.tiff", "ChangeFlash", "b.tiff", "c.tiff"])
    assert events.change_sequences(early).count() == 0  # the target is image 1
    full = log(spark, ["a.tiff", "b.tiff", "ChangeFlash", "c.tiff", "c.tiff", "ChangeFlash", "d.tiff", "e.tiff"])
    got = rows(events.change_sequences(full), "seq_id", "category", "position", "event_idx")
    assert got == [(1, "prechange", 0, 0), (1, "prechange", 1, 1), (1, "repeated", 0, 2), (1, "repeated", 1, 3), (1, "terminal", 0, 4), (2, "prechange", 0, 2), (2, "prechange", 1, 3), (2, "repeated", 0, 4), (2, "repeated", 1, 5), (2, "terminal", 0, 5)]


def test_first_rows_are_added_once(spark):
    one = events.first_stimulus_rows(log(spark, ["Frame", "a.tiff"]))
    assert one.count() == 4 and events.first_stimulus_rows(one).count() == 4
    assert events.first_stimulus_rows(log(spark, ["Frame"])).count() == 1


def test_families_and_labels(spark):
    values = ["x/a.TIF", "photodiode.tiff", "Change", "ChangeFlash", "OmissionX", "gray", "lick", None]
    got = {r.value: r.family for r in events.classify(log(spark, values)).collect()}
    assert got == {"x/a.TIF": "image", "photodiode.tiff": "other", "Change": "change", "ChangeFlash": "change", "OmissionX": "omission", "gray": "other", "lick": None, None: None}
    d = spark.createDataFrame([("stimuli\\set\\im061.tiff",), ("a/very_long_name_of_an_image.tif",)], "value string")
    assert rows(d.select(events.stimulus_label().alias("l")), "l") == [("im061",), ("very_long_name_of_an_image",)]
    assert max(len(r.s) for r in d.select(events.short_label().alias("s")).collect()) == 18


def test_debounce_keeps_what_is_far_from_the_last_kept(spark):
    d = spark.createDataFrame([(1, 0.0), (1, 0.004), (1, 0.008)], "session_id int, t double")
    assert rows(signals.debounce(d, "session_id", 0.005), "t") == [(0.0,), (0.008,)]


def test_average_ranks_share_ties(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 5.0), (1, None)], "k int, v double")
    assert rows(d.select((average_rank("v", "k") / 4).alias("p")), "p") == [(0.25,), (0.625,), (0.625,), (1.0,), (None,)]


def test_false_discovery_skips_nulls(spark):
    d = spark.createDataFrame([(1, 0.01), (1, None), (1, 0.04)], "k int, p double")
    assert [(p, q and round(q, 10)) for p, q in rows(statistics.benjamini_hochberg(d, ["k"]), "p", "q")] == [(0.01, 0.02), (0.04, 0.04), (None, None)]


def test_first_short_segment_stays(spark):
    times = [0.0, 0.5, 1.0] + [100 + 0.5 * i for i in range(200)] + [500.0, 500.5]
    d = spark.createDataFrame([(1, t) for t in times], "session_id int, t double")
    assert rows(signals.train_segments(d, "session_id"), "segment", "n_edges") == [(0, 3), (1, 200)]


def test_null_metrics_fail_in_order(spark):
    d = spark.createDataFrame([(1, None, None, 0.01), (2, 1.0, 1.0, None)], "roi int, finite double, snr double, drift double")
    got = rows(quality.threshold_checks(d, {"finite": 0.5, "snr": 0.5}, {"drift": 0.05}), "roi", "keep", "fail_reasons")
    assert got == [(1, False, "finite;snr"), (2, False, "drift")]


def test_exclusion_keeps_nulls(spark):
    d = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, None, "x"), (3, 1, "b", "x")], "session_id int, subject_id int, session_type string, quality string")
    assert rows(registry.select_sessions(d, excluded_types=["a"]), "session_id") == [(2,), (3,)]


def test_words_and_numbers(spark):
    d = spark.createDataFrame([("DMD2",), ("1.0",), ("1",), ("x",), (None,)], "s string")
    assert [r.n for r in d.select(registry.plane_number(F.col("s")).alias("n")).collect()] == [2, 1, 1, None, None]
    q = spark.createDataFrame([(" Good",), ("bad",), (None,), ("odd",)], "s string")
    assert [r.n for r in q.select(registry.quality_word(F.col("s")).alias("n")).collect()] == ["good", "poor", "unknown", "odd"]
    c = spark.createDataFrame([("jRCaMP1b",), ("iGluSnFR",), (None,)], "s string")
    assert [r.n for r in c.select(registry.is_indicator(F.col("s")).alias("n")).collect()] == [True, False, False]
    h = spark.createDataFrame([("green",), ("2",), ("Calcium",), ("?",)], "s string")
    assert [r.n for r in h.select(registry.channel_number(F.col("s")).alias("n")).collect()] == [0, 1, 1, None]


def forest(spark, pairs):
    return spark.createDataFrame([(1, n, p, float(n), 0.0, 0.0) for n, p in pairs], "neuron_id int, node_id int, parent_id int, x double, y double, z double")


def test_every_tree_of_a_forest_is_walked(spark):
    n = forest(spark, [(0, -1), (1, 0), (2, 1), (3, 1), (10, -1), (11, 10), (12, 10)])
    assert rows(trees.branch_orders(n), "node_id", "branch_order") == [(0, 0), (1, 0), (2, 1), (3, 1), (10, 0), (11, 1), (12, 1)]
    assert rows(trees.path_lengths(n), "node_id", "root", "path_um") == [(0, 0, 0.0), (1, 0, 1.0), (2, 0, 2.0), (3, 0, 3.0), (10, 10, 0.0), (11, 10, 1.0), (12, 10, 2.0)]
    assert rows(trees.strahler(n), "node_id", "strahler") == [(0, 2), (1, 2), (2, 1), (3, 1), (10, 2), (11, 1), (12, 1)]
    assert rows(trees.segments(n), "start_id", "end_id", "n_nodes") == [(0, 1, 2), (1, 2, 2), (1, 3, 2), (10, 11, 2), (10, 12, 2)]


def test_strahler_orders_of_random_trees(spark):
    import random

    rng = random.Random(6)
    parents = {}
    for t in range(12):
        n = rng.randrange(1, 90)
        span = rng.choice([1, 2, 90])
        for i in range(n):
            parents[t, i] = -1 if i == 0 or rng.random() < 0.02 else rng.randrange(max(0, i - span), i)
    d = spark.createDataFrame([(t, i, p) for (t, i), p in parents.items()], "neuron_id int, node_id int, parent_id int")
    want = {}
    for t, i in sorted(parents, key=lambda k: -k[1]):
        kids = sorted((want[t, j] for (u, j), p in parents.items() if u == t and p == i), reverse=True)
        want[t, i] = 1 if not kids else kids[0] + (len(kids) > 1 and kids[1] == kids[0])
    assert {(r.neuron_id, r.node_id): r.strahler for r in trees.strahler(d).collect()} == want
    with pytest.raises(ValueError, match="cycle"):
        trees.strahler(spark.createDataFrame([(1, 0, -1), (1, 1, 2), (1, 2, 1)], "neuron_id int, node_id int, parent_id int"))


def test_a_high_tree_takes_few_rounds(spark, monkeypatch):
    """A chain of 100,000 nodes with a tip at every thousandth."""
    n = 100_000
    rows = spark.range(n).selectExpr("1 as neuron_id", "cast(id as int) as node_id", "cast(id - 1 as int) as parent_id")
    tips = spark.range(0, n - 1, 1000).selectExpr("1 as neuron_id", f"cast({n} + id as int) as node_id", "cast(id as int) as parent_id")
    settled, rounds = trees.settled, []
    monkeypatch.setattr(trees, "settled", lambda df: rounds.append(1) or settled(df))
    got = trees.strahler(rows.unionByName(tips)).groupBy("strahler").count().collect()
    assert {r.strahler: r["count"] for r in got} == {1: 100 + 999, 2: n - 999}
    assert len(rounds) <= 12


def test_known_orders_leave_the_rounds(spark, monkeypatch):
    """A full binary tree of 1023 nodes: a level goes with each round."""
    d = spark.range(1023).selectExpr("1 as neuron_id", "cast(id as int) as node_id", "cast(case when id = 0 then -1 else floor((id - 1) / 2) end as int) as parent_id")
    settled, sizes = trees.settled, []

    def counted(df):
        out = settled(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(trees, "settled", counted)
    got = trees.strahler(d).groupBy("strahler").count().collect()
    assert {r.strahler: r["count"] for r in got} == {k: 1 << (10 - k) for k in range(1, 11)}
    assert sum(sizes) < 4 * 1023


def test_cycles_are_reported(spark):
    with pytest.raises(ValueError, match="cycle"):
        trees.path_lengths(forest(spark, [(0, -1), (1, 2), (2, 1)]))


def test_epochs_of_a_line(spark):
    on = [0, 0, 1, 1, 1, 0, 1, 1, 0, 0, 0, 0, 1, 0]
    d = spark.createDataFrame([(1, i, float(i), bool(b), 0.0) for i, b in enumerate(on)], "session_id int, i int, t double, b boolean, v double")
    assert rows(signals.epochs(d, gap=1.0, least=2.0), "start_idx", "end_idx", "duration_s") == [(2, 8, 6.0)]
    assert rows(signals.epochs(d, mode="continuous"), "start_idx", "end_idx") == [(2, 13)]
    assert rows(signals.adaptive_gap(d, 2, [0.5, 3.0, 9.0]), "gap") == [(0.5,)]
    assert rows(signals.adaptive_gap(d, 9, [0.5, 3.0]), "gap") == [(None,)]


def test_warp_follows_and_extends_the_lines(spark):
    anchors = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 20.0), (1, 20.0, 30.0)], "session_id int, src double, dst double")
    e = spark.createDataFrame([(1, t) for t in (-1.0, 5.0, 10.0, 15.0, 22.0)], "session_id int, t double")
    assert rows(windows.piecewise_warp(e, anchors), "t", "warped") == [(-1.0, -2.0), (5.0, 10.0), (10.0, 20.0), (15.0, 25.0), (22.0, 32.0)]


def test_savitzky_golay_keeps_cubics(spark):
    d = spark.createDataFrame([(1, i, float(i**3 - 4 * i)) for i in range(30)], "k int, i int, v double")
    assert all(abs(r.smooth - r.v) < 1e-6 for r in baselines.savitzky_golay(d, ["k"], 4).collect())


def test_tails_match_known_values(spark):
    d = spark.createDataFrame([(1.959963984540054, 3.841458820694124, 1.0, 4.964602743730711)], "z double, x double, df double, f double")
    got = d.select(statistics.normal_tail("z").alias("z"), statistics.chi_square_tail("x", "df").alias("x")).first()
    assert abs(got.z - 0.05) < 1e-9 and abs(got.x - 0.05) < 1e-9
    assert abs(statistics.f_tail_value(4.964602743730711, 1, 10) - 0.05) < 1e-9


def test_wilcoxon_of_zeros_and_nothing(spark):
    d = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, None), (3, 1.0), (3, 2.0), (3, -3.0)], "k int, v double")
    got = {r.k: r for r in statistics.wilcoxon(d, ["k"]).collect()}
    assert got[1].p == 1.0 and 2 not in got and (got[3].w_plus, got[3].w_minus) == (3.0, 3.0)


def test_permutation_finds_what_is_there(spark):
    d = spark.createDataFrame([(1, i, "ab"[i % 2], float(i % 2) + i * 1e-3) for i in range(40)] + [(2, i, "ab"[i % 2], float(i * 7919 % 41)) for i in range(40)], "k int, event_id int, stimulus string, v double")
    got = {r.k: r for r in statistics.permutation_fve(d, ["k"], 99).collect()}
    assert got[1].fve > 0.99 and got[1].p == 0.01 and got[2].p > 0.05


def test_manova_separates_groups(spark):
    w = spark.createDataFrame([(1, e, "abc"[e % 3], k, math.sin(e * 12.9898 + k * 78.233) + (e % 3) * (k == 1) * 4) for e in range(60) for k in range(3)], "roi int, event_index int, stimulus string, k int, v double")
    got = statistics.manova(w, ["roi"], [0, 1, 2]).first()
    assert got.groups == 3 and 0 < got.wilks < 0.3 and got.p < 1e-6


def test_clocks_align_by_photodiode_or_by_frames(spark):
    from chronolock.operators import clock

    # flips every 30 frames of 1/60 s from frame 7, at uneven intervals in session 1; the device runs
    # 1.0002 times as fast, 0.3 s late
    uneven = np.cumsum([7] + [20 + k * 7 % 11 for k in range(200)])
    flips = lambda sid, n: int(np.searchsorted(uneven, n, "right")) if sid == 1 else int((n - 7) // 30) + 1
    on_device = {1: lambda t: 500 + 0.3 + 1.0002 * t, 2: lambda t: 900 + 0.3 + 1.0002 * t, 3: lambda t: 100 + 0.3 + t, 4: lambda t: 0.3 + t}
    rows_, points = [], []
    for sid, f in on_device.items():
        i = 0
        for n in range(2400):
            if sid in (1, 3) and (n == 0 or flips(sid, n) > flips(sid, n - 1)):
                rows_.append((sid, i, 1000.0 + n / 60, f"Photodiode-{flips(sid, n) % 2}"))
                i += 1
            rows_.append((sid, i, 1000.0 + n / 60, "Frame"))
            i += 1
        start, stop = int(f(0)) * 100, int(f(10 if sid == 3 else 40) * 100)
        for j in range(stop - start):
            t = start / 100 + j / 100
            n = ((t - f(0)) / (f(1) - f(0))) * 60
            points.append((sid, j, t, 0.0 if sid == 4 else 5.0 * (flips(sid, n) % 2)))
    log = spark.createDataFrame(rows_, "session_id int, row_idx long, t double, value string")
    samples = spark.createDataFrame(points, "session_id int, i int, t double, v double")
    for warp, first in ((True, "piecewise"), (False, "affine")):
        out, record = clock.align(log, samples, warp=warp)
        by = {r.session_id: r for r in record.collect()}
        assert {k: r.alignment_method for k, r in by.items()} == {1: first, 2: "frames", 3: "short recording", 4: "no pairs"}
        got = out.collect()
        assert len(got) == len(rows_)
        for r in got:
            assert (r.t_corr is None) == (r.session_id > 2)
            if r.t_corr is not None:
                assert abs(r.t_corr - on_device[r.session_id](r.t - 1000)) < 0.03, r
        assert by[2].phase == 7 and abs(by[2].intercept - 0.3) < 0.02 and abs(by[2].slope - 1.0002) < 1e-3 and by[1].phase is None


def test_debounce_counts_from_the_last_that_stayed(spark):
    d = spark.createDataFrame([(1, x) for x in (0.0, 0.4, 0.8, 1.2, 5.0, 5.0)] + [(2, 3.0), (3, None)], "session_id int, t double")
    assert rows(signals.debounce(d, "session_id", 0.5), "session_id", "t") == [(1, 0.0), (1, 0.8), (1, 5.0), (2, 3.0)]


def test_tuned_by_each_method(spark):
    from chronolock.operators.composites import gated, tuning

    # trace 1 answers by image in its mean, 2 in its shape alone, 3 not at all, 4 has one image
    def value(roi, e, k):
        noise = math.sin(e * 12.9898 + k * 78.233 + roi) * 43758.5453
        noise -= math.floor(noise) + 0.5
        return noise + {1: 3.0 * (e % 4), 2: 3.0 * (e % 4) * (1, -1, 0)[k]}.get(roi, 0.0)

    w = spark.createDataFrame([(r, e, "im" + str(e % 4 if r < 4 else 0), k, value(r, e, k)) for r in (1, 2, 3, 4) for e in range(48) for k in range(3)], "roi int, event_id int, stimulus string, k int, v double")
    values = w.groupBy("roi", "event_id", "stimulus").agg(F.avg("v").alias("v"))
    got = {m: {r.roi: r for r in tuning(values, ["roi"], 199, method=m, traces=w)["tuning_summary"].collect()} for m in ("fve", "manova", "hybrid")}
    assert {m: sorted(i for i, r in x.items() if r.is_tuned) for m, x in got.items()} == {"fve": [1], "manova": [1, 2], "hybrid": [1, *([2] if got["fve"][2].fve >= 0.05 else [])]}
    assert sorted(got["fve"]) == [1, 2, 3]
    one = got["fve"][1]
    by = [[sum(value(1, e, k) for k in range(3)) / 3 for e in range(48) if e % 4 == i] for i in range(4)]
    assert one.preferred == "im3" and abs(one.preferred_effect - (np.median(by[3]) - np.median(by[0] + by[1] + by[2]))) < 1e-9
    with pytest.raises(ValueError):
        tuning(values, ["roi"], method="other")
    with pytest.raises(ValueError):
        tuning(values, ["roi"], method="manova")
    table = spark.createDataFrame([(1, "image", "activated"), (1, "image", "activated"), (2, "image", "no_change"), (3, "change", "activated")], "roi int, family string, response_class string")
    assert {r.roi for r in gated(values, table, ["roi"]).collect()} == {1} and gated(values, table, ["roi"]).count() == 48


def test_components_explain_the_variance(spark):
    d = spark.createDataFrame([(i, float(i), 2.0 * i + (i % 3), float(i % 5)) for i in range(50)], "id int, a double, b double, c double")
    got = statistics.principal_components(d, ["a", "b", "c"], 2).first()
    assert abs(got.explained[0] - 2 / 3) < 0.02 and len(got.scores) == 2


def test_regression_residuals_vanish_on_a_line(spark):
    d = spark.createDataFrame([(1, float(i), 3.0 * i + 2) for i in range(30)] + [(2, 1.0, 5.0)], "k int, x double, y double")
    got = rows(statistics.regress_out(d, ["k"], "y", ["x"], ridge=0.0), "k", "residual")
    assert all(abs(v) < 1e-6 for k, v in got if k == 1) and got[-1] == (2, 5.0)


def test_patterns_of_sequences(spark):
    curves = {"adapting": [9, 6, 3], "facilitating": [1, 2, 3], "biphasic": [1, 5, 1], "stable": [2, 2, 2]}
    d = spark.createDataFrame([(name, p, float(v), 1) for name, c in curves.items() for p, v in enumerate(c)], "k string, position int, response double, n int")
    got = statistics.sequence_slopes(statistics.sequence_bins(d, ["k"]), ["k"])
    assert {r.k: r.pattern for r in got.collect()} == {k: k for k in curves}


def test_pixels(spark):
    p = spark.createDataFrame([(1, 1, 0, 0, 0, 1.0), (1, 1, 0, 0, 2, 3.0), (1, 2, 0, 1, 1, 0.0)], "session_id int, roi int, trial int, y int, x int, w double")
    assert rows(pixels.centroids(p), "roi", "cy", "cx") == [(1, 0.0, 1.5), (2, None, None)]
    assert rows(pixels.bounding_boxes(p, 1), "roi", "y0", "x0", "y1", "x1") == [(1, 0, 0, 1, 3), (2, 0, 0, 2, 2)]


def test_not_a_number_becomes_null(spark):
    d = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "v double")
    assert [r.f for r in d.select(finite("v").alias("f")).collect()] == [None, None, 1.0, None]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "logs" / "s1").mkdir(parents=True)
    (tmp_path / "logs" / "s1" / "log.csv").write_text("Unnamed: 0,Frame,Timestamp,Value\n0,1,0.5,Frame\n1,x,0.7,a.tiff\n")
    got = sources.read_event_log(spark, f"{tmp_path}/logs/*/log.csv")
    assert rows(got, "Frame", "Timestamp", "Value", "session_id") == [(1, 0.5, "Frame", "s1"), (None, 0.7, "a.tiff", "s1")]
    (tmp_path / "n.swc").write_text("# soma: yes\n# scale\n1 1 0 0 0 1 -1\n2 3 1.5 0 0 0.5 1\n3 3 1\n")
    assert rows(sources.read_swc(spark, f"{tmp_path}/n.swc"), "neuron_id", "node_id", "x", "parent_id") == [("n", 1, 0.0, -1), ("n", 2, 1.5, 1)]
    assert rows(sources.swc_metadata(spark, f"{tmp_path}/n.swc"), "key", "value") == [("soma", "yes")]
    d = spark.createDataFrame([(1, 1, 0, float("nan")), (1, 1, 1, 2.0), (2, 1, 0, 3.0)], "session_id int, roi int, i int, dF double")
    sources.write_tables({"traces": d}, str(tmp_path / "out"))
    sources.write_tables({"traces": d.where("session_id = 2")}, str(tmp_path / "out"))
    assert rows(sources.read_traces(spark, f"{tmp_path}/out/traces"), "session_id", "i", "v") == [(1, 0, None), (1, 1, 2.0), (2, 0, 3.0)]
    assert sources.read_traces(spark, f"{tmp_path}/out/traces", sessions=[1], first=1).count() == 1
    sources.write_documents(d, str(tmp_path / "json"))
    assert spark.read.json(f"{tmp_path}/json").count() == 3
    (tmp_path / "qc" / "s9").mkdir(parents=True)
    (tmp_path / "qc" / "s9" / "a.json").write_text('{"n": 1}')
    (tmp_path / "qc" / "s9" / "b.json").write_text("[broken")
    assert rows(sources.read_documents(spark, f"{tmp_path}/qc/*/*.json"), "session_id", "kind", "body") == [("s9", "a", '{"n": 1}'), ("s9", "b", "{}")]
    assert rows(sources.file_manifest(spark, f"{tmp_path}/qc", "*.json"), "session_id", "name") == [("s9", "a.json"), ("s9", "b.json")]
    assert sources.concatenated([d, d.withColumn("more", F.lit(1))]).count() == 6
    assert sources.run_metadata(d, {"rate": 200}, {"dF": "change"}).schema["dF"].metadata == {"comment": "change"}


def test_files_are_read_by_their_headers(spark, tmp_path):
    for name, text in {
        "s1/log.csv": "Frame,Timestamp,Value\n1,0.5,Frame\n2,0.7,a.tiff\n",
        "s2/log.csv": "Value,Frame,Timestamp\nb,7,9.5\n",
        "s3/log.csv": "\ufeffUnnamed: 0,Timestamp,Value,Frame,Extra\n0,1.5,c,3,x\n1,,\"d,e\",oops,\n",
        "s4/log.csv": "Frame,Value\n1,x\n",
        "s5/log.csv": "\n1,2\n",
        "s6/log.csv": "Frame,Timestamp,Value,Frame\n1,2,3,4\n",
    }.items():
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = sources.read_event_log(spark, f"{tmp_path}/*/log.csv")
    want = [("s1", 0, 1, 0.5, "Frame", None), ("s1", 1, 2, 0.7, "a.tiff", None), ("s2", 0, 7, 9.5, "b", None), ("s3", 0, 3, 1.5, "c", "x"), ("s3", 1, None, None, "d,e", None)]
    assert sorted(tuple(r) for r in got.select("session_id", "row_idx", "Frame", "Timestamp", "Value", "Extra").collect()) == want
    _, report = sources.concatenated_files(spark, f"{tmp_path}/*/log.csv", ("Frame", "Timestamp", "Value"))
    said = {r.file.split("/")[-2]: (r.status, r.reason) for r in report.collect()}
    assert said == {"s1": ("read", None), "s2": ("read", None), "s3": ("read", None), "s4": ("skipped", "lacks Timestamp"), "s5": ("skipped", "empty"), "s6": ("skipped", "repeats Frame")}
    for reader, texts in ((sources.read_corrected_log, ("Value,corrected_timestamps\na,1.5\n", "corrected_timestamp,Value\n2.5,b\n")), (sources.read_epochs, ("start_time,end_time\n1,2\n", "end_time,note,start_time\n4,z,3\n"))):
        folder = tmp_path / reader.__name__
        for k, text in enumerate(texts):
            (folder / f"t{k}").mkdir(parents=True)
            (folder / f"t{k}" / "x.csv").write_text(text)
        names = ("session_id", "value", "t_corr") if reader is sources.read_corrected_log else ("session_id", "start_time", "end_time")
        assert rows(reader(spark, f"{folder}/*/x.csv"), *names) == ([("t0", "a", 1.5), ("t1", "b", 2.5)] if names[1] == "value" else [("t0", 1.0, 2.0), ("t1", 3.0, 4.0)])
    (tmp_path / "registry.csv").write_text("session_id,session_date\ns1,2024-01-02\ns2,soon\n")
    assert [(r.session_id, str(r.session_date)) for r in sources.read_registry(spark, f"{tmp_path}/registry.csv").orderBy("session_id").collect()] == [("s1", "2024-01-02"), ("s2", "None")]
    assert sources.read_measurements(spark, f"{tmp_path}/nowhere/*.csv") is None
    with pytest.raises(ValueError, match="no file can be read"):
        sources.read_event_log(spark, f"{tmp_path}/s4/log.csv")


def test_a_batch_that_runs_again_leaves_the_same_rows(spark, tmp_path):
    """The driver is lost after the write and before the mark: the batch comes again."""
    import os

    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(3).write.parquet(source)
    for _ in range(2):
        streaming.process_arrivals(spark, source, "id long", lambda df: df, sink, mark).awaitTermination(120)
        for name in os.listdir(f"{mark}/commits"):
            os.remove(f"{mark}/commits/{name}")
        assert spark.read.parquet(sink).count() == 3


def test_assets_by_rules_in_order(spark):
    files = spark.createDataFrame([("/d/a/x/Summary1.mat", 1), ("/d/a/y/Summary2.mat", 5), ("/d/a/old.mat", 9), ("/d/a/k.harp/photodiode1.pkl", 2), ("/d/a/z/photodiode9.pkl", 8), ("/d/a/k2.harp/other", 1), ("/d/ab/Summary3.mat", 7), ("/f/b/old.mat", 3), ("/f/b/older.mat", 3)], "path string, n int").selectExpr("path", "timestamp_seconds(n) as mtime")
    sessions = spark.createDataFrame([("a", "/d/a/", None), ("b", "/d/b", "/f/b"), ("c", None, None)], "session_id string, dir string, spare string")
    rules = {"photodiode": [("dir", r"photodiode.*\.pkl")], "mat": [("dir", r"Summary.*\.mat"), ("dir", r"old.*\.mat"), ("spare", r"old.*\.mat")], "harp": [("dir", r".*\.harp")]}
    got = registry.resolved_assets(sessions, files, rules, {"photodiode": "harp"})
    assert rows(got, "session_id", "mat", "mat_rule", "harp", "photodiode") == [("a", "/d/a/y/Summary2.mat", 0, "/d/a/k.harp", "/d/a/k.harp/photodiode1.pkl"), ("b", "/f/b/older.mat", 2, None, None), ("c", None, None, None, None)]


def test_one_row_or_an_error(spark):
    d = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "session_id int, v string")
    assert registry.session_row(d, 1).v == "x"
    for bad, kind in ((3, KeyError), (2, ValueError)):
        with pytest.raises(kind):
            registry.session_row(d, bad)


def test_overall_quality_of_parts(spark):
    d = spark.createDataFrame([(1, 1.2, 0.3, True, 0.8), (2, None, None, False, None), (3, None, None, None, None), (4, 0.39, None, None, 1.0)], "session_id int, glut_pass_fraction double, ca_pass_fraction double, alignment_ready boolean, event_coverage double")
    got = {r.session_id: (r.score and round(r.score, 6), r.tier, r.flags, r.needs_review) for r in registry.overall_quality(d).collect()}
    assert got == {1: (0.83, "B", "low_calcium_pass_fraction; low_event_coverage", False), 2: (0.0, "FAIL", "alignment_failed", True), 3: (None, None, "", True), 4: (round((0.45 * 0.39 + 0.15) / 0.6, 6), "C", "low_glut_pass_fraction", True)}


def test_arrivals_are_processed_once(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(source)
        streaming.process_arrivals(spark, source, "id long", lambda df: df.withColumn("twice", df.id * 2), sink, mark).awaitTermination(120)
        assert spark.read.parquet(sink).count() == (3 if n == 3 else 8)


def test_signed_ranks_are_exact_for_few_values(spark):
    from itertools import product

    v = [0.5, -1.25, 2.0, 3.5, -0.75, 4.0, 1.5, 2.25, 5.0]
    d = spark.createDataFrame([("a", x) for x in v] + [("b", x) for x in [*v, 0.0]] + [("c", 0.0)], "k string, v double")
    got = {r.k: r for r in statistics.wilcoxon(d, ["k"]).collect()}
    rank = {x: sorted(map(abs, v)).index(abs(x)) + 1 for x in v}
    low = min(sum(rank[x] for x in v if x > 0), sum(rank[x] for x in v if x < 0))
    share = sum(sum(r for r, s in zip(range(1, 10), signs) if s) <= low for signs in product((0, 1), repeat=9)) / 2**9
    assert abs(got["a"].p - 2 * share) < 1e-12
    assert got["b"].p != got["a"].p and abs(got["b"].z - got["a"].z) < 1e-12  # a zero: the normal approximation
    assert got["c"].p == 1.0


def test_components_of_many_columns_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 9)) @ rng.normal(size=(9, 9))
    x[:, 4] = 2.5
    names = [f"c{i}" for i in range(9)]
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(99, *[None] * 9)], "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: r for r in statistics.principal_components(d, names, 3).collect()}
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), 1)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    for k, o in enumerate(np.argsort(values)[::-1][:3]):
        load = vectors[:, o] * np.sign(vectors[np.argmax(np.abs(vectors[:, o])), o])
        assert np.allclose([got[i].scores[k] for i in range(60)], z @ load, atol=1e-8)
        assert abs(got[0].explained[k] - values[o] / values.sum()) < 1e-9
    assert got[99].scores is None


def test_permutations_need_labels_and_reach_small_p(spark):
    rows = [("a", i, "x" if i % 2 else "y", float(i % 2) + i / 1e4) for i in range(40)] + [("a", 99, None, 5.0)]
    got = statistics.permutation_fve(spark.createDataFrame(rows, "k string, event_id long, stimulus string, v double"), ["k"]).first()
    assert got.n == 40 and got.fve > 0.99 and abs(got.p - 1 / 2001) < 1e-9
