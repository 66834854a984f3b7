"""SQL and queries of rank tests on large samples and on ties."""

from __future__ import annotations

import duckdb

from chronolock.plans import rollup


def test_tail_of_a_large_deviate_is_zero_in_sql():
    p = [duckdb.sql(f"select round({rollup.normal_sql('z')}, 7) from (select {z}e0 as z)").fetchall()[0][0] for z in (-200, -60, 60, -8, 1.959963985)]
    assert p == [0, 0, 0, 0, 0.05]


def test_equal_responses_tie_whatever_their_last_digits(spark, monkeypatch):
    values = [("a", 0.1 + 0.2), ("a", 0.5), ("a", 0.7), ("b", 0.3), ("b", 0.6), ("b", 0.1)]

    def h(rows):
        df = spark.createDataFrame([(1, 1, n, s, v) for n, (s, v) in enumerate(rows)], "session_id int, roi int, event_id int, stimulus string, delta_mean double")
        monkeypatch.setattr(rollup, "responses", lambda *_: df)
        return rollup.t2(None, "").collect()

    assert h(values) == h([(s, round(v, 1)) for s, v in values])
