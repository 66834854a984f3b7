"""Scores are made once, though ranks read them three times."""

from __future__ import annotations

from chronolock.operators import quality
from tests.test_read_once import counting


def test_scores_are_made_once(spark):
    scores, seen = counting(spark.createDataFrame([(k % 2, k, float(k // 3), 1.0) for k in range(12)], "k int, roi int, quality_score double, finite double"))
    got = {r.roi: (r.rank, r.percentile) for r in quality.ranked(scores, ["k"]).collect()}
    assert got[11] == (1, 5.5 / 6) and got[9] == (1, 5.5 / 6) and seen.value == 12
