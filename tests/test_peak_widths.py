"""Peaks are measured within their block; only those that it can't tell all about ask other blocks."""

from __future__ import annotations

import numpy as np
import pytest

from chronolock.operators import peaks as pk


def _signal(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(3):
        for i, v in enumerate(r.integers(0, 40, 90)):
            if (k, i) not in ((1, 31), (1, 32), (2, 60)):  # gaps
                rows.append((k, i, None if (k, i) == (0, 17) else float(v)))
    return spark.createDataFrame(rows, "k int, i int, v double")


def _rows(df):
    return sorted(tuple(r) for r in df.select("k", "i", "v", "left", "right", "prominence", "width").collect())


def test_a_block_tells_all_of_its_peaks(spark, monkeypatch):
    signal = _signal(spark)
    asked = pk._by_other_blocks

    def old_way(samples, found):
        held = found.withColumnRenamed("v", "level").withColumnRenamed("left", "from").withColumnRenamed("right", "to")
        return asked(samples, held, ["k"], 0.5, 0.5, 16)

    want = _rows(old_way(signal, pk.maxima(signal, ["k"])))
    monkeypatch.setattr(pk, "nearest", lambda *a, **k: pytest.fail("other blocks are asked"))
    assert _rows(pk.peaks(signal, ["k"], width=0.5)) == want and len(want) > 20


@pytest.mark.parametrize("block", [4, 16])
def test_blocks_of_any_size_agree(spark, block):
    signal = _signal(spark)
    assert _rows(pk.peaks(signal, ["k"], width=0.5, block=block)) == _rows(pk.peaks(signal, ["k"], width=0.5))
