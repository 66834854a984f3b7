"""What is dear to make is made once, however many steps read it."""

from __future__ import annotations

import math

from chronolock.operators import composites


def counting(df):
    seen = df.sparkSession.sparkContext.accumulator(0)

    def over(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(over, df.schema), seen


def test_traces_are_read_once(spark):
    rows = [(k, i, 50 + 10 * math.sin(i / 5) + k) for k in range(2) for i in range(120)]
    traces, seen = counting(spark.createDataFrame(rows, "k int, i int, v double"))
    nuisance, also = counting(spark.createDataFrame([(k, i, math.cos(i)) for k, i, _ in rows], "k int, i int, v double"))
    assert composites.condition(traces, nuisance, ["k"]).where("dff is not null").count() == 240
    assert (seen.value, also.value) == (240, 240)
