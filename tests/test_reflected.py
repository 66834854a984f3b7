"""A signal with its ends mirrored is one side of its joins, not a union of three."""

from __future__ import annotations

import math
from contextlib import contextmanager

from chronolock.functions.lineage import stored
from chronolock.operators import composites, signals

KEYS = ["k"]


@contextmanager
def confs(spark, **wanted):
    old = {n: spark.conf.get(n, None) for n in wanted}
    try:
        for n, v in wanted.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def traces(spark, lengths):
    rows = [(k, i, 50 + 10 * math.sin(i / 5 + k)) for k, n in enumerate(lengths) for i in range(n)]
    return stored(spark.createDataFrame(rows, "k int, i int, v double").repartition(8))


def test_joins_that_turn_to_broadcasts_keep_their_partitions(spark):
    # the plan joins by shuffles; while it runs, the lengths of the series turn out small enough to be broadcast
    t = traces(spark, [200] * 400)
    with confs(spark, **{"spark.sql.autoBroadcastJoinThreshold": "60000", "spark.sql.shuffle.partitions": "4"}):
        got = composites.condition(t, t.withColumn("v", t["v"] * 2), KEYS)
        assert got.count() == 80_000
        assert signals.high_pass(t, KEYS, 4).where("hp is not null").count() == 80_000


def test_ends_are_mirrored_without_their_end_samples(spark):
    lengths, half = [1, 2, 3, 7, 30], 4
    t = traces(spark, lengths)
    got = signals.reflected_mean(t, KEYS, half)
    assert (got.columns, dict(got.dtypes)["i"]) == (["k", "i", "v", "smooth"], "int")
    found = {(r.k, r.i): r.smooth for r in got.collect()}
    for k, n in enumerate(lengths):
        v = {i: 50 + 10 * math.sin(i / 5 + k) for i in range(n)}
        both = sorted([*v.items(), *[(-i, v[i]) for i in range(1, min(half, n - 1) + 1)], *[(2 * (n - 1) - i, v[i]) for i in range(max(n - 1 - half, 0), n - 1)]])
        places = [p for p, _ in both]
        for i in range(n):
            at = places.index(i)
            near = [x for _, x in both[max(at - half, 0) : at + half + 1]]
            assert abs(found[k, i] - sum(near) / len(near)) < 1e-9
    assert len(found) == sum(lengths)
