"""Two-pass ranks and running minima against plain ones, with a hot key, ties and nulls."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from chronolock.functions.ranking import counted, least_from


def test_counted_and_least_from(spark):
    rng = random.Random(3)
    rows = [("hot", rng.randrange(60) / 4) for _ in range(900)] + [(rng.choice("abc"), rng.randrange(5) / 2) for _ in range(200)] + [(None, 1.0), (None, 1.0), ("hot", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {}
    for key in {k for k, _ in rows}:
        c = Counter(v for k, v in rows if k == key and v is not None)
        want |= {(key, v): (n, sum(m for x, m in c.items() if x < v), sum(c.values())) for v, n in c.items()}
    got = {(r.k, r.v): (r.n, r.below, r.total) for r in counted(df, ["k"], "v").collect()}
    assert got == want
    one = spark.createDataFrame([(k, v, rng.random()) for k, v in want], "k string, v double, x double")
    held = [tuple(r) for r in one.collect()]
    for r in least_from(one, ["k"], "v", "x").collect():
        assert r.least == min(x for k, v, x in held if k == r.k and v >= r.v)


def test_a_hot_key_is_in_many_ranges(spark):
    from chronolock.functions.ranking import _ranges

    df = spark.range(4000).selectExpr("'one' as k", "cast(id as double) as v")
    sizes = [r["count"] for r in _ranges(df, ["k"], "v").groupBy("_at").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_quantiles_of_large_keys(spark):
    import numpy as np

    from chronolock.functions.quantiles import quantiles
    from chronolock.functions.ranking import large_keys
    from chronolock.operators.quality import robust_stats

    rng = random.Random(8)
    rows = [(k, i, rng.choice([rng.random(), 0.5, float(rng.randrange(3))])) for k, n in (("a", 400), ("b", 7), ("c", 1), (None, 40)) for i in range(n)] + [("a", 1, None), ("d", 0, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)
    shares = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    large = large_keys(df, ["k"], "v", 30)
    assert {r.k for r in large.collect()} == {"a", None} and large_keys(df, ["k"], "v", 400) is None
    got = {r.k: r.q for r in quantiles(df, ["k"], "v", shares, large).collect()}
    for k in ("a", "b", "c", None):
        want = np.quantile([v for key, _, v in rows if key == k and v is not None], shares)
        assert np.allclose(got[k], want, rtol=0, atol=1e-12)
    assert got["d"] is None
    one, two = ({r.k: tuple(r) for r in robust_stats(df, ["k"], held).collect()} for held in (30, 10**6))
    assert one.keys() == two.keys() and all(x == y or abs(x - y) < 1e-12 for k in one for x, y in zip(one[k][1:], two[k][1:]))


def test_tests_of_large_keys_are_those_of_small_ones(spark):
    """Ranks over ranges and ranks in one window give the same statistics."""
    from chronolock.operators import quality, statistics

    rng = random.Random(4)
    rows = [(k, rng.choice("xyz"), round(rng.gauss(0.2, 1), 1), rng.random() if rng.random() < 0.9 else None) for k, n in (("hot", 500), ("a", 40), ("b", 3), (None, 20)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, g string, v double, p double").repartition(4).withColumn("finite", F.lit(1.0))

    def of(held):
        return {
            "t4": statistics.benjamini_hochberg(df, ["k"], held=held),
            "t4 whole": statistics.benjamini_hochberg(df, [], held=held),
            "t1": statistics.wilcoxon(df.where("k is not null"), ["k"], held=held),
            "t2": statistics.kruskal(df.where("k is not null"), ["k"], "g", held=held),
            "t3": statistics.mann_whitney(df.where("k is not null"), "g", ["k"], held=held),
            "t3 whole": statistics.mann_whitney(df, "g", [], held=held),
            "w37": quality.ranked(df, ["k"], "v", held=held),
        }

    one, two = of(15), of(10**9)
    for name in one:
        a, b = (sorted(map(lambda r: str([round(x, 9) if isinstance(x, float) else x for x in r]), d[name].collect())) for d in (one, two))
        assert a == b and a, name
    # by the book
    got = {(r.k, r.p): r.q for r in of(15)["t4"].collect()}
    for k in ("hot", "a", "b", None):
        p = sorted(r[3] for r in rows if r[0] == k and r[3] is not None)
        least = 1.0
        for i in range(len(p), 0, -1):
            least = min(least, p[i - 1] * len(p) / i)
            assert abs(got[k, p[i - 1]] - least) < 1e-12
