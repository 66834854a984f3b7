"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolock.llm.common import settle


def _measure(links: DataFrame) -> tuple[int, int]:
    n, total = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return n, int(total)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``links(u, v)``.

    Each round ties the larger neighbours of a node to its smallest one (large star), then the
    smaller ones (small star).  The sums are aggregated before they shuffle, and a hub's rows meet
    in a plain join that Spark may split.  Rounds grow with the logarithm of the longest chain.  An
    empty table gives no rows; self links and repeats don't matter; rows with a null end are none.
    """
    now = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = settle(now, "links")
    seen = _measure(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        now = settle(small, "links")
        last, seen = seen, _measure(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components: no end after {most_rounds} rounds")
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
