"""Incremental runs: sessions that arrive are processed once, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_arrivals(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Each file that appears under ``source`` goes through ``work`` and into ``sink`` once; what is done is
    remembered in ``checkpoint``, which belongs to the sink.  It ends when all that is there is done.

    A batch has a folder of its own, ``batch=<number>``, and replaces it: one that is run again, after a driver
    was lost between its write and its mark, leaves the same rows."""

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each kind in windows of event time; rows later than the watermark are left out."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
