"""Pixel tables: footprints, crops and movie frames as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def orient(pixels: DataFrame, transpose: bool = False, flip_y: bool = False, flip_x: bool = False) -> DataFrame:
    """pixels transposed, then mirrored within their session's extent."""
    p = pixels.withColumns({"y": F.col("x"), "x": F.col("y")}) if transpose else pixels
    top = p.groupBy("session_id").agg(F.max("y").alias("_y"), F.max("x").alias("_x"))
    p = p.join(top, "session_id")
    return p.withColumns({"y": F.col("_y") - F.col("y") if flip_y else F.col("y"), "x": F.col("_x") - F.col("x") if flip_x else F.col("x")}).drop("_y", "_x")


def bounding_boxes(pixels: DataFrame, padding: int = 0, union: bool = False) -> DataFrame:
    """the box of each footprint (or of all of a session) with some padding, from 0."""
    keys = ["session_id"] if union else ["session_id", "roi"]
    low = lambda c: F.greatest(F.min(c) - padding, F.lit(0)).alias(f"{c}0")
    return pixels.groupBy(*keys).agg(low("y"), low("x"), (F.max("y") + padding).alias("y1"), (F.max("x") + padding).alias("x1"))


def crop(movie: DataFrame, boxes: DataFrame) -> DataFrame:
    """pixels inside their session's box, from its corner."""
    m = movie.join(boxes, "session_id").where("y between y0 and y1 and x between x0 and x1")
    return m.withColumns({"y": F.col("y") - F.col("y0"), "x": F.col("x") - F.col("x0")}).drop("y0", "x0", "y1", "x1")


def mean_footprints(pixels: DataFrame) -> DataFrame:
    """Weights of each pixel averaged over trials."""
    return pixels.groupBy("session_id", "roi", "y", "x").agg(F.avg("w").alias("w"))


def centroids(footprints: DataFrame) -> DataFrame:
    """Weighted centre of each footprint, null where the weights do not add up to more than 0."""
    s = F.sum("w")
    return footprints.groupBy("session_id", "roi").agg(F.when(s > 0, F.sum(F.col("y") * F.col("w")) / s).alias("cy"), F.when(s > 0, F.sum(F.col("x") * F.col("w")) / s).alias("cx"))


def sparse_coordinates(mask: DataFrame, values: DataFrame, rows: int) -> DataFrame:
    """Values by place in a mask's column-major order, as coordinates."""
    placed = mask.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("x", "y")) - 1)
    return values.join(placed.where(F.col("y") < rows), ["session_id", "place"])


def fill_movie(movie: DataFrame, most_missing: float = 0.7) -> DataFrame:
    """Missing values take their pixel's mean; pixels that miss more than ``most_missing`` are null
    throughout."""
    m = movie.groupBy("session_id", "y", "x").agg(F.avg("v").alias("_m"), (1 - F.count("v") / F.count("*")).alias("_gone"))
    return movie.join(m, ["session_id", "y", "x"]).withColumn("v", F.when(F.col("_gone") <= most_missing, F.coalesce("v", "_m"))).drop("_m", "_gone")


def movie_dff(movie: DataFrame, half: int) -> DataFrame:
    """Each pixel less its rolling median over time, over the larger of 50 and its mean plus 50."""
    order = W.partitionBy("session_id", "y", "x").orderBy("t").rowsBetween(-half, half)
    base = F.percentile("v", F.lit(0.5)).over(order)
    f = movie.withColumn("f0", base)
    return f.withColumn("df", F.col("v") - F.col("f0")).withColumn("dff", F.col("df") / F.greatest(F.lit(50.0), F.col("f0") + 50))


def display_range(pixels: DataFrame, keys: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """L4: percentiles for display, 0 and 1 where nothing is there, widened where they meet."""
    p = pixels.groupBy(*keys).agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("p"))
    lo, hi = F.coalesce(F.col("p")[0], F.lit(0.0)), F.coalesce(F.col("p")[1], F.lit(1.0))
    return p.select(*keys, lo.alias("low"), F.when(hi <= lo, lo + 1).otherwise(hi).alias("high"))
