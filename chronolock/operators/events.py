"""Event logs: what rows are, when they happened, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the log format.
NON_STIMULI = ("frame", "endframe", "endflash", "gray", "intertrial")


def is_image(value: str = "value") -> Column:
    low = F.lower(value)
    return (low.endswith(".tif") | low.endswith(".tiff")) & ~low.contains("photodiode")


def is_change(value: str = "value") -> Column:
    low = F.lower(value)
    return low.contains("changeflash") | (low == "change")


def is_omission(value: str = "value") -> Column:
    return F.lower(value).contains("omission")


def is_other(value: str = "value") -> Column:
    low = F.lower(value)
    return low.isin(*NON_STIMULI) | low.contains("photodiode")


def classify(log: DataFrame) -> DataFrame:
    """``family`` of each row: image, change, omission, other, or null."""
    return log.withColumn("family", F.when(is_image(), "image").when(is_change(), "change").when(is_omission(), "omission").when(is_other(), "other"))


def classify_loosely(log: DataFrame) -> DataFrame:
    """the audit's predicates: any tif is an image, only ChangeFlash a change."""
    low = F.lower("value")
    return log.withColumn("family", F.when(low.endswith(".tif") | low.endswith(".tiff"), "image").when(F.col("value") == "ChangeFlash", "change").when(F.col("value") == "Omission", "omission"))


def event_time(log: DataFrame, order: tuple[str, ...] = ("corrected_timestamp", "corrected_timestamps", "Timestamp", "t")) -> DataFrame:
    """``t_corr``: the first of ``order`` that the log has; an error if none."""
    there = [c for c in order if c in log.columns]
    if not there:
        raise ValueError(f"the log has none of {order}")
    return log.withColumn("t_corr", F.col(there[0]).cast("double"))


def stimulus_label(value: str = "value") -> Column:
    """F8: the file name without folders and suffix."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(value, r"\\", "/"), "/"), -1), r"(?i)\.tiff?$", "")


def short_label(value: str = "value", most: int = 18) -> Column:
    label = stimulus_label(value)
    return F.when(F.length(label) > most, F.concat(F.substring(label, 1, most - 1), F.lit("…"))).otherwise(label)


def photodiode_state(log: DataFrame) -> DataFrame:
    """The last state that a Photodiode row set, on every row of its session."""
    low = F.lower("value")
    own = F.when(low == "photodiode-1", 1).when(low == "photodiode-0", 0)
    return log.withColumn("photodiode_state", F.last(own, ignorenulls=True).over(W.partitionBy("session_id").orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0)))


def time_zero(log: DataFrame) -> DataFrame:
    """Per session ``t0`` (the first Frame row, else the earliest row) and ``duration_s`` to the last
    Frame row."""
    frame = F.lower("value") == "frame"
    return log.groupBy("session_id").agg(F.coalesce(F.min_by(F.when(frame, F.col("t")), F.when(frame, F.col("row_idx"))), F.min("t")).alias("t0"), F.max(F.when(frame, F.col("t"))).alias("last")).select("session_id", "t0", (F.col("last") - F.col("t0")).alias("duration_s"))


def ordered(log: DataFrame, family: str = "image") -> DataFrame:
    """Rows of a family with ``event_idx`` from 0 in log order."""
    return classify(log).where(F.col("family") == family).withColumn("event_idx", F.row_number().over(W.partitionBy("session_id").orderBy("row_idx")) - 1)


def change_targets(log: DataFrame) -> DataFrame:
    """The first image row after each change row, each image once."""
    rows = classify(log)
    later = W.partitionBy("session_id").orderBy(F.desc("row_idx")).rowsBetween(W.unboundedPreceding, -1)  # from the last row back
    image = F.when(F.col("family") == "image", F.struct("row_idx", "t", "value"))
    return rows.withColumn("target", F.last(image, ignorenulls=True).over(later)).where("family = 'change' and target is not null").groupBy("session_id", F.col("target.row_idx").alias("row_idx")).agg(F.first("target.t").alias("onset"), F.first("target.value").alias("value"), F.count("*").alias("n_changes"))


def change_sequences(log: DataFrame) -> DataFrame:
    """Images of each sequence that a change target (of index 2 or more) opens: ``category``
    prechange (two images before it), repeated (it and those before the next target) or terminal (the
    next target, or the last image)."""
    images = ordered(log).select("session_id", "row_idx", "t", "value", "event_idx")
    targets = change_targets(log).select(F.col("session_id").alias("target_session"), F.col("row_idx").alias("target_row"))
    order = W.partitionBy("session_id").orderBy("event_idx")
    marked = images.join(targets, (F.col("session_id") == F.col("target_session")) & (F.col("row_idx") == F.col("target_row")), "left")
    marked = marked.withColumn("is_target", F.col("target_row").isNotNull() & (F.col("event_idx") >= 2)).withColumn("seq_id", F.sum(F.col("is_target").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = F.max("event_idx").over(W.partitionBy("session_id"))
    starts = marked.withColumn("last", last).where("is_target").withColumn("next", F.lead("event_idx").over(order)).select("session_id", "seq_id", F.col("event_idx").alias("start"), F.coalesce("next", "last").alias("stop"), (F.col("next").isNotNull()).alias("has_next"))
    end = F.when(F.col("has_next"), F.col("stop") - 1).otherwise(F.col("stop"))
    parts = [
        starts.select("session_id", "seq_id", F.lit("prechange").alias("category"), F.posexplode(F.array(F.col("start") - 2, F.col("start") - 1)).alias("position", "event_idx")),
        starts.select("session_id", "seq_id", F.lit("repeated").alias("category"), F.posexplode(F.sequence("start", end)).alias("position", "event_idx")),
        starts.select("session_id", "seq_id", F.lit("terminal").alias("category"), F.lit(0).alias("position"), F.col("stop").alias("event_idx")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def first_stimulus_rows(log: DataFrame) -> DataFrame:
    """Two rows before the log, a Frame row and the first image's, at time 0, where it has images.
    A log that has such rows (row_idx below 0) is left as it is."""
    first = log.where("row_idx >= 0").groupBy("session_id").agg(F.min_by(F.when(is_image(), F.col("value")), F.when(is_image(), F.col("row_idx"))).alias("image")).where("image is not null")
    done = log.where("row_idx < 0").select("session_id").distinct()
    new = first.join(done, "session_id", "left_anti").select("session_id", F.explode(F.array(F.struct(F.lit(-2).cast("bigint").alias("row_idx"), F.lit("Frame").alias("value")), F.struct(F.lit(-1).cast("bigint").alias("row_idx"), F.col("image").alias("value")))).alias("r")).select("session_id", "r.row_idx", F.lit(0.0).alias("t"), "r.value")
    return log.unionByName(new, allowMissingColumns=True)


def distinct_pairs(log: DataFrame) -> DataFrame:
    """the first row of each (value, time) of a session."""
    return log.withColumn("rn", F.row_number().over(W.partitionBy("session_id", "value", "t").orderBy("row_idx"))).where("rn = 1").drop("rn")


def first_seen(log: DataFrame) -> DataFrame:
    """U4: different images in the order they come first."""
    return log.where(is_image()).groupBy("session_id", "value").agg(F.min("row_idx").alias("first_row")).withColumn("ord", F.row_number().over(W.partitionBy("session_id").orderBy("first_row")) - 1)


def validate_log(log: DataFrame) -> DataFrame:
    """Per session: different images, whether there are photodiode rows, and warnings."""
    return log.groupBy("session_id").agg(F.countDistinct(F.when(is_image(), F.col("value"))).alias("n_images"), F.max(F.lower("value").contains("photodiode")).alias("has_photodiode"), F.max(is_omission()).alias("has_omission")).withColumn("passed", (F.col("n_images") > 1) & F.col("has_photodiode")).withColumn("warnings", F.concat_ws(";", F.when(F.col("n_images") <= 1, "few images"), F.when(~F.col("has_photodiode"), "no photodiode"), F.when(~F.col("has_omission"), "no omission")))


def event_document(log: DataFrame) -> DataFrame:
    """Per session counts of each family and the ordered times of changes, as a JSON list."""
    times = F.transform(F.array_sort(F.collect_list(F.when(is_change(), F.struct("row_idx", "t")))), lambda x: F.round(x["t"], 3))
    return classify(log).groupBy("session_id").agg(F.count(F.when(F.col("family") == "image", 1)).alias("n_image"), F.count(F.when(F.col("family") == "change", 1)).alias("n_change"), F.count(F.when(F.col("family") == "omission", 1)).alias("n_omission"), F.to_json(times).alias("change_times"))


def window_times(k: str = "k", rate: float = 200.0, pre: float = 0.25) -> Column:
    """Time of a window's sample relative to its event."""
    return F.col(k) / F.lit(float(rate)) - F.lit(float(pre))
