"""Readers and writers of the domain tables, through Spark's own sources."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolock.functions import finite

EVENT_LOG = "Frame int, Timestamp double, Value string"


def session_of(path: Column) -> Column:
    """The session's name: the folder that holds a file."""
    return F.element_at(F.split(path, "/"), -2)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Every CSV file below ``path`` with its first line: ``file, header``."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("_metadata.file_path").alias("_f"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_f"), "value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"))
    return files.join(lines.groupBy("_f").agg(F.min_by("value", "at").alias("header")), "_f", "left").select("file", "header")


def read_csv(spark: SparkSession, path: str, required: Sequence[str] = (), any_of: Sequence[str] = ()) -> tuple[DataFrame | None, DataFrame]:
    """CSV files of many sessions by the names in their headers, whatever their order, and a report.

    Headers are read first; files that share one are read together, and all are united by name, with null
    where a file lacks a column.  Unnamed columns go.  A file without one of ``required`` (or any of
    ``any_of``, if given), with a name twice or an empty first line is skipped; the report has a row for each
    file (of no bytes: none, Spark does not list it): ``file, status`` (read or skipped) and ``reason``.  Rows have ``session_id`` (the file's folder, if
    the file has no such column) and ``row_idx``, their place in their file.  The first part is None where no file can be read."""
    groups: dict[tuple[str, ...], list[str]] = {}
    report = []
    found = headers(spark, path).groupBy("header").agg(F.collect_list("file").alias("files")).collect()  # paths, as Spark itself holds them
    for header, files in found:
        names = [n.strip() for n in next(csv.reader([(header or "").lstrip("\ufeff")]), [])]
        kept = [n for n in names if n and not n.startswith("Unnamed")]
        lacks = [c for c in required if c not in kept]
        twice = sorted({n for n in kept if kept.count(n) > 1})
        why = "empty" if not kept else f"lacks {', '.join(lacks)}" if lacks else f"repeats {', '.join(twice)}" if twice else f"has none of {', '.join(any_of)}" if any_of and not set(any_of) & set(kept) else None
        report += [(f, "skipped" if why else "read", why) for f in files]
        if why is None:
            groups.setdefault(tuple(names), []).extend(files)
    out = None
    for names, files in groups.items():
        places = [f"_{i}" for i in range(len(names))]
        schema = ", ".join(f"{p} string" for p in places)
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", False).csv(files)
        kept = [(p, n) for p, n in zip(places, names) if n and not n.startswith("Unnamed")]
        at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        rows = raw.select(*[F.col(p).alias(n) for p, n in kept], F.col("_metadata.file_path").alias("_file"), at.alias("_at"))
        rows = rows.withColumn("row_idx", F.row_number().over(W.partitionBy("_file").orderBy("_at")) - 1).withColumns({} if "session_id" in names else {"session_id": session_of(F.col("_file"))}).drop("_file", "_at")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, spark.createDataFrame(report, "file string, status string, reason string")


def _needed(spark: SparkSession, path: str, required: Sequence[str], any_of: Sequence[str] = (), what: str = "the files") -> DataFrame:
    rows, report = read_csv(spark, path, required, any_of)
    if rows is None:
        raise ValueError(f"{what}: no file can be read: {[tuple(r) for r in report.limit(3).collect()]}")
    return rows


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Logs as CSV, columns by name (:func:`read_csv`); files without Frame, Timestamp and Value are
    skipped, and it is an error if none has them."""
    rows = _needed(spark, path, ("Frame", "Timestamp", "Value"), what="event logs")
    return rows.withColumns({"Frame": F.col("Frame").try_cast("int"), "Timestamp": F.col("Timestamp").try_cast("double")})


def read_corrected_log(spark: SparkSession, path: str) -> DataFrame:
    """Corrected logs: their time, which has either of two names, as ``t_corr``."""
    times = ("corrected_timestamp", "corrected_timestamps")
    rows = _needed(spark, path, ("Value",), times, "corrected logs")
    return rows.select("session_id", "row_idx", F.col("Value").alias("value"), F.coalesce(*[F.col(c).try_cast("double") for c in times if c in rows.columns]).alias("t_corr"))


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """S3: imaging epochs as CSV: ``start_time``, ``end_time`` and what else there is, as numbers."""
    rows = _needed(spark, path, ("start_time", "end_time"), what="epochs")
    return rows.select("session_id", *[F.col(c).try_cast("double").alias(c) for c in rows.columns if c not in ("session_id", "row_idx")])


def epoch_spans(epochs: DataFrame) -> DataFrame:
    """S3: first start, last end, total length and number of each session's epochs."""
    return epochs.groupBy("session_id").agg(F.min("start_time").alias("start"), F.max("end_time").alias("stop"), F.sum(F.col("end_time") - F.col("start_time")).alias("total_s"), F.count("*").alias("n_epochs"))


def read_traces(spark: SparkSession, path: str, signal: str = "dF", sessions: list | None = None, rois: list | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """One signal of traces in Parquet as ``v``; only the columns, partitions and row groups that
    are asked for are read.  NaN and infinities become null."""
    t = spark.read.parquet(path)
    for column, values in (("session_id", sessions), ("roi", rois)):
        if values is not None:
            t = t.where(F.col(column).isin(*values))
    if first is not None:
        t = t.where(F.col("i") >= first)
    if last is not None:
        t = t.where(F.col("i") < last)
    keys = [c for c in ("session_id", "dmd", "trial", "roi", "channel", "i") if c in t.columns]
    return t.select(*keys, finite(signal).alias("v"))


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two channels side by side where both are there."""
    return a.select(*keys, F.col("v").alias("y")).join(b.select(*keys, F.col("v").alias("x")), keys)


def with_invalid_trials(trials: DataFrame, traces: DataFrame) -> DataFrame:
    """Samples of every trial; a trial without any is one row of nulls."""
    return trials.select("session_id", "trial").join(traces, ["session_id", "trial"], "left")


def line(samples: DataFrame, name: str) -> DataFrame:
    """One sampled line, time from its session's first sample."""
    own = samples.where(F.col("line") == name)
    zero = own.groupBy("session_id").agg(F.min("t").alias("_t0"))
    return own.join(zero, "session_id").withColumn("t", F.col("t") - F.col("_t0")).drop("_t0")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The sessions table as CSV, of one file or several; dates that can't be read are null."""
    rows = _needed(spark, path, (), what="the registry")
    rows = rows.drop("row_idx")
    return rows.withColumn("session_date", F.expr("try_to_date(session_date)")) if "session_date" in rows.columns else rows


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one a file, as text; what is no object is ``{}``."""
    raw = spark.read.text(path, wholetext=True)
    body = F.when(F.expr("try_parse_json(value)").isNotNull() & F.trim("value").startswith("{"), F.col("value")).otherwise("{}")
    return raw.select(session_of(F.col("_metadata.file_path")).alias("session_id"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("kind"), body.alias("body"))


def read_swc(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """Neurons in SWC files, one a file (or a folder): rows of seven fields; comments and short rows are
    left out."""
    name = session_of(F.col("_metadata.file_path")) if by_folder else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.swc)?$", 1)
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(name.alias("neuron_id"), parts.alias("p")).where(F.size("p") >= 7)
    names = (("node_id", "int"), ("node_type", "int"), ("x", "double"), ("y", "double"), ("z", "double"), ("radius", "double"), ("parent_id", "int"))
    return rows.select("neuron_id", *[F.col("p")[i].try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def swc_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``# key: value`` comments of SWC files."""
    found = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.swc)?$", 1).alias("neuron_id"), F.regexp_extract("value", r"^#\s*([^:]+?)\s*:\s*(.*)$", 1).alias("key"), F.regexp_extract("value", r"^#\s*([^:]+?)\s*:\s*(.*)$", 2).alias("value"))
    return found.where("key <> ''")


def read_measurements(spark: SparkSession, path: str) -> DataFrame | None:
    """Optional CSV tables of many neurons by name, the neuron by the file's folder; None if there are
    none."""
    try:
        rows, _ = read_csv(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if rows is None else rows.withColumnRenamed("session_id", "neuron_id").drop("row_idx")


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder: session, name, path, bytes and time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(session_of(F.col("path")).alias("session_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", F.col("modificationTime").alias("mtime"))


def concatenated(tables: list[DataFrame]) -> DataFrame:
    """Tables of several sessions as one, columns by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def concatenated_files(spark: SparkSession, path: str, required: Sequence[str] = ()) -> tuple[DataFrame | None, DataFrame]:
    """CSV result tables of many sessions as one, and the report that says which were skipped and why
    (:func:`read_csv`)."""
    return read_csv(spark, path, required)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A result table by its suffix: CSV, JSON or Parquet."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.json(path) if path.endswith(".json") else spark.read.parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str, partition: str = "session_id", formats: Sequence[str] = ("parquet",), metadata: dict | None = None) -> None:
    """K1, K2: each table to a folder of its name, in each of ``formats`` (``parquet``, ``csv``: folders
    ``<name>`` and ``<name>_csv`` where both are asked for), one partition a session; only partitions
    written now are replaced.  ``metadata`` and the tables' columns go to ``<folder>/run_metadata``, one JSON
    row."""
    for name, df in tables.items():
        for kind in formats:
            out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out = out.partitionBy(partition) if partition in df.columns else out
            where = f"{folder}/{name}" if kind == "parquet" or len(formats) == 1 else f"{folder}/{name}_{kind}"
            out.option("header", True).format(kind).save(where)
    if metadata is not None:
        spark = next(iter(tables.values())).sparkSession
        columns = {name: dict(df.dtypes) for name, df in tables.items()}
        row = spark.createDataFrame([(json.dumps({"parameters": metadata, "tables": columns}, sort_keys=True),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{folder}/run_metadata")


def write_documents(df: DataFrame, folder: str) -> None:
    """K3: rows as JSON lines, NaN as null, null fields kept."""
    clean = df.select(*[finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def run_metadata(sessions: DataFrame, parameters: dict, descriptions: dict[str, str]) -> DataFrame:
    """K6: one row a session with the run's parameters as JSON, and column comments from
    ``descriptions``."""
    out = sessions.withColumn("parameters", F.lit(json.dumps(parameters, sort_keys=True)))
    return out.select(*[F.col(c).alias(c, metadata={"comment": descriptions[c]}) if c in descriptions else F.col(c) for c in out.columns])
