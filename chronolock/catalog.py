"""Queries by name, with the SQL that DuckDB runs for the same rows.

Domain tables are views over the shared test tables: one text, whose ``{name}`` places hold the
engine's own tables and views, serves both engines where their dialects agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

VIEWS: dict[str, str] = {
    "traces": "select cast(l_suppkey % 5 as int) session_id, l_suppkey roi, cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_shipdate) - 1 as int) i, l_extendedprice v from {lineitem}",
    "log": "select cast(user_id % 5 as int) session_id, event_id row_idx, {micros} / 1e6 t, case event_type when 'view' then concat('stimuli/im', cast(event_id % 8 as string), '.tiff') when 'click' then 'Frame' when 'signup' then 'ChangeFlash' when 'error' then 'Omission' else concat('Photodiode-', cast(event_id % 2 as string)) end value from {events}",
    "onsets": "select cast(user_id % 5 as int) session_id, event_id, concat('im', cast(event_id % 8 as string)) stimulus, cast(5 * row_number() over (partition by user_id % 5 order by ts, event_id) as int) c from {events} where event_type = 'view'",
    "samples": "select user_id session_id, cast(row_number() over (partition by user_id order by event_id) - 1 as int) i, {micros} / 1e6 t, value v, value > 20 b from {events}",
    "sessions": "select o_custkey subject_id, o_orderkey session_id, cast(o_orderdate as date) session_date, o_orderpriority session_type, o_orderstatus quality, o_totalprice score from {orders}",
    "nodes": "select neuron_id, k node_id, case when k = 0 then -1 else cast(floor((k - 1) / (case when k % 5 = 0 then 2e0 else 1e0 end)) as int) end parent_id, x, k * 1e0 y, (k % 7) * 1e0 z from (select cast(o_custkey % 20 as int) neuron_id, cast(row_number() over (partition by o_custkey % 20 order by o_orderkey) - 1 as int) k, o_totalprice / 1e3 x from {orders}) q",
    "pvalues": "select event_type family, event_id, value / 500 p from {events}",
}
SPARK_ONLY = {"trials": "select vec_id event_index, label stimulus, pos k, cast(col as double) v from {embeddings} lateral view posexplode(embedding) as pos, col"}
DUCK_ONLY = {"trials": "select vec_id event_index, label stimulus, unnest(range(len(embedding))) k, cast(unnest(embedding) as double) v from embeddings"}
MICROS = {"spark": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))", "duck": "epoch_us(ts)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = (VIEWS | SPARK_ONLY)[name].replace("{micros}", MICROS["spark"])
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def duck(body: str, *views: str) -> str:
    """``body`` with the views it names."""
    texts = [(v, re.sub(r"\{(\w+)\}", r"\1", (VIEWS | DUCK_ONLY)[v].replace("{micros}", MICROS["duck"]).replace(" string)", " varchar)"))) for v in views]
    return ("with recursive " + ", ".join(f"{v} as ({t})" for v, t in texts) + (", " + body.strip()[5:] if body.strip().lower().startswith("with ") else " " + body)) if views else body


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query, and the SQL for it over ``views``."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = duck(sql, *views)
        return f

    return add
