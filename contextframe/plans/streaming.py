"""Queries that run a stream over what is there and give its result."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextframe.operators.policy import READ
from contextframe.plans.quality import _path_matches
from contextframe.sources.tables import shared_dir
from contextframe.streaming import events as E


def _drain(spark: SparkSession, stream: DataFrame, mode: str, once: str | None = None) -> DataFrame:
    return E.drained(stream, f"{shared_dir(spark)}/stream-{uuid4().hex}", mode, once)


def stream_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Totals by tool from a stream."""
    return _drain(spark, E.metrics(E.read(spark, f"{d}/token_events.parquet")), "complete")


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events by category from a stream without those sent again."""
    stream = E.distinct_events(E.read(spark, f"{d}/token_events.parquet"))
    return _drain(spark, stream.select("id", "category"), "append").groupBy("category").agg(F.count("*").alias("events"))


def _stateful(spark: SparkSession, stream: DataFrame, mode: str, once: str) -> DataFrame:
    """A stream with keyed state, drained with a state store that need not fit into memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _drain(spark, stream, mode, once)
    finally:
        spark.conf.set(name, before)


def stream_error_loops(spark: SparkSession, d: str) -> DataFrame:
    """Tools that a session calls at least fifty times, told by a stateful stream."""
    calls = E.read(spark, f"{d}/token_events.parquet").where("session_id IS NOT NULL AND tool IS NOT NULL")
    return _stateful(spark, E.error_loops(calls.select("session_id", F.col("tool").alias("signature")), 50), "update", "true")


def stream_post_call(spark: SparkSession, d: str) -> DataFrame:
    """What follows the calls of each session, told by one stateful stream."""
    return _stateful(spark, E.post_call(E.read(spark, f"{d}/token_events.parquet")), "update", "kind <> 'governance'")


QUERIES = {"stream_metrics": stream_metrics, "stream_dedup": stream_dedup, "stream_error_loops": stream_error_loops, "stream_post_call": stream_post_call}

SQL = {
    "stream_metrics": "SELECT tool, count(*) AS calls, CAST(sum(estimated_raw_tokens) AS BIGINT) AS raw_tokens, CAST(sum(estimated_compressed_tokens) AS BIGINT) AS compressed_tokens FROM token_events GROUP BY tool",
    "stream_dedup": "SELECT category, count(*) AS events FROM (SELECT DISTINCT ON (id) id, category FROM token_events) GROUP BY category",
    "stream_post_call": f"""
        WITH s AS (SELECT session_id, count(*) AS calls, sum(coalesce(estimated_raw_tokens, 0)) AS tokens FROM token_events WHERE session_id IS NOT NULL GROUP BY 1)
        SELECT session_id, 'hint' AS kind, 'calls' AS detail FROM s WHERE calls > 40 UNION ALL SELECT session_id, 'hint', 'tokens' FROM s WHERE tokens > 500000
        UNION ALL SELECT session_id, 'loop', tool FROM token_events WHERE session_id IS NOT NULL AND tool IS NOT NULL GROUP BY session_id, tool HAVING count(*) >= 50
        UNION ALL SELECT session_id, 'governance', subject FROM token_events WHERE session_id IS NOT NULL AND {_path_matches('subject', READ)}""",
    "stream_error_loops": "SELECT session_id, tool AS signature, 50 AS times FROM token_events WHERE session_id IS NOT NULL AND tool IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 50",
}
