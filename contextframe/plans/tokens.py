"""Queries of token accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextframe.functions import text as X
from contextframe.operators import tokens as T
from contextframe.sources.tables import load

HOT_SESSION = "sess-ci-nightly-0000"
_EVENT = ("id", "session_id", "tool", "category", "subject", "estimated_raw_tokens", "estimated_compressed_tokens", "created_at")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "token_events", *_EVENT)


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The three token estimates of every context item."""
    t = F.col("content")
    return load(spark, d, "context_items", "item_id", "content").select("item_id", X.estimate_tokens(t).alias("by_words"), X.estimate_tokens_marks(t).alias("by_marks"), X.estimate_tokens_bytes(t).alias("by_bytes"))


def assumed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events assumed from the size of run outputs."""
    runs = load(spark, d, "run_results", "run_id", "command_type", "compressed_output").distinct()
    tool = F.when(F.col("command_type") == "test", "smart_run").when(F.col("command_type") == "git", "smart_read").when(F.col("command_type") == "lint", "smart_edit").otherwise("other")
    return runs.select("run_id", *T.assumed_event(tool, F.col("compressed_output")))


def benchmark_compression(spark: SparkSession, d: str) -> DataFrame:
    """Whether each event's ratio lies in the range its category must reach."""
    events = load(spark, d, "token_events", "id", "category", "estimated_raw_tokens", "estimated_compressed_tokens").distinct()
    results = events.where("category = 'file_read'").select(
        T.savings_ratio(F.col("estimated_raw_tokens"), F.col("estimated_compressed_tokens")).alias("ratio"), F.lit(0.5).alias("least"), F.lit(0.98).alias("most")
    )
    return T.benchmark(results).withColumn("mean_ratio", F.round("mean_ratio", 6))


def feedback_summary(spark: SparkSession, d: str) -> DataFrame:
    """Ratings 1 to 3 as the exit codes of runs give them."""
    runs = load(spark, d, "run_results", "exit_code")
    return T.feedback(runs.select(F.when(F.col("exit_code") == 0, 3).when(F.col("exit_code") == 1, 2).when(F.col("exit_code") > 1, 1).otherwise(9).alias("rating")))


def quality_rating(spark: SparkSession, d: str) -> DataFrame:
    """The quality rating of every run."""
    runs = load(spark, d, "run_results", "run_id", "exit_code", "failures", "duration_ms").distinct()
    return runs.select("run_id", T.quality(F.col("exit_code"), F.size(F.from_json("failures", "array<struct<test:string>>")), F.col("duration_ms")).alias("quality"))


def experiment_report(spark: SparkSession, d: str) -> DataFrame:
    """Mean savings of three pipelines that take turns, of which one is switched off."""
    runs = load(spark, d, "context_items", "item_id", "content").where("length(content) > 0")
    runs = runs.select(F.col("item_id").alias("seq"), T.savings_ratio(F.length("content"), F.octet_length("content") / 4).alias("ratio"))
    pipelines = spark.createDataFrame([(0, "plain", True), (1, "summary", False), (2, "tree", True)], "position int, pipeline string, enabled boolean")
    return T.experiment_report(runs, pipelines)


def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots of two tools, merged by file."""
    events = _events(spark, d)
    return T.merged_snapshots(T.snapshot(events.where("tool = 'smart_edit'")), T.snapshot(events.where("tool = 'smart_read'")))


QUERIES = {
    "token_summary_total": lambda s, d: T.summary(_events(s, d)),
    "token_stats_by_tool": lambda s, d: T.by(_events(s, d), "tool"),
    "token_stats_by_category": lambda s, d: T.by(_events(s, d), "category"),
    "token_stats_grouping": lambda s, d: T.grouping(_events(s, d)),
    "token_stats_session": lambda s, d: T.of_session(_events(s, d), HOT_SESSION, "category"),
    "token_top_sessions": lambda s, d: T.top_sessions(_events(s, d), 20),
    "token_estimates": token_estimates,
    "assumed_events": assumed_events,
    "benchmark_compression": benchmark_compression,
    "feedback_summary": feedback_summary,
    "quality_rating": quality_rating,
    "experiment_report": experiment_report,
    "savings_report_markdown": lambda s, d: T.report(T.summary(_events(s, d))),
    "savings_report_text": lambda s, d: T.report(T.summary(_events(s, d)), "plain"),
    "compaction_hints": lambda s, d: T.hints(_events(s, d).where("session_id IS NOT NULL").dropDuplicates(["id"])),
    "metrics_snapshot": lambda s, d: T.snapshot(_events(s, d)),
    "snapshot_merge": snapshot_merge,
    "timeline_last100": lambda s, d: T.latest(_events(s, d).dropDuplicates(["id"])).select("id", "tool", "created_at"),
}

_TOTALS = """count(*) AS events, CAST(coalesce(sum(estimated_raw_tokens), 0) AS BIGINT) AS raw_tokens,
  CAST(coalesce(sum(estimated_compressed_tokens), 0) AS BIGINT) AS compressed_tokens,
  CAST(coalesce(sum(estimated_raw_tokens) - sum(estimated_compressed_tokens), 0) AS BIGINT) AS saved_tokens,
  CASE WHEN coalesce(sum(estimated_raw_tokens), 0) = 0 THEN 0.0::DOUBLE
       ELSE CAST(sum(estimated_raw_tokens) - sum(estimated_compressed_tokens) AS DOUBLE) / CAST(sum(estimated_raw_tokens) AS DOUBLE) END AS savings_ratio"""
_SNAPSHOT = "subject, count(*) AS calls, CAST(sum(estimated_raw_tokens) AS BIGINT) AS raw_tokens, CAST(sum(estimated_compressed_tokens) AS BIGINT) AS compressed_tokens"

SQL = {
    "token_summary_total": f"SELECT {_TOTALS} FROM token_events",
    "token_stats_by_tool": f"SELECT tool, {_TOTALS} FROM token_events GROUP BY tool ORDER BY tool",
    "token_stats_by_category": f"SELECT category, {_TOTALS} FROM token_events GROUP BY category ORDER BY category",
    "token_stats_grouping": f"""SELECT tool, category, CASE WHEN grouping(tool) + grouping(category) = 2 THEN 'total' WHEN grouping(tool) = 0 THEN 'tool' ELSE 'category' END AS level, {_TOTALS}
        FROM token_events GROUP BY GROUPING SETS ((), (tool), (category))""",
    "token_stats_session": f"SELECT category, {_TOTALS} FROM token_events WHERE session_id = '{HOT_SESSION}' GROUP BY category",
    "token_top_sessions": f"SELECT session_id, {_TOTALS} FROM token_events WHERE session_id IS NOT NULL GROUP BY session_id ORDER BY saved_tokens DESC, session_id LIMIT 20",
    "token_estimates": f"""
        WITH c AS (SELECT item_id, length(content) AS n, len(regexp_extract_all(content, '{X.WORD}')) AS w,
          len(regexp_extract_all(content, '{X.MARK}')) AS m, strlen(content) AS b FROM context_items)
        SELECT item_id, CASE WHEN n = 0 THEN 0 ELSE greatest(1, (n + 3) // 4, (w * 4 + 2) // 3) END AS by_words,
          greatest(1, n // 4 + m // 12) AS by_marks, b // 4 AS by_bytes FROM c""",
    "assumed_events": """
        WITH r AS (SELECT DISTINCT run_id, command_type, compressed_output FROM run_results),
        t AS (SELECT run_id, strlen(compressed_output) // 4 AS raw_tokens, CASE command_type WHEN 'test' THEN 8 WHEN 'git' THEN 10 WHEN 'lint' THEN 50 ELSE 80 END AS p FROM r)
        SELECT run_id, raw_tokens, raw_tokens * p // 100 AS compressed_tokens FROM t""",
    "benchmark_compression": """
        WITH e AS (SELECT DISTINCT id, category, estimated_raw_tokens AS r, estimated_compressed_tokens AS c FROM token_events),
        x AS (SELECT CASE WHEN coalesce(r, 0) = 0 THEN 0.0::DOUBLE ELSE (r - c)::DOUBLE / r END AS ratio FROM e WHERE category = 'file_read')
        SELECT count(*) AS cases, count(*) FILTER (WHERE ratio BETWEEN 0.5 AND 0.98) AS passed,
          count(*) FILTER (WHERE NOT coalesce(ratio BETWEEN 0.5 AND 0.98, false)) AS failed, round(coalesce(avg(ratio), 0.0), 6) AS mean_ratio FROM x""",
    "feedback_summary": """SELECT count(*) FILTER (WHERE exit_code > 1) AS bad, count(*) FILTER (WHERE exit_code = 1) AS fine, count(*) FILTER (WHERE exit_code = 0) AS good FROM run_results""",
    "quality_rating": """
        SELECT run_id, CASE WHEN coalesce(exit_code, 0) <> 0 OR coalesce(json_array_length(failures), 0) > 0 THEN 'Bad' WHEN duration_ms > 120000 THEN 'Warning' ELSE 'Good' END AS quality
        FROM (SELECT DISTINCT run_id, exit_code, failures, duration_ms FROM run_results)""",
    "experiment_report": """
        SELECT CASE item_id % 2 WHEN 0 THEN 'plain' ELSE 'tree' END AS pipeline, count(*) AS runs,
          round(avg((length(content) - strlen(content) / 4) / length(content)), 6) AS mean_ratio
        FROM context_items WHERE length(content) > 0 GROUP BY 1""",
    "savings_report_markdown": f"""
        SELECT '| measure | value |' || chr(10) || '| --- | --- |' || chr(10) || '| events | ' || events || ' |' || chr(10) || '| raw_tokens | ' || raw_tokens || ' |' || chr(10) ||
          '| compressed_tokens | ' || compressed_tokens || ' |' || chr(10) || '| saved_tokens | ' || saved_tokens || ' |' || chr(10) || '| savings | ' || printf('%.2f%%', savings_ratio * 100) || ' |' AS report
        FROM (SELECT {_TOTALS} FROM token_events)""",
    "savings_report_text": f"""
        SELECT 'events: ' || events || chr(10) || 'raw_tokens: ' || raw_tokens || chr(10) || 'compressed_tokens: ' || compressed_tokens || chr(10) ||
          'saved_tokens: ' || saved_tokens || chr(10) || 'savings: ' || printf('%.2f%%', savings_ratio * 100) AS report
        FROM (SELECT {_TOTALS} FROM token_events)""",
    "compaction_hints": """
        WITH e AS (SELECT DISTINCT id, session_id, estimated_raw_tokens AS r, created_at FROM token_events WHERE session_id IS NOT NULL),
        x AS (SELECT session_id, id, count(*) OVER w AS calls, CAST(sum(coalesce(r, 0)) OVER w AS BIGINT) AS tokens, coalesce(r, 0) AS own
          FROM e WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING))
        SELECT session_id, id, calls, tokens, 'calls' AS hint FROM x WHERE calls = 41
        UNION ALL SELECT session_id, id, calls, tokens, 'tokens' FROM x WHERE tokens > 500000 AND tokens - own <= 500000""",
    "metrics_snapshot": f"SELECT {_SNAPSHOT} FROM token_events GROUP BY subject",
    "snapshot_merge": f"SELECT {_SNAPSHOT} FROM token_events WHERE tool IN ('smart_edit', 'smart_read') GROUP BY subject",
    "timeline_last100": "SELECT id, tool, created_at FROM (SELECT DISTINCT id, tool, created_at FROM token_events) ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 100",
}
