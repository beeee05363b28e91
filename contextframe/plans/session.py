"""Queries of session state and learned patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextframe.operators import session as S
from contextframe.plans.fixtures import Fixture
from contextframe.sources.tables import load

ACTIONS = Fixture(
    "slot string, reader string, seq int, action string, value string",
    [
        ("goal", "a", 1, "write", "x"), ("goal", "a", 2, "read", None), ("goal", "b", 3, "read", None), ("goal", "a", 4, "write", "y"), ("goal", "a", 5, "read", None),
        ("goal", "a", 6, "clear", None), ("goal", "a", 7, "read", None), ("plan", "a", 8, "read", None), ("plan", "b", 9, "write", "p"), ("plan", "a", 10, "read", None),
        ("plan", "a", 11, "read", None), ("plan", "b", 12, "read", None), ("wrong", "a", 13, "write", "z"),
    ],
)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "token_events", "id", "session_id", "tool", "created_at").distinct().where("session_id IS NOT NULL AND created_at IS NOT NULL")
    return events.select("session_id", F.struct("created_at", "id").alias("seq"), "tool", "id")


def _touched(spark: SparkSession, d: str) -> DataFrame:
    sessions = load(spark, d, "sessions", "id", "files_touched")
    return sessions.select("id", F.explode(F.from_json("files_touched", "array<struct<path:string>>").getField("path")).alias("path"))


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    return S.pairs(load(spark, d, "lineitem", "l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


def phase_state(spark: SparkSession, d: str) -> DataFrame:
    """How many calls each session made in each phase."""
    return S.phases(_calls(spark, d), F.to_date("seq.created_at")).groupBy("session_id", "phase").agg(F.count("*").alias("calls"))


def seen_files(spark: SparkSession, d: str) -> DataFrame:
    """Whether the last summary of each path differs from the one before, by its hash."""
    rows = load(spark, d, "file_summaries", "summary_id", "path", "hash")
    last = rows.groupBy("path").agg(F.max_by("hash", "summary_id").alias("hash"), F.max("summary_id").alias("last"))
    seen = rows.join(last.select("path", "last"), "path").where("summary_id < last").select("path", F.col("hash").alias("seen_hash"), F.col("summary_id").alias("seq"))
    return S.stale(last.select("path", "hash"), seen)


def known_fix(spark: SparkSession, d: str) -> DataFrame:
    """The last suggestion after each recurring error."""
    runs = load(spark, d, "run_results", "run_id", "error_recurrence", "suggested_next").distinct()
    fixes = runs.select(F.get_json_object("error_recurrence", "$.hash").alias("signature"), F.try_element_at("suggested_next", F.lit(1)).alias("fix"), F.col("run_id").alias("seq"))
    return S.known_fixes(fixes.where("signature IS NOT NULL AND fix IS NOT NULL"))


QUERIES = {
    "phase_state": phase_state,
    "slot_fold": lambda s, d: S.slots(ACTIONS.df(s)),
    "slot_valid": lambda s, d: ACTIONS.df(s).select("seq", F.coalesce(S.valid_slot(F.col("slot"), F.coalesce("value", F.lit(""))), F.lit(False)).alias("valid")),
    "block_delivery": lambda s, d: S.blocks(ACTIONS.df(s).withColumnRenamed("slot", "block")),
    "seen_files": seen_files,
    "co_access_graph": lambda s, d: S.pairs(_touched(s, d), "id", "path"),
    "pattern_confidence": lambda s, d: _baskets(s, d).where("evidence > 1").withColumn("confidence", S.confidence(F.col("evidence"))),
    "pattern_decay_prune": lambda s, d: S.decayed(_baskets(s, d).withColumn("confidence", S.confidence(F.col("evidence"))), 0.05, 6, 0.28),
    "co_access_neighbours": lambda s, d: S.neighbours(_baskets(s, d).select(F.col("file_a").cast("string"), F.col("file_b").cast("string"), "evidence"), "100"),
    "known_fix": known_fix,
}

_PAIRS = "SELECT a.l_partkey AS file_a, b.l_partkey AS file_b, count(*) AS evidence FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2"
_CONF = "round(least(1.0::DOUBLE, 0.3::DOUBLE + 0.1::DOUBLE * (evidence - 1)), 6)"

SQL = {
    "phase_state": """
        WITH e AS (SELECT DISTINCT id, session_id, tool, created_at FROM token_events WHERE session_id IS NOT NULL AND created_at IS NOT NULL),
        p AS (SELECT session_id, coalesce(last_value(CASE tool WHEN 'smart_read' THEN 'Analyzing' WHEN 'smart_edit' THEN 'Editing' WHEN 'smart_run' THEN 'Verifying' WHEN 'task_complete' THEN 'Complete' END IGNORE NULLS)
          OVER (PARTITION BY session_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING), 'Idle') AS phase FROM e)
        SELECT session_id, phase, count(*) AS calls FROM p GROUP BY 1, 2""",
    "slot_fold": f"""
        WITH a AS (SELECT * FROM {ACTIONS.sql}), e AS (SELECT *, sum(CASE WHEN action = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY slot ORDER BY seq) AS ep FROM a),
        w AS (SELECT *, last_value(CASE WHEN action = 'write' THEN value END IGNORE NULLS) OVER (PARTITION BY slot, ep ORDER BY seq) AS v, sum(CASE WHEN action = 'read' THEN 1 ELSE 0 END) OVER (PARTITION BY slot, ep ORDER BY seq) AS r FROM e)
        SELECT slot, seq, v AS value, r = 1 AS "full" FROM w WHERE action = 'read'""",
    "slot_valid": f"SELECT seq, slot IN {S.SLOTS} AND strlen(coalesce(value, '')) <= 10000 AS valid FROM {ACTIONS.sql}",
    "block_delivery": f"""
        WITH v AS (SELECT *, CAST(sum(CASE WHEN action = 'write' THEN 1 ELSE 0 END) OVER (PARTITION BY slot ORDER BY seq) AS BIGINT) AS version FROM {ACTIONS.sql}),
        r AS (SELECT *, lag(version) OVER (PARTITION BY slot, reader ORDER BY seq) AS b FROM v WHERE action = 'read')
        SELECT slot AS block, reader, seq, version, CASE WHEN b IS NULL THEN 'full' WHEN b < version THEN 'changed' ELSE 'unchanged' END AS delivery FROM r""",
    "seen_files": """
        WITH o AS (SELECT path, hash, row_number() OVER (PARTITION BY path ORDER BY summary_id DESC) AS k FROM file_summaries),
        h AS (SELECT path, hash FROM o WHERE k = 1), s AS (SELECT path, hash FROM o WHERE k = 2)
        SELECT h.path, h.hash, s.path IS NULL OR h.hash IS DISTINCT FROM s.hash AS stale FROM h LEFT JOIN s ON h.path = s.path""",
    "co_access_graph": """
        WITH t AS (SELECT DISTINCT id, unnest(from_json(files_touched, '[{"path":"VARCHAR"}]')).path AS p FROM sessions)
        SELECT a.p AS file_a, b.p AS file_b, count(*) AS evidence FROM t a JOIN t b ON a.id = b.id AND a.p < b.p GROUP BY 1, 2""",
    "pattern_confidence": f"SELECT *, {_CONF} AS confidence FROM ({_PAIRS}) WHERE evidence > 1",
    "pattern_decay_prune": f"SELECT file_a, file_b, evidence, c AS confidence FROM (SELECT *, round({_CONF} * pow(0.95::DOUBLE, 6), 6) AS c FROM ({_PAIRS})) WHERE c >= 0.28",
    "co_access_neighbours": f"SELECT CASE WHEN file_a = 100 THEN file_b ELSE file_a END::VARCHAR AS file, evidence FROM ({_PAIRS}) WHERE file_a = 100 OR file_b = 100",
    "known_fix": """
        WITH f AS (SELECT json_extract_string(error_recurrence, '$.hash') AS signature, suggested_next[1] AS fix, run_id FROM (SELECT DISTINCT run_id, error_recurrence, suggested_next FROM run_results))
        SELECT signature, count(*) AS evidence, arg_max(fix, run_id) AS fix, round(least(1.0::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * (count(*) - 1)), 6) AS confidence
        FROM f WHERE signature IS NOT NULL AND fix IS NOT NULL GROUP BY 1""",
}
