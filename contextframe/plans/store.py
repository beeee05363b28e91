"""Queries of the store's upserts and lists, of the index search, of project totals and of task packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextframe.operators import codegraph as G
from contextframe.operators import memory as M
from contextframe.operators import quality as Q
from contextframe.operators import search as S
from contextframe.operators import session as E
from contextframe.plans.codegraph import _CODE, _IMPORTS, _MARK, _TOKENS, SOURCES, _calls, _index, _lines, _symbols, code_files
from contextframe.plans.fixtures import Fixture
from contextframe.plans.memory import _rank_sql
from contextframe.plans.memory import QUERIES as MEMORY
from contextframe.sources import files
from contextframe.sources.tables import load

EVENTS = Fixture(
    "session_id string, seq int, tool string",
    [
        ("a", 1, "smart_edit"), ("a", 2, "pre_compact"), ("a", 3, "smart_read"), ("a", 4, "other"), ("a", 5, "post_compact"), ("a", 6, "smart_run"), ("a", 7, "pre_compact"), ("a", 8, "post_compact"), ("a", 9, "post_compact"),
        ("a", 10, "task_complete"), ("a", 11, "cwd_changed"), ("b", 1, "pre_compact"), ("b", 2, "post_compact"), ("b", 3, "smart_read"), ("c", 1, "x"),
    ],
)
DOCS = Fixture("path string, content string", [("docs/server.md", "# Server\n\nplain text\n"), ("docs/store.md", "one\ntwo"), ("notes/empty.md", "")])
ROOT = Fixture("path string, content string", [("package.json", "{}"), ("tests/a.test.ts", "x"), ("tests/b.rs", "y"), ("tests/deep/c.py", "z"), ("tests/readme.md", "n"), ("web/Cargo.toml", "t")])
IGNORED = "*.md\n# a comment\n/server/\nmodules/\n!modules/**\ncore/*.rs\n!core/*_a*.rs\n"


def health_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last health row of each summarised path, with its score."""
    rows = load(spark, d, "file_summaries", "summary_id", "path", "hash", "estimated_tokens").where("path IS NOT NULL")
    complexity, documentation = Q.after_read(F.coalesce("estimated_tokens", F.lit(0)), F.lit(1), F.col("hash").isNotNull())
    factors = {"test_coverage": F.pmod("summary_id", F.lit(101)).cast("int"), "stability": F.lit(50), "error_rate": F.lit(50), "complexity": complexity, "documentation": documentation}
    return M.health_rows(rows.select("*", F.col("path").alias("file"), F.col("summary_id").alias("seq")), factors)


def summaries_append(spark: SparkSession, d: str) -> DataFrame:
    """The summaries of the sessions appended to the records."""
    new = load(spark, d, "sessions", "id", "summary").where("summary IS NOT NULL").select(F.col("id").alias("seq"), F.col("id").alias("session_id"), F.col("summary").alias("text"))
    return M.appended(load(spark, d, "observations", "id", "session_id", "text"), new)


def merged_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The last hundred events and runs."""
    events = load(spark, d, "token_events", "id", "tool", "created_at").distinct().select(F.col("created_at").alias("at"), F.col("id").alias("key"), "tool")
    runs = load(spark, d, "run_results", "run_id", "finished_at", "command_type").distinct().select(F.col("finished_at").alias("at"), F.concat(F.lit("run:"), "run_id").alias("key"), F.col("command_type").alias("tool"))
    return M.merged_timeline([events, runs])


def searched_index(spark: SparkSession, d: str) -> DataFrame:
    """A search of the index of all records."""
    return S.search_postings(*S.postings(load(spark, d, "observations", "id", *S.COLUMNS)), 'search filter "release-branch"')


def state_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The sessions written as JSON and read again."""
    rows = load(spark, d, "sessions", "id", "project_path", "started_at", "summary")
    return E.from_json(E.as_json(rows, "id"), "id", "project_path string, started_at string, summary string")


def project_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the code files."""
    return files.totals(files.project_map(code_files(spark, d).unionByName(SOURCES.df(spark)), 5)).select("files", "loc", "symbols", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("suggested_start", ",").alias("suggested_start"))


def task_context(spark: SparkSession, d: str) -> DataFrame:
    """The package of a goal over the code files, which have an index."""
    return G.task_context(*_index(spark, d), code_files(spark, d), "look for the login", "login", 3)


def summary_context(spark: SparkSession, d: str) -> DataFrame:
    """The package of a goal over texts without an index."""
    docs = DOCS.df(spark)
    return G.task_context(G.symbols(docs), G.imports(docs), G.calls(docs), G.test_lines(docs), docs, "the server", "server", 3)


QUERIES = {
    "health_upsert": health_upsert,
    "summaries_append": summaries_append,
    "file_access_patterns": lambda s, d: M.most_accessed(MEMORY["file_access_upsert"](s, d).select("project", "file", "access_count")).limit(20),
    "compact_index": lambda s, d: M.compact_index(load(s, d, "observations", "id", "observation_type", "title"), 25),
    "merged_timeline": merged_timeline,
    "memory_search_postings": searched_index,
    "memory_search_accents": lambda s, d: S.search(load(s, d, "observations", "id", *S.COLUMNS), "uberschreibt", limit=50),
    "phase_compaction": lambda s, d: E.compacted_phases(EVENTS.df(s)),
    "state_round_trip": state_round_trip,
    "project_totals": project_totals,
    "project_tests": lambda s, d: Q.project_tests(ROOT.df(s)),
    "selective_command": lambda s, d: Q.selective_command(Q.selected_tests(ROOT.df(s), "", ["x", "y"]), "npm"),
    "task_context": task_context,
    "summary_context": summary_context,
    "ignored_paths": lambda s, d: load(s, d, "file_summaries", "path").where("path IS NOT NULL").distinct().select("path", files.by_rules(F.col("path"), files.ignore_rules(IGNORED)).alias("ignored")),
}

_T = _TOKENS.format(c="content", m=_MARK)
SQL = {
    "health_upsert": """
        WITH l AS (SELECT path AS file, (summary_id % 101)::INTEGER AS test_coverage, 50 AS stability, 50 AS error_rate, coalesce(estimated_tokens, 0) AS t, CASE WHEN hash IS NOT NULL THEN 80 ELSE 40 END AS documentation
          FROM file_summaries WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY summary_id DESC) = 1),
        c AS (SELECT *, CASE WHEN t <= 50 THEN 100 WHEN t <= 100 THEN 85 WHEN t <= 200 THEN 70 WHEN t <= 500 THEN 50 ELSE 30 END AS complexity FROM l)
        SELECT file, test_coverage, stability, error_rate, complexity, documentation,
          CAST(round(round(test_coverage * 0.25::DOUBLE + stability * 0.2::DOUBLE + error_rate * 0.2::DOUBLE + complexity * 0.2::DOUBLE + documentation * 0.15::DOUBLE, 6)) AS INTEGER) AS health FROM c""",
    "summaries_append": """
        SELECT id, session_id, text FROM observations
        UNION ALL SELECT (SELECT max(id) FROM observations) + row_number() OVER (ORDER BY id), id, summary FROM sessions WHERE summary IS NOT NULL""",
    "file_access_patterns": """
        SELECT session_id AS project, subject AS file, count(*) AS access_count FROM (SELECT DISTINCT id, session_id, subject, tool, created_at FROM token_events) GROUP BY 1, 2
        ORDER BY access_count DESC, project NULLS FIRST, file NULLS FIRST LIMIT 20""",
    "compact_index": "SELECT id, observation_type, title FROM observations ORDER BY id LIMIT 25",
    "merged_timeline": """
        SELECT "at", key, tool FROM (SELECT DISTINCT id AS key, tool, created_at AS "at" FROM token_events UNION ALL SELECT DISTINCT 'run:' || run_id, command_type, finished_at FROM run_results)
        WHERE "at" IS NOT NULL ORDER BY "at" DESC, key DESC LIMIT 100""",
    "memory_search_postings": _rank_sql('search filter "release-branch"'),
    "memory_search_accents": _rank_sql("uberschreibt", limit=50),
    "phase_compaction": f"""
        WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM {EVENTS.sql}),
        r AS (
          SELECT session_id, 0 AS seq, '' AS tool, 0::BIGINT AS k, 'Idle' AS phase, NULL::VARCHAR AS before FROM e WHERE k = 1
          UNION ALL SELECT e.session_id, e.seq, e.tool, e.k,
            CASE e.tool WHEN 'pre_compact' THEN 'Compacting' WHEN 'post_compact' THEN coalesce(r.before, 'Idle') WHEN 'cwd_changed' THEN 'Idle' {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.PHASES.items())} ELSE r.phase END,
            CASE e.tool WHEN 'pre_compact' THEN coalesce(r.before, r.phase) WHEN 'post_compact' THEN NULL ELSE r.before END
          FROM r JOIN e ON e.session_id = r.session_id AND e.k = r.k + 1)
        SELECT session_id, seq, tool, phase FROM r WHERE k > 0""",
    "state_round_trip": "SELECT id, project_path, started_at, summary FROM sessions",
    "project_totals": f"""
        WITH l AS (SELECT path, count(*) FILTER (WHERE trim(line) <> '') AS loc FROM {_lines(_CODE)} GROUP BY path), s AS (SELECT path, count(*) AS symbols FROM {_symbols(_CODE)} GROUP BY path),
        m AS (SELECT path, coalesce(loc, 0) AS loc, coalesce(symbols, 0) AS symbols FROM {_CODE} LEFT JOIN l USING (path) LEFT JOIN s USING (path)
          WHERE len(string_split(path, '/')) <= 5 AND NOT list_has_any(string_split(path, '/'), {list(files.IGNORED)!r}) AND lower(regexp_extract(path, '\\.([^./]+)$', 1)) NOT IN {files.BINARY!r}),
        d AS (SELECT CASE lower(regexp_extract(path, '([^/]*)$', 1)) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in files.MANIFESTS.items())} END AS kind, loc, path FROM m),
        k AS (SELECT kind, min(row(-loc, path)) AS p FROM d WHERE kind IS NOT NULL GROUP BY kind)
        SELECT count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(symbols) AS BIGINT) AS symbols, coalesce((SELECT string_agg(kind, ',' ORDER BY p) FROM k), '') AS dependencies,
          (SELECT string_agg(path, ',' ORDER BY loc DESC, path) FROM (SELECT path, loc FROM m ORDER BY loc DESC, path LIMIT 3)) AS suggested_start FROM m""",
    "project_tests": f"""
        WITH r AS (SELECT CASE WHEN bool_or(path = 'Cargo.toml') THEN 'cargo' WHEN bool_or(path = 'package.json') THEN 'npm' WHEN bool_or(path IN ('pytest.ini', 'setup.py')) THEN 'pytest' ELSE 'cargo' END AS runner,
          count(*) FILTER (WHERE regexp_matches(path, '^tests/[^/]*(\\.rs|\\.py|\\.test\\.ts|\\.test\\.js)$')) AS test_files FROM {ROOT.sql})
        SELECT runner, CASE runner WHEN 'npm' THEN 'npm test' WHEN 'pytest' THEN 'pytest' ELSE 'cargo test' END AS command, test_files FROM r""",
    "selective_command": f"SELECT 'npx jest ' || string_agg(DISTINCT path, ' ' ORDER BY path) AS command FROM {ROOT.sql} WHERE contains(content, 'x') OR contains(content, 'y')",
    "task_context": f"""
        WITH p AS (
          SELECT 1 AS section, path, line_no, 'Symbol: ' || kind || ' ' || name || ' in ' || path || ':' || line_no AS content FROM {_symbols(_CODE)} WHERE contains(lower(name), 'login')
          UNION ALL SELECT 2, path, line_no, 'Import: ' || path || ' -> ' || "import" FROM {_IMPORTS}
          UNION ALL SELECT 3, path, line_no, 'Call: ' || from_symbol || ' -> ' || to_symbol || ' in ' || path FROM {_calls(_CODE)}
          UNION ALL SELECT 4, path, line_no, 'Test: ' || path || ' references ' || trim(line) FROM {_lines(_CODE)} WHERE starts_with(trim(line), 'fn test_')),
        k AS (SELECT section, row_number() OVER (PARTITION BY section ORDER BY path, line_no, content) AS pos, content FROM p)
        SELECT 1 AS level, section, pos, content, {_T} AS tokens FROM k WHERE pos <= 3""",
    "summary_context": f"""
        WITH d AS (SELECT path, content, (contains(path, 'server'))::INTEGER AS score, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS l FROM {DOCS.sql}),
        s AS (SELECT row_number() OVER (ORDER BY score DESC, path) AS pos, CASE WHEN content = '' THEN path || ' is empty.' ELSE path || ': ' || length(content) || ' chars, ' || len(l) || ' lines' || chr(10) || array_to_string(l[:12], chr(10)) END AS content FROM d)
        SELECT 2 AS level, 5 AS section, pos, content, {_T} AS tokens FROM s""",
    "ignored_paths": """
        SELECT DISTINCT path, (path LIKE '%.md' AND NOT regexp_matches(path, '^modules/.')) OR path LIKE 'server/%' OR regexp_matches(path, '(^|/)modules/')
          OR (regexp_matches(path, '^core/[^/]*\\.rs$') AND NOT regexp_matches(path, '^core/[^/]*_a[^/]*\\.rs$')) AS ignored FROM file_summaries WHERE path IS NOT NULL""",
}
