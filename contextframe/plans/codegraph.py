"""Queries of the code graph, over the code among the context items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextframe.functions.logs import lines
from contextframe.operators import codegraph as G
from contextframe.plans.fixtures import Fixture
from contextframe.sources.tables import load

SOURCES = Fixture(
    "path string, content string",
    [
        ("src/auth.rs", "use std::fmt;\npub use crate::db::Pool;\nmod token;\n\npub fn login(user: &str) -> bool {\n    let ok = check_user(user);\n    audit(\"login(user)\");\n    ok\n}\n\nfn check_user(user: &str) -> bool { user.len() > 0 }\n\nfn test_login() {\n    assert!(login(\"a\"));\n}\n"),
        ("src/db.rs", "use crate::auth;\npub struct Pool;\nimpl Pool {\n    pub fn open() -> Pool { Pool }\n    fn close(self) { drop(self) }\n}\nenum Mode { A }\nenum Mode { B }\n"),
        ("app/main.py", "import os\n\ndef main():\n    run(os.getcwd())\n\nclass Runner:\n    def run(self):\n        return main()\n# main is not renamed here\nprint('main', main)\n"),
        ("web/index.ts", "export function render(x: number) { return draw(x); }\nexport class View {}\nexport interface Props {}\nfunction draw(x: number) { return x; }\n"),
        ("tests/auth_test.rs", "#[test]\nfn test_login() {\n    login(\"x\");\n}\nfn test_audit() { audit(\"\"); }\n"),
        ("docs/empty.md", ""),
    ],
)
GOAL = "Fix the login of auth"


def _files(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "context_items", "item_id", "content").where("content IS NOT NULL")
    return items.select(F.concat(F.lit("item/"), "item_id").alias("path"), "content")


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): the context items and code documents, each at a path of its own that ends as the stored one does."""
    items = load(spark, d, "context_items", "item_id", "path", "content").select(F.concat(F.lit("item/"), "item_id", F.lit("/"), F.coalesce("path", F.lit(""))).alias("path"), "content")
    documents = load(spark, d, "documents", "doc_id", "path", "kind", "text").where("kind = 'code'")
    return items.unionByName(documents.select(F.concat(F.lit("doc/"), "doc_id", F.lit("/"), F.coalesce("path", F.lit(""))).alias("path"), F.col("text").alias("content"))).where("content IS NOT NULL")


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    files = code_files(spark, d).unionByName(SOURCES.df(spark))
    return G.symbols(files), G.imports(files), G.calls(files), G.test_lines(files)


def budget_check(spark: SparkSession, d: str) -> DataFrame:
    """Budgets of the context packages."""
    packages = load(spark, d, "context_items", "package_id", "path", "estimated_tokens").groupBy("package_id").agg(F.count_distinct("path").alias("files"), F.count("*").alias("calls"), F.sum(F.coalesce("estimated_tokens", F.lit(0))).alias("tokens"))
    limits = {"files_read": 8, "tool_calls": 12, "context_tokens": 30_000}
    return packages.select("package_id", *G.budget(limits, {"files_read": F.col("files"), "tool_calls": F.col("calls"), "context_tokens": F.col("tokens")}))


def package_cut(spark: SparkSession, d: str) -> DataFrame:
    """The items of each package before 1,000 tokens are reached, by the larger of the stored and the counted tokens."""
    items = load(spark, d, "context_items", "item_id", "package_id", "content", "estimated_tokens")
    counted = G.estimate_tokens_marks(F.coalesce("content", F.lit("")))
    return G.within_tokens(items.select("item_id", "package_id", F.greatest(F.coalesce("estimated_tokens", F.lit(0)), counted).alias("tokens")), 1_000, ["package_id"], ["item_id"])


def path_rank(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the summaries by the words of a goal."""
    paths = load(spark, d, "file_summaries", "summary_id", "path").select("path", F.col("summary_id").alias("pos"))
    return G.rank_paths(paths, "look for the server store in query")


QUERIES = {
    "symbols_regex": lambda s, d: G.symbols(_files(s, d)),
    "import_edges": lambda s, d: _index(s, d)[1],
    "call_edges": lambda s, d: G.calls(_files(s, d)),
    "test_refs": lambda s, d: _index(s, d)[3],
    "find_symbol": lambda s, d: G.find(G.symbols(_files(s, d)), "name", "Token"),
    "find_callers": lambda s, d: G.find(_index(s, d)[2], "to_symbol", "login", fold=False),
    "find_tests": lambda s, d: G.find(_index(s, d)[3], "test", "login", fold=False),
    "outline": lambda s, d: _index(s, d)[0].where("path = 'src/db.rs'").select("name", "kind", "line_no"),
    "diff_impact": lambda s, d: G.impact("src/auth.rs", _index(s, d)[0], _index(s, d)[1], _index(s, d)[3]),
    "context_package": lambda s, d: G.context_items(*_index(s, d), "login", 3),
    "budget_check": budget_check,
    "package_token_cut": package_cut,
    "route_tier": lambda s, d: G.symbols(_files(s, d)).groupBy("path").agg(F.count("*").alias("n")).select("path", G.tier(F.col("n"), F.col("n"), F.lit(0)).alias("tier")),
    "path_rank": path_rank,
    "file_summary_text": lambda s, d: _files(s, d).select("path", G.summary(F.col("path"), F.col("content")).alias("summary")),
    "code_search": lambda s, d: G.grep(_files(s, d), "return", 20),
    "focused_context": lambda s, d: G.focused(_files(s, d), "token", 5),
    "skeletons": lambda s, d: G.skeleton(_index(s, d)[0], code_files(s, d).unionByName(SOURCES.df(s))),
    "read_mode": lambda s, d: _files(s, d).select("path", G.read_mode(F.size(lines(F.col("content"))), F.lit(False)).alias("mode")),
    "rename_preview": lambda s, d: G.renames(code_files(s, d).unionByName(SOURCES.df(s)), "path", "place"),
    "language_detect": lambda s, d: load(s, d, "file_summaries", "summary_id", "path").select(
        "summary_id", G.language(F.col("path"), G.READ_LANGUAGES).alias("read"), G.language(F.col("path"), G.INDEX_LANGUAGES, "Unknown").alias("index"), G.language(F.col("path"), G.MAP_LANGUAGES, fold=True).alias("map"),
        G.intelligence(G.language(F.col("path"), G.READ_LANGUAGES), F.lit(False)).alias("level"),
    ),
    "index_counts": lambda s, d: G.index_counts(*_index(s, d)),
    "index_build": lambda s, d: G.index_counts(*G.build_index(code_files(s, d).unionByName(SOURCES.df(s)), 50).values()),
    "symbol_visibility": lambda s, d: _index(s, d)[0].join(G.numbered(code_files(s, d).unionByName(SOURCES.df(s))), ["path", "line_no"]).select("path", "name", G.visibility(G.language(F.col("path"), G.READ_LANGUAGES), F.trim("line"), F.col("name")).alias("visibility")),
}

_ITEMS = "(SELECT 'item/' || item_id AS path, content FROM context_items WHERE content IS NOT NULL)"
_CODE = f"""(SELECT 'item/' || item_id || '/' || coalesce(path, '') AS path, content FROM context_items WHERE content IS NOT NULL
  UNION ALL SELECT 'doc/' || doc_id || '/' || coalesce(path, ''), text FROM documents WHERE kind = 'code' AND text IS NOT NULL UNION ALL SELECT path, content FROM {SOURCES.sql})"""
_CANDIDATES = f"(SELECT path, content FROM {_CODE} WHERE ends_with(path, '.rs') ORDER BY path LIMIT 50)"
_PARTS = "string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))"
_LIST = f"CASE WHEN {_PARTS}[-1] = '' THEN {_PARTS}[:-2] ELSE {_PARTS} END"


def _lines(files: str) -> str:
    return f"(SELECT path, i::INTEGER AS line_no, l[i] AS line FROM (SELECT path, {_LIST} AS l FROM {files}), unnest(range(1, len(l) + 1)) AS u(i))"


def _symbols(files: str) -> str:
    cases = " ".join(f"WHEN regexp_extract(line, '{p}', 1) <> '' THEN {{}}" for p, _ in G.SYMBOLS)
    name = cases.format(*[f"regexp_extract(line, '{p}', 1)" for p, _ in G.SYMBOLS])
    kind = cases.format(*[f"'{k}'" for _, k in G.SYMBOLS])
    return f"""(SELECT path, line_no, name, kind FROM (SELECT *, lag(name) OVER (PARTITION BY path ORDER BY line_no) AS b FROM
        (SELECT path, line_no, CASE {name} END AS name, CASE {kind} END AS kind FROM {_lines(files)}) WHERE name IS NOT NULL) WHERE b IS NULL OR b <> name)"""


def _calls(files: str) -> str:
    return f"""(SELECT path, line_no, from_symbol, to_symbol FROM (
      SELECT path, line_no, t, from_symbol, unnest(list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}_]'), lambda x: strlen(x) > 2)) AS to_symbol FROM (
        SELECT path, line_no, t, coalesce(last_value(CASE WHEN regexp_matches(t, '^(?:pub )?fn ') THEN trim(regexp_extract(t, '^(?:pub )?fn ([^(]*)', 1)) END IGNORE NULLS)
          OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING), '<module>') AS from_symbol FROM (SELECT path, line_no, trim(line) AS t FROM {_lines(files)})))
      WHERE contains(t, to_symbol || '(') AND to_symbol <> from_symbol)"""


_IMPORTS = f"(SELECT path, line_no, regexp_replace(trim(line), ';+$', '') AS \"import\" FROM {_lines(_CODE)} WHERE regexp_matches(trim(line), '^(?:use |pub use |mod )'))"
_TESTS = f"(SELECT path, line_no, trim(line) AS test FROM {_lines(_CODE)} WHERE starts_with(trim(line), 'fn test_'))"
_TOKENS = "greatest(1, length({c}) // 4 + len(regexp_extract_all({c}, '{m}')) // 12)"
_MARK = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}!-/:-@\[-`{-~]"


def _language(languages: dict[str, str], otherwise: str, fold: bool = False) -> str:
    end = "regexp_extract(path, '[^/]\\.([^./]+)$', 1)"
    end = f"lower({end})" if fold else end
    cases = " ".join(f"WHEN {end} IN ({', '.join(repr(e) for e in ends.split())}) THEN '{name}'" for name, ends in languages.items())
    return f"CASE {cases} ELSE {otherwise} END"


SQL = {
    "symbols_regex": f"SELECT * FROM {_symbols(_ITEMS)}",
    "import_edges": f"SELECT * FROM {_IMPORTS}",
    "call_edges": f"SELECT * FROM {_calls(_ITEMS)}",
    "test_refs": f"SELECT * FROM {_TESTS}",
    "find_symbol": f"SELECT * FROM {_symbols(_ITEMS)} WHERE contains(lower(name), 'token')",
    "find_callers": f"SELECT * FROM {_calls(_CODE)} WHERE contains(to_symbol, 'login')",
    "find_tests": f"SELECT * FROM {_TESTS} WHERE contains(test, 'login')",
    "outline": f"SELECT name, kind, line_no FROM {_symbols(_CODE)} WHERE path = 'src/db.rs'",
    "diff_impact": f"""
        SELECT 'src/auth.rs' AS changed_path, *, 3 * symbols + 2 * imports + tests AS risk_score FROM (SELECT
          (SELECT count(*) FROM {_symbols(_CODE)} WHERE path = 'src/auth.rs') AS symbols, (SELECT count(*) FROM {_IMPORTS} WHERE path = 'src/auth.rs') AS imports,
          (SELECT count(*) FROM {_TESTS} WHERE path = 'src/auth.rs') AS tests)""",
    "context_package": f"""
        WITH p AS (
          SELECT 1 AS section, path, line_no, 'Symbol: ' || kind || ' ' || name || ' in ' || path || ':' || line_no AS content FROM {_symbols(_CODE)} WHERE contains(lower(name), 'login')
          UNION ALL SELECT 2, path, line_no, 'Import: ' || path || ' -> ' || "import" FROM {_IMPORTS}
          UNION ALL SELECT 3, path, line_no, 'Call: ' || from_symbol || ' -> ' || to_symbol || ' in ' || path FROM {_calls(_CODE)}
          UNION ALL SELECT 4, path, line_no, 'Test: ' || path || ' references ' || test FROM {_TESTS}),
        k AS (SELECT section, row_number() OVER (PARTITION BY section ORDER BY path, line_no, content) AS pos, content FROM p)
        SELECT section, pos, content, {_TOKENS.format(c="content", m=_MARK)} AS tokens FROM k WHERE pos <= 3""",
    "budget_check": """
        WITH p AS (SELECT package_id, count(DISTINCT path) AS f, count(*) AS c, CAST(sum(coalesce(estimated_tokens, 0)) AS BIGINT) AS t FROM context_items GROUP BY 1)
        SELECT package_id, 8 - f AS files_read_left, 12 - c AS tool_calls_left, 30000 - t AS context_tokens_left, f <= 8 AND c <= 12 AND t <= 30000 AS ok, 30000 - t < 5000 AS nearly_spent FROM p""",
    "package_token_cut": f"""
        WITH i AS (SELECT item_id, package_id, greatest(coalesce(estimated_tokens, 0), {_TOKENS.format(c="coalesce(content, '')", m=_MARK)}) AS tokens FROM context_items)
        SELECT item_id, package_id, tokens FROM i QUALIFY coalesce(sum(tokens) OVER (PARTITION BY package_id ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 1000""",
    "route_tier": f"SELECT path, CASE WHEN 4 * count(*) < 20 THEN 'Cheap' WHEN 4 * count(*) < 80 THEN 'Balanced' ELSE 'Premium' END AS tier FROM {_symbols(_ITEMS)} GROUP BY path",
    "path_rank": """
        SELECT path, pos, score, CASE WHEN score > 0 THEN 'Matched goal keywords' ELSE 'Fallback candidate' END AS reason FROM (
          SELECT path, summary_id AS pos, len(list_filter(['look', 'for', 'the', 'server', 'store', 'query'], lambda t: contains(lower(path), t))) AS score FROM file_summaries)""",
    "file_summary_text": f"""
        SELECT path, CASE WHEN content = '' THEN path || ' is empty.' ELSE path || ': ' || length(content) || ' chars, ' || len(l) || ' lines' || chr(10) || array_to_string(l[:12], chr(10)) END AS summary
        FROM (SELECT path, content, {_LIST} AS l FROM {_ITEMS})""",
    "code_search": f"""
        SELECT path, line_no, line, nullif(regexp_extract(trim(line), '^(?:fn|struct|enum|class|interface|trait) (\\w+)', 1), '') AS symbol FROM {_lines(_ITEMS)}
        WHERE contains(line, 'return') ORDER BY path, line_no LIMIT 20""",
    "focused_context": f"""
        SELECT path, line_no, line FROM {_lines(_ITEMS)} QUALIFY max(contains(line, 'token')::INTEGER) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) = 1""",
    "skeletons": f"""
        SELECT path, string_agg(lpad(line_no::VARCHAR, 4, ' ') || '| ' || line, chr(10) ORDER BY line_no) AS skeleton
        FROM {_lines(_CODE)} JOIN {_symbols(_CODE)} USING (path, line_no) GROUP BY path""",
    "rename_preview": rf"""
        SELECT path, line_no, line AS before, regexp_replace(line, '\bpath\b', 'place', 'g') AS after FROM (
          SELECT *, list_transform(range(1, len(p)), lambda i: array_to_string(p[1:i], 'path')) AS b FROM (SELECT *, regexp_split_to_array(line, '\bpath\b') AS p FROM {_lines(_CODE)} WHERE regexp_matches(line, '\bpath\b')))
        WHERE NOT regexp_matches(line, '^ *(?://|#|--|;;|%|/\*|\*)') AND len(list_filter(b, lambda x: {" AND ".join(f"(len(regexp_extract_all(regexp_replace(x, $r$\\{q}$r$, '', 'g'), $r${q}$r$)) % 2 = 0)" for q in ("'", '"', "`"))})) > 0""",
    "index_counts": f"""
        SELECT (SELECT count(*) FROM {_symbols(_CODE)}) AS symbols, (SELECT count(*) FROM {_IMPORTS}) AS imports, (SELECT count(*) FROM {_calls(_CODE)}) AS calls, (SELECT count(*) FROM {_TESTS}) AS tests""",
    "index_build": f"""
        SELECT (SELECT count(*) FROM {_symbols(_CANDIDATES)}) AS symbols, (SELECT count(*) FROM {_lines(_CANDIDATES)} WHERE regexp_matches(trim(line), '^(?:use |pub use |mod )')) AS imports,
          (SELECT count(*) FROM {_calls(_CANDIDATES)}) AS calls, (SELECT count(*) FROM {_lines(_CANDIDATES)} WHERE starts_with(trim(line), 'fn test_')) AS tests""",
    "read_mode": f"SELECT path, CASE WHEN len({_LIST}) < 100 THEN 'full' ELSE 'skeleton' END AS mode FROM {_ITEMS}",
    "language_detect": f"""
        SELECT summary_id, {_language(G.READ_LANGUAGES, "NULL")} AS read, {_language(G.INDEX_LANGUAGES, "'Unknown'")} AS "index", {_language(G.MAP_LANGUAGES, "NULL", True)} AS "map",
          CASE WHEN {_language(G.READ_LANGUAGES, "NULL")} IS NOT NULL THEN 'tree' ELSE 'pattern' END AS level FROM file_summaries""",
    "symbol_visibility": f"""
        SELECT path, name, CASE WHEN path LIKE '%.rs' THEN CASE WHEN starts_with(trim(line), 'pub') THEN 'public' ELSE 'private' END
          WHEN path LIKE '%.py' THEN CASE WHEN starts_with(name, '_') THEN 'private' ELSE 'public' END
          WHEN regexp_matches(path, '\\.[tj]sx?$') THEN CASE WHEN starts_with(trim(line), 'export') THEN 'public' ELSE 'private' END
          WHEN path LIKE '%.go' THEN CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'public' ELSE 'private' END
          WHEN regexp_matches(path, '\\.(?:java|php|swift|cpp|cc|cxx|hpp|hh|hxx|c|h)$') THEN CASE WHEN regexp_matches(line, '\\bprivate\\b') THEN 'private' WHEN regexp_matches(line, '\\bprotected\\b') THEN 'protected' WHEN NOT regexp_matches(path, '\\.[ch]$') THEN 'public' END
          WHEN regexp_matches(line, '\\bprivate\\b') THEN 'private' WHEN regexp_matches(line, '\\bprotected\\b') THEN 'protected' END AS visibility
        FROM {_symbols(_CODE)} JOIN {_lines(_CODE)} USING (path, line_no)""",
}
