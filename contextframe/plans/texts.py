"""Queries of text edits, shingles, sentences and files of the code index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextframe.functions import edits as X
from contextframe.operators import cluster as C
from contextframe.operators import tokens as T
from contextframe.plans.codegraph import SOURCES, code_files
from contextframe.plans.fixtures import Fixture
from contextframe.plans.memory import _NORM, _SENTENCES
from contextframe.sources import files as S
from contextframe.sources.python_symbols import python_symbols
from contextframe.sources.symbols import symbols
from contextframe.sources.tables import load

EDITS = Fixture(
    "id int, text string, old string, new string, first int, last int",
    [(1, "a b c", "b", "x", 1, 1), (2, "a b b", "b", "x", 1, 1), (3, "one\ntwo\nthree", "two", "2", 2, 3), (4, "one\ntwo", "none", "x", 2, 9), (5, "l1\nl2\nl3\nl4", "l3", "L", 2, 2)],
)
MANIFESTS = Fixture("path string, content string", [("Cargo.toml", '[workspace]\nmembers = ["core", "crates/*"]\n'), ("package.json", '{"workspaces": ["packages/*"]}')])
TREE = Fixture("path string, content string", [("core/lib.rs", ""), ("crates/a/lib.rs", ""), ("crates/b/lib.rs", ""), ("packages/x/i.ts", "")])


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "run_results", "run_id", "command", "command_type", "compressed_output").distinct()


def auto_observations(spark: SparkSession, d: str) -> DataFrame:
    """Records made from the runs: type, title, key and a short text."""
    tool = F.when(F.col("command_type") == "git", "smart_edit").otherwise("smart_run")
    rows = _runs(spark, d).select("run_id", tool.alias("tool"), F.col("command").alias("path"), F.col("compressed_output").alias("result"))
    return rows.where(~F.col("tool").isin(*X.SILENT)).select(
        "run_id", X.observation_type(F.col("tool"), F.col("result")).alias("type"), F.format_string("%s → %s", "tool", F.coalesce("path", F.lit("(no file)"))).alias("title"),
        X.dedup_hash(F.col("tool"), F.col("path"), F.col("result")).alias("dedup_hash"), X.truncate_at_word(F.col("result"), 200).alias("text"),
    )


def registered_functions(spark: SparkSession, d: str) -> DataFrame:
    """The library's SQL functions over the context items."""
    X.register(spark)
    load(spark, d, "context_items", "item_id", "content", "estimated_tokens").createOrReplaceTempView("cf_items")
    return spark.sql("SELECT item_id, cf_estimate_tokens(content) AS tokens, cf_savings_ratio(cf_estimate_tokens(content), estimated_tokens) AS ratio, cf_jaccard(array(content, 'a'), array('a')) AS same FROM cf_items")


QUERIES = {
    "auto_observations": auto_observations,
    "text_edits": lambda s, d: EDITS.df(s).select("id", X.replace_once(F.col("text"), F.col("old"), F.col("new")).alias("once"), X.replace_lines(F.col("text"), F.col("first"), F.col("last"), F.col("new")).alias("by_lines")),
    "text_edit_sequence": lambda s, d: EDITS.df(s).select("id", X.apply_edits(F.col("text"), F.array(F.struct(F.col("old").alias("old"), F.col("new").alias("new")), F.struct(F.col("new").alias("old"), F.lit("!").alias("new")))).alias("edited")),
    "guarded_edit": lambda s, d: EDITS.df(s).select("id", X.guarded(F.col("text"), F.sha2(F.when(F.col("id") < 3, F.col("text")).otherwise(F.lit("?")), 256), F.col("new")).alias("edited")),
    "relative_time": lambda s, d: s.range(0, 400_000, 7_777).select("id", X.relative_time(F.col("id")).alias("said")),
    "word_shingles": lambda s, d: load(s, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.size(C.shingles(F.col("text"), 4)).alias("shingles")),
    "sentences": lambda s, d: load(s, d, "observations", "id", "text").where("text IS NOT NULL").select("id", F.array_join(C.sentences(F.col("text")), " | ").alias("sentences"), F.array_join(C.norm_words(F.col("text")), " ").alias("words")),
    "workspace_members": lambda s, d: S.members(MANIFESTS.df(s), TREE.df(s)),
    "discovery_topk": lambda s, d: S.discover(load(s, d, "file_summaries", "path").distinct(), "server store query", 100),
    "python_symbols": lambda s, d: python_symbols(code_files(s, d).unionByName(SOURCES.df(s)).where("path LIKE '%.py'")).select("path", "name", "kind", "parent", "start_line", "end_line", "visibility"),
    "symbols_tree": lambda s, d: symbols(code_files(s, d).unionByName(SOURCES.df(s))).select("path", "name", "kind", "parent", "signature", "start_line", "end_line", "visibility"),
    "registered_functions": registered_functions,
    "resent_events": lambda s, d: load(s, d, "token_events", "id").groupBy("id").agg(F.count("*").alias("times")).where("times > 1"),
    "savings_ratio_check": lambda s, d: load(s, d, "token_events", "id", "estimated_raw_tokens", "estimated_compressed_tokens", "saved_tokens").distinct().select(
        "id", T.savings_ratio(F.col("estimated_raw_tokens"), F.col("estimated_compressed_tokens")).alias("ratio"), (F.col("saved_tokens") == F.col("estimated_raw_tokens") - F.col("estimated_compressed_tokens")).alias("agrees")
    ),
}

_RUNS = "(SELECT DISTINCT run_id, command, command_type, compressed_output AS r, CASE WHEN command_type = 'git' THEN 'smart_edit' ELSE 'smart_run' END AS tool FROM run_results)"
SQL = {
    "auto_observations": f"""
        SELECT run_id, CASE WHEN tool = 'smart_edit' THEN 'change' WHEN (contains(lower(r), 'failed') AND NOT contains(lower(r), '0 failed')) OR contains(lower(r), 'error[') OR contains(lower(r), 'error:') OR contains(r, 'FAILED') THEN 'bugfix' ELSE 'discovery' END AS type,
          tool || ' → ' || coalesce(command, '(no file)') AS title, sha256(tool || ':' || coalesce(command, '') || ':' || substring(r, 1, 100)) AS dedup_hash,
          CASE WHEN length(r) <= 200 THEN r ELSE CASE WHEN contains(substring(r, 1, 200), ' ') THEN regexp_replace(substring(r, 1, 200), '(?s) [^ ]*$', '') ELSE substring(r, 1, 200) END || '…' END AS text FROM {_RUNS}""",
    "text_edits": f"""
        WITH e AS (SELECT *, string_split(text, chr(10)) AS l FROM {EDITS.sql})
        SELECT id, CASE WHEN (length(text) - length(replace(text, old, ''))) // length(old) = 1 THEN replace(text, old, new) END AS once,
          CASE WHEN first >= 1 AND first <= last AND last <= len(l) THEN array_to_string(l[:first - 1] || [new] || l[last + 1:], chr(10)) END AS by_lines FROM e""",
    "text_edit_sequence": f"""
        WITH a AS (SELECT id, new, CASE WHEN (length(text) - length(replace(text, old, ''))) // length(old) = 1 THEN replace(text, old, new) END AS once FROM {EDITS.sql})
        SELECT id, CASE WHEN (length(once) - length(replace(once, new, ''))) // length(new) = 1 THEN replace(once, new, '!') END AS edited FROM a""",
    "workspace_members": f"""
        WITH q AS (SELECT unnest(regexp_extract_all(regexp_extract(content, '(?s)\\[workspace\\].*?members\\s*=\\s*\\[(.*?)\\]', 1), '"([^"]+)"', 1)) AS pattern FROM {MANIFESTS.sql} WHERE path = 'Cargo.toml'),
        f AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]+$', 1) AS folder FROM {TREE.sql})
        SELECT 'cargo' AS kind, pattern AS member FROM q WHERE NOT ends_with(pattern, '/*') UNION SELECT 'cargo', folder FROM f JOIN q ON regexp_extract(folder, '^(.*)/[^/]+$', 1) || '/*' = pattern""",
    "guarded_edit": f"SELECT id, CASE WHEN id < 3 THEN new END AS edited FROM {EDITS.sql}",
    "relative_time": "SELECT x AS id, CASE WHEN x < 60 THEN x || 's ago' WHEN x < 3600 THEN (x // 60) || 'm ago' WHEN x < 86400 THEN (x // 3600) || 'h ago' ELSE (x // 86400) || 'd ago' END AS said FROM range(0, 400000, 7777) AS t(x)",
    "word_shingles": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) AS shingles FROM w""",
    "sentences": f"""SELECT id, array_to_string({_SENTENCES.format(t="text")}, ' | ') AS sentences, array_to_string({_NORM.format(t="text")}, ' ') AS words FROM observations WHERE text IS NOT NULL""",
    "discovery_topk": """
        WITH f AS (SELECT DISTINCT path FROM file_summaries ORDER BY path LIMIT 100), p AS (SELECT path, row_number() OVER (ORDER BY path) AS pos, len(list_filter(['server', 'store', 'query'], lambda t: contains(lower(path), t))) AS score FROM f)
        SELECT path, pos, score, CASE WHEN score > 0 THEN 'Matched goal keywords' ELSE 'Fallback candidate' END AS reason FROM p""",
    "registered_functions": """
        WITH t AS (SELECT item_id, content, estimated_tokens, CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, (length(content) + 3) // 4, (len(regexp_extract_all(content, '[^\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+')) * 4 + 2) // 3) END AS tokens FROM context_items)
        SELECT item_id, tokens, CASE WHEN coalesce(tokens, 0) = 0 THEN 0.0::DOUBLE ELSE (tokens - estimated_tokens)::DOUBLE / tokens END AS ratio, CASE WHEN content = 'a' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS same FROM t""",
    "resent_events": "SELECT id, count(*) AS times FROM token_events GROUP BY id HAVING count(*) > 1",
    "savings_ratio_check": """
        SELECT id, CASE WHEN coalesce(r, 0) = 0 THEN 0.0::DOUBLE ELSE (r - c)::DOUBLE / r END AS ratio, s = r - c AS agrees
        FROM (SELECT DISTINCT id, estimated_raw_tokens AS r, estimated_compressed_tokens AS c, saved_tokens AS s FROM token_events)""",
}
