"""Queries of command output and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextframe.functions import logs as L
from contextframe.plans.fixtures import LOGS
from contextframe.operators.session import loops
from contextframe.sources.tables import load

MOST = 6


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """The runs, each once, and literal ones of formats that the table does not hold."""
    runs = load(spark, d, "run_results", "run_id", "command", "command_type", "raw_lines", "compressed_lines", "compressed_output").distinct()
    return runs.unionByName(LOGS.df(spark).select((-F.col("id")).cast("bigint").alias("run_id"), "command", F.col("raw").alias("compressed_output")), allowMissingColumns=True)


def _outputs(how):  # noqa: ANN001, ANN202
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _runs(spark, d).select("run_id", how(F.col("compressed_output"), MOST).alias("short"))

    return query


def search_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """How many output lines name each file first."""
    line = _runs(spark, d).select(F.explode(L.lines(F.col("compressed_output"))).alias("line"))
    return line.where(F.col("line").contains(":")).groupBy(F.substring_index("line", ":", 1).alias("prefix")).agg(F.count("*").alias("lines"))


def diff_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files, additions and deletions of all diffs among the context items."""
    files = load(spark, d, "context_items", "item_id", "content").where(F.col("content").contains("diff --git")).select("item_id", F.explode(L.diff_files(F.col("content"))).alias("f"))
    return files.groupBy("item_id").agg(F.count("*").alias("files"), F.sum("f.added").alias("additions"), F.sum("f.removed").alias("deletions"), F.sum("f.hunks").alias("hunks"))


def error_loops(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose runs failed at least three times with the same kind and exit code."""
    runs = load(spark, d, "run_results", "run_id", "session_id", "command_type", "exit_code").distinct().where("exit_code <> 0 AND session_id IS NOT NULL")
    return loops(runs.select("session_id", F.concat_ws(":", "command_type", "exit_code").alias("signature")))


def context_triage(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the context items by what they are about."""
    line = load(spark, d, "context_items", "item_id", "content").select("item_id", F.explode(L.lines(F.col("content"))).alias("line")).where("trim(line) <> ''")
    return line.groupBy("item_id", L.triage(F.col("line")).alias("about")).agg(F.count("*").alias("lines"))


QUERIES = {
    "classify_command": lambda s, d: _runs(s, d).select("run_id", L.classify(F.col("command")).alias("kind")),
    "compress_generic": lambda s, d: _runs(s, d).select("run_id", L.generic(F.col("compressed_output"), MOST).alias("short")),
    "compress_search": lambda s, d: _runs(s, d).select("run_id", L.search(F.col("compressed_output"), MOST).alias("short")),
    "compress_git": lambda s, d: load(s, d, "context_items", "item_id", "content").select("item_id", L.git(F.col("content"), MOST).alias("short")),
    "compress_test": _outputs(L.test_output),
    "compress_compiler": _outputs(L.compiler),
    "compress_linter": _outputs(L.linter),
    "compress_packages": _outputs(L.package_manager),
    "compress_formatter": _outputs(L.formatter),
    "compress_dispatch": lambda s, d: _runs(s, d).select("run_id", L.classify(F.col("command")).alias("kind"), L.compress(F.col("command"), F.col("compressed_output"), MOST).alias("short")),
    "search_prefixes": search_prefixes,
    "diff_totals": diff_totals,
    "error_signature": lambda s, d: _runs(s, d).select("run_id", L.error_signature(F.col("compressed_output")).alias("signature")),
    "error_loops": error_loops,
    "run_summary_line": lambda s, d: _runs(s, d).select("run_id", L.summary_line(L.classify(F.col("command")), F.col("compressed_output"), F.col("compressed_output")).alias("summary")),
    "line_ratio": lambda s, d: _runs(s, d).select("run_id", L.line_ratio(F.col("raw_lines"), F.col("compressed_lines")).alias("ratio")),
    "bounded_output": lambda s, d: load(s, d, "context_items", "item_id", "content").select("item_id", F.octet_length(L.bounded(F.repeat(F.col("content"), 50))).alias("bytes")),
    "relevant_test_errors": lambda s, d: _runs(s, d).select("run_id", F.array_join(L.test_errors(F.col("compressed_output")), "\n").alias("errors"), F.array_join(F.array_sort(L.file_hints(F.col("compressed_output"))), ",").alias("files")),
    "project_context_triage": context_triage,
}

_RUNS = f"(SELECT DISTINCT run_id, command, command_type, raw_lines, compressed_lines, compressed_output FROM run_results UNION ALL SELECT -id, command, NULL, NULL, NULL, raw FROM {LOGS.sql})"
_ALL = "string_split(replace({t}, chr(13) || chr(10), chr(10)), chr(10))"


def _lines(text: str) -> str:
    parts = _ALL.format(t=text)
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def _join(parts: str) -> str:
    return f"array_to_string({parts}, chr(10))"


def _generic(table: str, key: str, text: str) -> str:
    return f"""
        SELECT {key}, CASE WHEN len(l) <= {MOST} THEN {text} ELSE {_join(f"l[:4] || ['... ' || (len(l) - {MOST}) || ' Zeilen ausgelassen ...'] || l[-2:]")} END AS short
        FROM (SELECT {key}, {text}, {_lines(text)} AS l FROM {table})"""


_KIND = """CASE
  WHEN two IN ('cargo test', 'go test', 'npm test', 'npx vitest', 'npx jest') OR one IN ('pytest', 'jest', 'phpunit') THEN 'test_runner'
  WHEN two IN ('cargo build', 'go build') OR one IN ('rustc', 'tsc', 'gcc', 'g++', 'javac') THEN 'compiler'
  WHEN two = 'cargo clippy' OR one IN ('eslint', 'ruff', 'phpstan', 'golangci-lint', 'pylint') THEN 'linter'
  WHEN trim(command) LIKE 'git %' THEN 'git_info'
  WHEN two IN ('cargo add', 'npm install', 'pip install', 'go get', 'yarn add') THEN 'package_mgr'
  WHEN one IN ('rustfmt', 'prettier', 'black', 'gofmt') THEN 'formatter'
  WHEN one IN ('grep', 'rg', 'ag', 'find', 'fd') THEN 'search' ELSE 'generic' END"""
_WORDS = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"
_CLASSIFIED = "(SELECT *, w[1] AS one, array_to_string(w[1:2], ' ') AS two FROM (SELECT *, " + _WORDS.format(c="command") + " AS w FROM {t}))"
_SIGNED = f"""(SELECT *, list_filter(l, lambda x: lower(trim(x)) LIKE 'error%' OR lower(x) LIKE '%panic%' OR (lower(x) LIKE '%failed%' AND NOT lower(x) LIKE '%0 failed%')) AS e
  FROM (SELECT *, {_lines("compressed_output")} AS l FROM {{t}}))"""
_SIGNATURE = r"CASE WHEN len(e) = 0 THEN '' ELSE left(sha256(regexp_replace(array_to_string(e, chr(10)), '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[Z\w]*', '<TS>', 'g')), 16) END"
_DIFF = """
WITH x AS (SELECT item_id, i, l[i] AS x FROM (SELECT item_id, {lines} AS l FROM context_items WHERE content LIKE '%diff --git%'), unnest(range(1, len(l) + 1)) AS u(i)),
g AS (SELECT *, sum(CASE WHEN starts_with(x, 'diff --git ') THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY i) AS f FROM x),
files AS (SELECT item_id, f, max(CASE WHEN starts_with(x, 'diff --git ') THEN regexp_replace(regexp_extract(trim(x), '\\S+$'), '^(?:b/)+', '') END) AS path,
  count(*) FILTER (WHERE x LIKE '+%' AND NOT x LIKE '+++%') AS added, count(*) FILTER (WHERE x LIKE '-%' AND NOT x LIKE '---%') AS removed, count(*) FILTER (WHERE x LIKE '@@%') AS hunks
  FROM g WHERE f > 0 GROUP BY item_id, f)
""".replace("{lines}", _lines("content"))
_RAW = f"(SELECT run_id AS id, compressed_output AS raw FROM {_RUNS})"
_BLOCK = f"""
WITH x AS (SELECT id, raw, i, l[i] AS x, l[i + 1] AS y, len(l) AS n FROM (SELECT id, raw, {_lines("raw")} AS l FROM {_RAW}), unnest(range(1, len(l) + 1)) AS u(i)),
"""

_PLACED = f"""
WITH t AS (SELECT run_id, command, compressed_output AS raw, {_lines("compressed_output")} AS l FROM {_RUNS}),
"""
#: Errors that fit whatever came before, then closing lines, then warnings up to the first that does not fit.
_COMPILER = f"""
cb AS (SELECT *, list_transform(range(1, len(l) + 1), lambda i: {{'x': l[i], 'b': l[i] || CASE WHEN coalesce(ltrim(l[i + 1]) LIKE '-->%', false) THEN chr(10) || l[i + 1] ELSE '' END, 's': CASE WHEN coalesce(ltrim(l[i + 1]) LIKE '-->%', false) THEN 2 ELSE 1 END}}) AS b FROM t),
ce AS (SELECT *, list_filter(l, lambda x: starts_with(x, 'error: aborting') OR starts_with(x, 'error: could not compile')) AS ends,
  list_reduce(list_filter(b, lambda e: NOT starts_with(e.x, 'error: aborting') AND NOT starts_with(e.x, 'error: could not compile') AND (starts_with(e.x, 'error[') OR (starts_with(e.x, 'error') AND contains(e.x, ']:')))),
    lambda a, e: CASE WHEN a.s + e.s <= {MOST} THEN {{'x': '', 'b': CASE WHEN a.s = 0 THEN e.b ELSE a.b || chr(10) || e.b END, 's': a.s + e.s}} ELSE a END, {{'x': '', 'b': '', 's': 0}}) AS e FROM cb),
cs AS (SELECT *, ends[:greatest({MOST} - e.s, 0)] AS shown FROM ce),
cw AS (SELECT *, list_reduce(list_filter(b, lambda w: starts_with(w.x, 'warning:')),
    lambda a, w: CASE WHEN a.x = '' AND a.s + w.s <= {MOST} THEN {{'x': '', 'b': a.b || chr(10) || w.b, 's': a.s + w.s}} ELSE {{'x': 'full', 'b': a.b, 's': a.s}} END, {{'x': '', 'b': '', 's': (e.s + len(shown))::INTEGER}}) AS w FROM cs),
compiler AS (SELECT run_id, CASE WHEN len(l) <= {MOST} THEN raw ELSE ltrim(e.b || CASE WHEN len(shown) > 0 THEN chr(10) || {_join("shown")} ELSE '' END || w.b, chr(10)) END AS short FROM cw),
"""
#: Blocks of failed tests: from a heading to the next one or to the list of failures; three lines that are not blank of each.
_TESTS = f"""
tx AS (SELECT run_id, i, l[i] AS x FROM t, unnest(range(1, len(l) + 1)) AS u(i)),
tm AS (SELECT *, starts_with(x, '---- ') AND ends_with(x, ' stdout ----') AS begins, starts_with(x, '---- ') OR starts_with(x, 'failures:') AS marks FROM tx),
tg AS (SELECT *, sum(marks::INT) OVER (PARTITION BY run_id ORDER BY i) AS g FROM tm),
th AS (SELECT run_id, g, i AS first, regexp_replace(regexp_replace(x, '^(?:---- )+', ''), '(?: stdout ----)+$', '') AS name FROM tg WHERE begins),
tl AS (SELECT th.run_id, th.g, first, name, trim(x) AS x, i, row_number() OVER (PARTITION BY th.run_id, th.g ORDER BY i) AS k FROM th JOIN tg ON tg.run_id = th.run_id AND tg.g = th.g AND NOT marks AND trim(x) <> ''),
tb AS (SELECT th.run_id, th.first, '  ' || th.name || ' — ' || coalesce((SELECT string_agg(x, ' | ' ORDER BY i) FROM tl WHERE tl.run_id = th.run_id AND tl.g = th.g AND k <= 3), '') AS entry FROM th),
te AS (SELECT run_id, list(entry ORDER BY first) AS entries FROM tb GROUP BY run_id),
tr AS (SELECT t.*, list_filter(l, lambda x: starts_with(x, 'test result:'))[1] AS result, coalesce(entries, []) AS entries, list_filter(l, lambda x: starts_with(x, '=') AND (contains(x, 'passed') OR contains(x, 'failed')))[1] AS session,
  list_transform(list_filter(l, lambda x: starts_with(x, 'FAILED ')), lambda x: trim(regexp_replace(x, '^(?:FAILED )+', ''))) AS failed FROM t LEFT JOIN te USING (run_id)),
ts AS (SELECT *, list_transform(failed, lambda x: '  ' || CASE WHEN contains(x, ' - ') AND NOT ends_with(x, ' - ') THEN regexp_replace(x, '^(.*?) - ', '\\1 — ') ELSE regexp_replace(x, ' - $', '') END) AS failures FROM tr),
test_runner AS (SELECT run_id, CASE WHEN len(l) <= {MOST} THEN raw
  WHEN result IS NOT NULL THEN result || CASE WHEN len(entries) > 0 THEN chr(10) || chr(10) || 'Failures:' || chr(10) || {_join(f"entries[:{max(MOST - 4, 1)}]")} ELSE '' END
  WHEN contains(raw, 'test session starts') AND session IS NOT NULL THEN trim(regexp_replace(session, '^=+|=+$', '', 'g')) || CASE WHEN len(failures) > 0 THEN chr(10) || chr(10) || 'Failures:' || chr(10) || {_join(f"failures[:{max(MOST - 4, 1)}]")} ELSE '' END
  ELSE g.short END AS short FROM ts JOIN ({_generic(_RUNS, "run_id", "compressed_output")}) g USING (run_id))
"""
_FIRST = "list_filter(l, lambda x: {c})[1]"

SQL = {
    "compress_compiler": _PLACED + _COMPILER.rstrip().rstrip(",") + " SELECT * FROM compiler",
    "compress_test": _PLACED + _TESTS + " SELECT * FROM test_runner",
    "run_summary_line": f"""
        WITH k AS (SELECT run_id, {_KIND} AS kind FROM {_CLASSIFIED.format(t=_RUNS)}), t AS (SELECT run_id, {_lines("compressed_output")} AS l FROM {_RUNS}),
        p AS (SELECT k.*, l, {_FIRST.format(c="starts_with(x, 'error[') OR starts_with(x, 'error:')")} AS error, {_FIRST.format(c="starts_with(x, 'error[') OR starts_with(x, 'error:') OR starts_with(x, 'warning:')")} AS issue,
          {_FIRST.format(c="starts_with(x, 'test result:')")} AS result, trim(regexp_replace({_FIRST.format(c="starts_with(x, '=') AND contains(x, 'passed')")}, '^=+|=+$', '', 'g')) AS passed,
          coalesce({_FIRST.format(c="trim(x) <> ''")}, '(no output)') AS rest FROM k JOIN t USING (run_id))
        SELECT run_id, coalesce(CASE kind WHEN 'compiler' THEN error WHEN 'test_runner' THEN coalesce(result, passed) WHEN 'linter' THEN issue END, rest) AS summary FROM p""",
    "classify_command": f"SELECT run_id, {_KIND} AS kind FROM {_CLASSIFIED.format(t=_RUNS)}",
    "compress_generic": _generic(_RUNS, "run_id", "compressed_output"),
    "compress_search": f"""
        WITH r AS (SELECT run_id, compressed_output, {_lines("compressed_output")} AS l FROM {_RUNS}),
        x AS (SELECT run_id, i, l[i] AS x, string_split(l[i], ':')[1] AS f FROM r, unnest(range(1, len(l) + 1)) AS u(i) WHERE len(l) > {MOST}),
        k AS (SELECT *, row_number() OVER (PARTITION BY run_id, f ORDER BY i) AS k, count(*) OVER (PARTITION BY run_id, f) AS n, min(i) OVER (PARTITION BY run_id, f) AS o FROM x),
        s AS (SELECT run_id, o, k, x AS line, f, true AS hit FROM k WHERE k <= 2 UNION ALL SELECT run_id, o, 3, '  ... and ' || (n - 2) || ' more matches in ' || f, f, false FROM k WHERE k = 1 AND n > 2),
        b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY o, k) AS pos FROM s),
        t AS (SELECT run_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE pos <= {MOST}) AS body, count(DISTINCT f) - count(DISTINCT f) FILTER (WHERE pos <= {MOST} AND hit) AS rest FROM b GROUP BY run_id)
        SELECT r.run_id, CASE WHEN len(l) <= {MOST} THEN compressed_output ELSE body || CASE WHEN rest > 0 THEN chr(10) || '... ' || rest || ' more files with matches' ELSE '' END END AS short
        FROM r LEFT JOIN t USING (run_id)""",
    "compress_git": _DIFF
    + f""", short AS (SELECT item_id, string_agg(path || ': +' || added || ' -' || removed || ' (' || hunks || ' hunk' || CASE WHEN hunks = 1 THEN '' ELSE 's' END || ')', chr(10) ORDER BY f) AS s FROM files WHERE f <= {MOST} GROUP BY item_id)
        SELECT c.item_id, CASE WHEN len(l) <= {MOST} THEN content WHEN content LIKE '%diff --git%' THEN coalesce(s, '') ELSE {_join(f"l[:{MOST - 1}] || ['... ' || (len(l) - {MOST - 1}) || ' more lines']")} END AS short
        FROM (SELECT item_id, content, {_lines("content")} AS l FROM context_items) c LEFT JOIN short USING (item_id)""",
    "compress_linter": _BLOCK
    + f"""b AS (SELECT *, CASE WHEN x LIKE 'error:%' OR x LIKE 'error[%' THEN 0 WHEN x LIKE 'warning:%' THEN 1 WHEN x LIKE 'suggestion:%' OR x LIKE 'note:%' OR x LIKE 'help:%' THEN 2 END AS sev, coalesce(ltrim(y) LIKE '-->%', false) AS p FROM x),
        u AS (SELECT *, sum(CASE WHEN p THEN 2 ELSE 1 END) OVER (PARTITION BY id ORDER BY sev, i) AS used FROM b WHERE sev IS NOT NULL),
        s AS (SELECT id, string_agg(x || CASE WHEN p THEN chr(10) || y ELSE '' END, chr(10) ORDER BY sev, i) AS body FROM u WHERE used <= {MOST} GROUP BY id)
        SELECT a.id AS run_id, CASE WHEN n <= {MOST} OR n IS NULL THEN a.raw ELSE coalesce(body, '') END AS short FROM {_RAW} a LEFT JOIN (SELECT DISTINCT id, n FROM x) USING (id) LEFT JOIN s USING (id)""",
    "compress_formatter": _BLOCK
    + f"""b AS (SELECT id, i, trim(x) AS x, trim(x) LIKE 'Formatted %' OR trim(x) LIKE 'Reformatted %' AS done FROM x),
        e AS (SELECT id, max(i) AS i FROM b WHERE NOT done AND x LIKE '%file%' AND (x LIKE '%formatted%' OR x LIKE '%changed%') GROUP BY id),
        o AS (SELECT b.id, 0 AS k, b.i, x FROM b JOIN e ON b.id = e.id AND b.i = e.i UNION ALL SELECT id, 1, i, x FROM b WHERE done),
        p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, i) AS pos FROM o),
        s AS (SELECT id, string_agg(x, chr(10) ORDER BY pos) AS body FROM p WHERE pos <= {MOST} GROUP BY id),
        h AS (SELECT id, string_agg(x, chr(10) ORDER BY i) AS head FROM x WHERE i <= {MOST} GROUP BY id)
        SELECT a.id AS run_id, CASE WHEN n <= {MOST} OR n IS NULL THEN a.raw ELSE coalesce(body, head) END AS short FROM {_RAW} a LEFT JOIN (SELECT DISTINCT id, n FROM x) USING (id) LEFT JOIN s USING (id) LEFT JOIN h USING (id)""",
    "compress_packages": _BLOCK
    + f"""q AS (SELECT *, NOT regexp_matches(x, '^(?: {{1,4}}Downloading | {{2,4}}Fetching | {{2,3}}Unpacking |  Locking )') AS quiet,
          regexp_matches(ltrim(x), '^(?:error|warning|Downloaded|added |Compiling|Finished|Installing|Installed|Removed|Summary)') AS matter FROM x),
        c AS (SELECT id, count(*) FILTER (WHERE quiet) AS nq FROM q GROUP BY id),
        k AS (SELECT q.*, row_number() OVER (PARTITION BY q.id ORDER BY i) AS pos, count(*) OVER (PARTITION BY q.id) AS total FROM q JOIN c USING (id) WHERE CASE WHEN nq > {MOST} THEN matter ELSE quiet END),
        s AS (SELECT id, string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE pos <= {MOST}) || CASE WHEN max(total) > {MOST} THEN chr(10) || '... ' || (max(total) - {MOST}) || ' more lines' ELSE '' END AS body FROM k GROUP BY id),
        h AS (SELECT id, string_agg(x, chr(10) ORDER BY i) AS tail FROM x WHERE i > n - {MOST} GROUP BY id)
        SELECT a.id AS run_id, CASE WHEN n <= {MOST} OR n IS NULL THEN a.raw ELSE coalesce(body, tail) END AS short FROM {_RAW} a LEFT JOIN (SELECT DISTINCT id, n FROM x) USING (id) LEFT JOIN s USING (id) LEFT JOIN h USING (id)""",
    "search_prefixes": f"SELECT string_split(x, ':')[1] AS prefix, count(*) AS lines FROM (SELECT unnest({_lines('compressed_output')}) AS x FROM {_RUNS}) WHERE x LIKE '%:%' GROUP BY 1",
    "diff_totals": _DIFF + "SELECT item_id, count(*) AS files, CAST(sum(added) AS BIGINT) AS additions, CAST(sum(removed) AS BIGINT) AS deletions, CAST(sum(hunks) AS BIGINT) AS hunks FROM files GROUP BY item_id",
    "error_signature": f"SELECT run_id, {_SIGNATURE} AS signature FROM {_SIGNED.format(t=_RUNS)}",
    "error_loops": """
        SELECT session_id, concat_ws(':', command_type, exit_code::VARCHAR) AS signature, count(*) AS times
        FROM (SELECT DISTINCT run_id, session_id, command_type, exit_code FROM run_results) WHERE exit_code <> 0 AND session_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3""",
    "line_ratio": f"SELECT run_id, CASE WHEN coalesce(raw_lines, 0) = 0 THEN 0.0::DOUBLE ELSE round(1 - compressed_lines / raw_lines, 4) END AS ratio FROM {_RUNS}",
    "relevant_test_errors": f"""
        SELECT run_id, array_to_string(list_filter(l, lambda x: regexp_matches(lower(x), 'error|failed|panic')), chr(10)) AS errors,
          array_to_string(list_sort(list_distinct(h)), ',') AS files FROM (
          SELECT run_id, l, list_filter(list_transform(l, lambda x: list_filter(list_transform(regexp_split_to_array(x, '\\s+'), lambda w: trim(w, ':,()')), lambda w: regexp_matches(w, '/.*\\.(?:rs|py|ts|js|php)$'))[1]), lambda w: w IS NOT NULL) AS h
          FROM (SELECT run_id, {_lines("compressed_output")} AS l FROM {_RUNS}))""",
    "project_context_triage": f"""
        SELECT item_id, CASE WHEN regexp_matches(lower(x), 'architecture|runtime|database') THEN 'architecture' WHEN regexp_matches(lower(x), 'must|never|rule') THEN 'rule' ELSE 'noise' END AS about, count(*) AS lines
        FROM (SELECT item_id, unnest({_lines("content")}) AS x FROM context_items) WHERE trim(x) <> '' GROUP BY 1, 2""",
}
_GIT = SQL["compress_git"].replace("context_items", f"(SELECT run_id AS item_id, compressed_output AS content FROM {_RUNS})")
SQL["compress_dispatch"] = f"""
    SELECT run_id, kind, CASE kind WHEN 'test_runner' THEN te.short WHEN 'compiler' THEN co.short WHEN 'linter' THEN li.short WHEN 'git_info' THEN gi.short WHEN 'package_mgr' THEN pa.short WHEN 'formatter' THEN fo.short WHEN 'search' THEN se.short ELSE ge.short END AS short
    FROM (SELECT run_id, {_KIND} AS kind FROM {_CLASSIFIED.format(t=_RUNS)}) JOIN ({SQL["compress_test"]}) te USING (run_id) JOIN ({SQL["compress_compiler"]}) co USING (run_id) JOIN ({SQL["compress_linter"]}) li USING (run_id)
    JOIN (SELECT item_id AS run_id, short FROM ({_GIT})) gi USING (run_id) JOIN ({SQL["compress_packages"]}) pa USING (run_id) JOIN ({SQL["compress_formatter"]}) fo USING (run_id) JOIN ({SQL["compress_search"]}) se USING (run_id) JOIN ({SQL["compress_generic"]}) ge USING (run_id)"""
