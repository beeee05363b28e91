"""Queries of the record store, its search and its clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextframe.operators import cluster as C
from contextframe.operators import memory as M
from contextframe.operators import search as S
from contextframe.sources.tables import load

HOT_PROJECT = "lantern-core"


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "observations")


def session_replace(spark: SparkSession, d: str) -> DataFrame:
    """Run rows made one per session, the last write winning."""
    runs = load(spark, d, "run_results", "session_id", "run_id", "command", "finished_at").where("session_id IS NOT NULL").distinct()
    return M.insert_or_replace(runs, "session_id", ["finished_at", "run_id"])


def file_access_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Access counters of the event log."""
    events = load(spark, d, "token_events", "id", "session_id", "subject", "tool", "created_at").distinct()
    return M.access_counts(events.select(F.col("session_id").alias("project"), F.col("subject").alias("file"), F.col("tool").alias("mode"), F.col("created_at").alias("at"), F.col("id").alias("seq")))


def error_signature_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Error counters of the runs, the first suggestion as the fix."""
    runs = load(spark, d, "run_results", "run_id", "command_type", "error_recurrence", "suggested_next", "finished_at").distinct()
    errors = runs.select(F.col("command_type").alias("project"), F.get_json_object("error_recurrence", "$.hash").alias("signature"), F.try_element_at("suggested_next", F.lit(1)).alias("fix"), F.col("finished_at").alias("at"), F.col("run_id").alias("seq"))
    return M.error_signatures(errors.where("signature IS NOT NULL"))


def observations_append(spark: SparkSession, d: str) -> DataFrame:
    """Two notes appended behind the stored records."""
    new = spark.createDataFrame([(1, "first", "appended text"), (2, None, "another text")], "seq int, title string, text string")
    return M.appended(_obs(spark, d).select("id", "title", "text", "project"), new).select("id", "title", "project")


def deleted_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The records without those that repeat an earlier text."""
    obs = _obs(spark, d).select("id", "text")
    later = obs.where("text IS NOT NULL").groupBy("text").agg(F.min("id").alias("first"))
    return M.deleted(obs, obs.join(later, "text").where("id <> first")).select("id")


def timeline_project(spark: SparkSession, d: str) -> DataFrame:
    """The timeline around a record, of one project."""
    return M.timeline(_obs(spark, d), _anchor(spark, d), 3, 3, HOT_PROJECT).select("id", "title", "project")


def _anchor(spark: SparkSession, d: str) -> int:
    return _obs(spark, d).where("created_at >= '2025-08-01'").agg(F.min("id")).first()[0]


def _search(query: str, **how):  # noqa: ANN003, ANN202
    return lambda s, d: S.search(_obs(s, d), query, **{name: value() if callable(value) else value for name, value in how.items()})


def session_event_search(spark: SparkSession, d: str) -> DataFrame:
    """The best 20 runs of one session, the first by id, for a word; the counts are those of all sessions."""
    runs = load(spark, d, "run_results", "run_id", "session_id", "command", "summary").distinct()
    first = load(spark, d, "run_results", "session_id").agg(F.min("session_id"))
    return S.search(runs, "the", key="run_id", limit=20, columns=("command", "summary"), condition=F.col("session_id") == first.scalar())


def cluster_edges(spark: SparkSession, d: str) -> DataFrame:
    """Similar sets of concepts within a project, by their first records."""
    rows = _obs(spark, d).where("project IS NOT NULL").select("id", "project", "created_at", M.csv_set(F.col("concepts")).alias("items"))
    return C.set_edges(C.classes(rows, "project", ["created_at"]), "project").select("project", "a", "b", F.round("similarity", 6).alias("similarity"))


def _clustered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    obs = _obs(spark, d)
    return obs, C.cut_lineage(C.clusters(obs))


def summarize_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a summarising run."""
    obs, clustered = _clustered(spark, d)
    return C.counters(clustered, C.cut_lineage(C.duplicates(obs, clustered)))


QUERIES = {
    "observations_valid": lambda s, d: M.valid(_obs(s, d)).select("id", "observation_type"),
    "observations_append": observations_append,
    "auto_observe_dedup": lambda s, d: M.insert_or_ignore(_obs(s, d)).select("id", "dedup_hash"),
    "session_replace": session_replace,
    "file_access_upsert": file_access_upsert,
    "error_signature_upsert": error_signature_upsert,
    "delete_observations": deleted_duplicates,
    "observation_by_id": lambda s, d: M.by_id(_obs(s, d), _anchor(s, d)).select("id", "title", "text"),
    "observations_of_project": lambda s, d: M.of_project(_obs(s, d), HOT_PROJECT).select("id", "created_at"),
    "recent_memories": lambda s, d: M.recent(_obs(s, d), HOT_PROJECT).select("id", "created_at"),
    "observations_filtered": lambda s, d: M.where(_obs(s, d), project=HOT_PROJECT, kind="bugfix", start=M.check_date("2025-03-01"), end=M.check_date("2025-09-30")).select("id"),
    "privacy_filter": lambda s, d: M.public(_obs(s, d).withColumn("text", F.when(F.col("id") % 3 == 0, F.concat(F.lit("<Private>"), "text", F.lit("</PRIVATE>"))).otherwise(F.col("text"))), "auto_generated").select("id"),
    "memory_timeline": lambda s, d: M.timeline(_obs(s, d), _anchor(s, d), 5, 5).select("id", "title", "project"),
    "memory_timeline_project": timeline_project,
    "latest_session": lambda s, d: M.latest_session(load(s, d, "sessions", "id", "project_path", "started_at", "ended_at")),
    "memory_citation": lambda s, d: _obs(s, d).select("id", M.citation(F.col("id")).alias("citation")),
    "context_injection": lambda s, d: M.context_lines(M.recent(_obs(s, d), HOT_PROJECT)),
    "memory_search_bm25": _search("search filter"),
    "memory_search_filtered": _search("cache", limit=50, condition=lambda: (F.col("project") == HOT_PROJECT) & (F.col("observation_type") == "bugfix")),
    "memory_search_page2": _search("token budget", limit=10, offset=10),
    "memory_search_phrase": _search('release-branch "lock-file"', limit=20),
    "session_event_search": session_event_search,
    "cluster_jaccard_edges": cluster_edges,
    "cluster_leaders": lambda s, d: _clustered(s, d)[1],
    "cluster_topics": lambda s, d: C.topics(*_clustered(s, d)),
    "shingle_duplicates": lambda s, d: C.duplicates(*_clustered(s, d)),
    "sentence_summaries": lambda s, d: C.summaries(*_clustered(s, d)),
    "summarize_counters": summarize_counters,
}

_ANCHOR = "(SELECT min(id) FROM observations WHERE created_at >= '2025-08-01')"
_SET = "list_sort(list_distinct(list_filter(list_transform(string_split(coalesce({c}, ''), ','), lambda v: lower(trim(v))), lambda v: v <> '')))"
_RANK = """
WITH t AS (SELECT {key} AS id, {cols}, ' ' || {joined} || ' ' AS t FROM {table}),
f AS (SELECT *, len(list_filter(string_split(t, ' '), lambda w: w <> '')) - {bars} AS dl, {counts} FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS av, {dfs} FROM f)
SELECT id AS {key}, round(-({score}), 6) AS score FROM f, s WHERE {hit}{cond} ORDER BY score, id LIMIT {limit} OFFSET {offset}
"""


def _rank_sql(query: str, *, table: str = "observations", key: str = "id", columns: tuple[str, ...] = S.COLUMNS, cols: str = "project, observation_type", cond: str = "", limit: int = 10, offset: int = 0) -> str:
    terms = S.terms_of(query)
    joined = " || '  |  ' || ".join(f"array_to_string(regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+'), '  ')" for c in columns)
    phrases = [" " + "  ".join(term) + " " for term in terms]
    counts = ", ".join(f"(length(t) - length(replace(t, '{p}', ''))) // {len(p)} AS f{k}" for k, p in enumerate(phrases))
    dfs = ", ".join(f"count(*) FILTER (WHERE f{k} > 0) AS d{k}" for k in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / av))" for k in range(len(terms)))
    hit = " AND ".join(f"f{k} > 0" for k in range(len(terms)))
    return _RANK.format(key=key, cols=cols, joined=joined, table=table, bars=len(columns) - 1, counts=counts, dfs=dfs, score=score, hit=hit, cond=cond, limit=limit, offset=offset)


def _leaders(rows: str, name: str) -> str:
    """Greedy clusters of (grp, id, created_at, items): going in order, a row joins the first leader it is similar to, or leads."""
    alike = "10 * len(list_intersect(l.items, o.items)) > {t} * len(list_distinct(l.items || o.items))".replace("{t}", str(C.JACCARD))
    return f"""
        {name}_o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY created_at NULLS FIRST, id) AS k FROM {rows} WHERE len(items) > 0),
        {name}_r AS (
          SELECT grp, k, id, id AS leader, [{{'id': id, 'items': items}}] AS leaders FROM {name}_o WHERE k = 1
          UNION ALL SELECT grp, k, id, coalesce(m.id, id), CASE WHEN m IS NULL THEN list_append(leaders, {{'id': id, 'items': items}}) ELSE leaders END
          FROM (SELECT o.grp, o.k, o.id, o.items, r.leaders, list_filter(r.leaders, lambda l: {alike})[1] AS m FROM {name}_r r JOIN {name}_o o ON o.grp = r.grp AND o.k = r.k + 1)),
        {name} AS (SELECT id, leader FROM {name}_r UNION ALL SELECT id, id FROM {rows} WHERE len(items) = 0)"""


_CLUSTERS = f"""
WITH RECURSIVE base AS (SELECT id, project AS grp, created_at, {_SET.format(c="files")} AS items, {_SET.format(c="concepts")} AS concepts FROM observations WHERE project IS NOT NULL),
{_leaders("base", "f")},
parts AS (SELECT b.id, b.grp AS project, f.leader AS grp, created_at, concepts AS items FROM base b JOIN f USING (id)),
{_leaders("parts", "c")},
k AS (SELECT p.id, p.project, p.grp AS leader, c.leader AS cluster FROM parts p JOIN c USING (id))
"""
_RUN = "list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))"
_DUPLICATES = f""",
w AS (SELECT k.id, cluster, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM k JOIN observations o ON o.id = k.id WHERE text IS NOT NULL),
g AS (SELECT id, cluster, list_distinct({_RUN}) AS items FROM w),
d AS (SELECT a.id FROM g a WHERE EXISTS (SELECT 1 FROM g b WHERE b.cluster = a.cluster AND b.id > a.id AND 10 * len(list_intersect(a.items, b.items)) > {C.OVERLAP} * least(len(a.items), len(b.items))))
"""

#: Sentences end behind a mark that a blank, a line break or the end follows.
_SENTENCES = r"""list_filter(list_transform(regexp_extract_all({t}, '(?s).*?[.!?](?:[ \n]+|$)|.+$'), lambda s: trim(CASE WHEN regexp_matches(s, '(?s)[.!?][ \n]+$') THEN regexp_replace(s, '[ \n]+$', '') ELSE s END)), lambda s: s <> '')"""
_NORM = r"list_filter(list_transform(regexp_split_to_array({t}, '\s+'), lambda w: regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: strlen(w) >= 2)"
_RUNS3 = "list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')))"
_BEST = "SELECT cluster, sentence, runs FROM {left} QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, id, pos) = 1"
_UNLIKE = "SELECT l.* FROM {left} l JOIN {best} b USING (cluster) WHERE NOT 10 * len(list_intersect(l.runs, b.runs)) > {t} * least(len(l.runs), len(b.runs))".replace("{t}", str(C.SIMILAR))
_SUMMARIES = f""",
t AS (SELECT k.id, cluster, text FROM k JOIN observations o ON o.id = k.id WHERE text IS NOT NULL),
n AS (SELECT cluster, count(*) AS n FROM t GROUP BY 1),
df AS (SELECT cluster, word, count(*) AS df FROM (SELECT cluster, unnest(list_distinct({_NORM.format(t="text")})) AS word FROM t) GROUP BY 1, 2),
s0 AS (SELECT id, cluster, unnest(v) AS sentence, generate_subscripts(v, 1) AS pos FROM (SELECT id, cluster, {_SENTENCES.format(t="text")} AS v FROM t)),
s1 AS (SELECT *, list_filter(regexp_split_to_array(lower(sentence), '\\s+'), lambda w: w <> '') AS w FROM s0 WHERE len(regexp_split_to_array(sentence, '\\s+')) >= 3),
sw AS (SELECT id, cluster, pos, unnest({_NORM.format(t="sentence")}) AS word FROM s1),
sc AS (SELECT sw.id, sw.cluster, pos, round(avg(ln(n / df) + 1), 6) AS score FROM sw JOIN df ON df.cluster = sw.cluster AND df.word = sw.word JOIN n ON n.cluster = sw.cluster GROUP BY 1, 2, 3),
l1 AS (SELECT s1.id, s1.cluster, s1.pos, sentence, coalesce(score, 0) AS score, {_RUNS3} AS runs FROM s1 LEFT JOIN sc ON sc.id = s1.id AND sc.cluster = s1.cluster AND sc.pos = s1.pos),
b1 AS ({_BEST.format(left="l1")}), l2 AS ({_UNLIKE.format(left="l1", best="b1")}), b2 AS ({_BEST.format(left="l2")}), l3 AS ({_UNLIKE.format(left="l2", best="b2")}), b3 AS ({_BEST.format(left="l3")})
SELECT cluster, string_agg(sentence, ' | ' ORDER BY no) AS summary FROM (SELECT cluster, sentence, 1 AS no FROM b1 UNION ALL SELECT cluster, sentence, 2 FROM b2 UNION ALL SELECT cluster, sentence, 3 FROM b3) GROUP BY cluster
"""

SQL = {
    "sentence_summaries": _CLUSTERS + _SUMMARIES,
    "cluster_leaders": _CLUSTERS + "SELECT id, project, leader, cluster FROM k",
    "cluster_topics": _CLUSTERS
    + f""",
        e AS (SELECT k.cluster, {_SET.format(c="o.files")} AS files, {_SET.format(c="o.concepts")} AS concepts FROM k JOIN observations o ON o.id = k.id),
        a AS (SELECT cluster, regexp_replace(regexp_extract(v, '([^/]+)/*$', 1), '(.)\\.[^.]*$', '\\1') AS v, count(*) AS n FROM (SELECT cluster, unnest(files) AS v FROM e) GROUP BY 1, 2),
        b AS (SELECT cluster, v, count(*) AS n FROM (SELECT cluster, unnest(concepts) AS v FROM e) GROUP BY 1, 2),
        x AS (SELECT cluster, v FROM a QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, v) = 1), y AS (SELECT cluster, v FROM b QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, v) = 1)
        SELECT cluster, CASE WHEN x.v IS NOT NULL AND y.v IS NOT NULL THEN x.v || ' (' || y.v || ')' ELSE coalesce(x.v, y.v, 'uncategorized') END AS topic
        FROM (SELECT DISTINCT cluster FROM k) LEFT JOIN x USING (cluster) LEFT JOIN y USING (cluster)""",
    "shingle_duplicates": _CLUSTERS + _DUPLICATES + "SELECT id FROM d",
    "summarize_counters": _CLUSTERS
    + _DUPLICATES
    + """SELECT (SELECT count(DISTINCT cluster) FROM k) AS clusters, (SELECT count(DISTINCT cluster) FROM k WHERE id NOT IN (SELECT id FROM d)) AS summaries_created, (SELECT count(*) FROM d) AS duplicates_removed""",
    "observations_valid": f"""
        SELECT id, observation_type FROM observations WHERE text <> '' AND strlen(text) <= 65536 AND coalesce(observation_type, 'discovery') IN {M.TYPES}
          AND list_has_all({list(M.CONCEPTS)}, {_SET.format(c="concepts")})""",
    "observations_append": """
        SELECT id, title, project FROM observations
        UNION ALL SELECT (SELECT max(id) FROM observations) + 1, 'first', NULL UNION ALL SELECT (SELECT max(id) FROM observations) + 2, NULL, NULL""",
    "auto_observe_dedup": "SELECT id, dedup_hash FROM observations o WHERE dedup_hash IS NULL OR id = (SELECT min(id) FROM observations p WHERE p.dedup_hash = o.dedup_hash)",
    "session_replace": "SELECT session_id, run_id, command, finished_at FROM (SELECT DISTINCT session_id, run_id, command, finished_at FROM run_results WHERE session_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY finished_at DESC, run_id DESC) = 1",
    "file_access_upsert": """
        SELECT session_id AS project, subject AS file, count(*) AS access_count, max(created_at) AS last_accessed, last(tool ORDER BY created_at, id) FILTER (WHERE true) AS last_mode
        FROM (SELECT DISTINCT id, session_id, subject, tool, created_at FROM token_events) GROUP BY 1, 2""",
    "error_signature_upsert": """
        WITH r AS (SELECT DISTINCT run_id, command_type AS project, json_extract_string(error_recurrence, '$.hash') AS signature, suggested_next[1] AS fix, finished_at FROM run_results)
        SELECT project, signature, count(*) AS occurrence_count, max(finished_at) AS last_seen, last(fix ORDER BY finished_at, run_id) FILTER (WHERE fix IS NOT NULL) AS typical_fix
        FROM r WHERE signature IS NOT NULL GROUP BY 1, 2""",
    "delete_observations": "SELECT id FROM observations WHERE text IS NULL OR id IN (SELECT min(id) FROM observations GROUP BY text)",
    "observation_by_id": f"SELECT id, title, text FROM observations WHERE id = {_ANCHOR}",
    "observations_of_project": f"SELECT id, created_at FROM observations WHERE project = '{HOT_PROJECT}'",
    "recent_memories": f"SELECT id, created_at FROM observations WHERE project = '{HOT_PROJECT}' OR files ILIKE '%{HOT_PROJECT}%' ORDER BY created_at DESC, id DESC LIMIT 10",
    "observations_filtered": f"SELECT id FROM observations WHERE project = '{HOT_PROJECT}' AND observation_type = 'bugfix' AND created_at >= '2025-03-01' AND created_at <= '2025-09-30'",
    "privacy_filter": "SELECT id FROM observations WHERE (id % 3 <> 0 OR text IS NULL) AND NOT coalesce(auto_generated, false)",
    "memory_timeline": f"""
        (SELECT id, title, project FROM observations WHERE id <= {_ANCHOR} ORDER BY id DESC LIMIT 6) UNION ALL
        (SELECT id, title, project FROM observations WHERE id > {_ANCHOR} ORDER BY id LIMIT 5)""",
    "memory_timeline_project": f"""
        (SELECT id, title, project FROM observations WHERE id <= {_ANCHOR} AND project = '{HOT_PROJECT}' ORDER BY id DESC LIMIT 4) UNION ALL
        (SELECT id, title, project FROM observations WHERE id > {_ANCHOR} AND project = '{HOT_PROJECT}' ORDER BY id LIMIT 3)""",
    "latest_session": "SELECT project_path, id, started_at, ended_at FROM sessions QUALIFY row_number() OVER (PARTITION BY project_path ORDER BY started_at DESC, id DESC) = 1",
    "memory_citation": "SELECT id, 'memory://observation/' || id AS citation FROM observations",
    "context_injection": f"""
        SELECT id, '  [' || observation_type || '] ' || coalesce(title, '(untitled)') || ' — ' || replace(substring(text, 1, 100), chr(10), ' ') AS line
        FROM observations WHERE project = '{HOT_PROJECT}' OR files ILIKE '%{HOT_PROJECT}%' ORDER BY created_at DESC, id DESC LIMIT 10""",
    "memory_search_bm25": _rank_sql("search filter"),
    "memory_search_filtered": _rank_sql("cache", limit=50, cond=f" AND project = '{HOT_PROJECT}' AND observation_type = 'bugfix'"),
    "memory_search_page2": _rank_sql("token budget", offset=10),
    "memory_search_phrase": _rank_sql('release-branch "lock-file"', limit=20),
    "session_event_search": _rank_sql("the", table="(SELECT DISTINCT run_id, session_id, command, summary FROM run_results)", key="run_id", columns=("command", "summary"), cols="session_id", cond=" AND session_id = (SELECT min(session_id) FROM run_results)", limit=20),
    "cluster_jaccard_edges": f"""
        WITH o AS (SELECT id, project, created_at, {_SET.format(c="concepts")} AS items FROM observations WHERE project IS NOT NULL),
        c AS (SELECT project, items, min(row(created_at, id)) AS first FROM o WHERE len(items) > 0 GROUP BY 1, 2),
        p AS (SELECT a.project, a.first AS fa, b.first AS fb, len(list_intersect(a.items, b.items))::DOUBLE / len(list_distinct(a.items || b.items)) AS j
          FROM c a JOIN c b ON a.project = b.project AND a.first < b.first)
        SELECT project, fa[2] AS a, fb[2] AS b, round(j, 6) AS similarity FROM p WHERE j * 10 > 3""",
}
