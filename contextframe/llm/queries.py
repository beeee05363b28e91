"""Queries of the operators for training data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextframe.llm import chunking, encoding, language, leakage, neardup, percentiles, secrets
from contextframe.sources.tables import load

#: The word of functions/text.py, for SQL.
_WORD = r"[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


SECRET_TEXTS = (("context_items", "item_id", "content"), ("observations", "id", "text"), ("run_results", "run_id", "compressed_output"))


def _secret_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [load(spark, sf_dir, name, key, text).toDF("row_id", "text").withColumn("source_table", F.lit(name)) for name, key, text in SECRET_TEXTS]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def _secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _secret_texts(spark, sf_dir)
    scan = secrets.scanned(F.col("text"), secrets.dictionary(texts, "row_id", "text"), spark.sparkContext)
    return texts.withColumn("_s", scan)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which a credential begins; a resent run counts once."""
    return _secret_scan(spark, sf_dir).select("source_table", "row_id", F.explode(F.col("_s.found.line_no")).alias("line_no")).distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its right flag and with credentials masked; a resent run comes once."""
    scan = _secret_scan(spark, sf_dir)
    return scan.select("source_table", "row_id", (F.size("_s.found") > 0).alias("secrets_detected"), F.coalesce("_s.redacted", "text").alias("redacted")).distinct()


def p1_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by the flag they came with and the right one."""
    runs = load(spark, sf_dir, "run_results", "run_id", "compressed_output", "secrets_detected").distinct()
    words = secrets.dictionary(_secret_texts(spark, sf_dir), "row_id", "text")
    scan = secrets.scanned(F.col("compressed_output"), words, spark.sparkContext)
    return runs.select("secrets_detected", (F.size(scan["found"]) > 0).alias("right_flag")).groupBy("secrets_detected", "right_flag").agg(F.count("*").alias("runs"))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of savings_ratio and saved_tokens by tool, category and day, with the bound on their ranks."""
    events = load(spark, sf_dir, "token_events", "id", "tool", "category", "created_at", "savings_ratio", "saved_tokens")
    return percentiles.percentiles(percentiles.event_digests(events), percentiles.KEYS)


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values each digest of problem 2 stands for."""
    events = load(spark, sf_dir, "token_events", "id", "tool", "category", "created_at", "savings_ratio", "saved_tokens")
    return percentiles.event_digests(events).select(*percentiles.KEYS, F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c).alias("n"))


def p2_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the true rank of each percentile of problem 2 is within the stated error."""
    return percentiles.rank_checks(load(spark, sf_dir, "token_events", "id", "tool", "category", "created_at", "savings_ratio", "saved_tokens"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (("context_items", "item_id", "content"), ("file_summaries", "summary_id", "summary"))
    parts = [
        chunking.split_oversized(load(spark, sf_dir, name, key, text), key, text).withColumn("source_table", F.lit(name))
        for name, key, text in tables
    ]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items over 512 tokens: those that the splitter cut."""
    return _pieces(spark, sf_dir).where("piece_no = 1").select("source_table", "item_id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all items over 512 tokens."""
    return _pieces(spark, sf_dir)


def p3_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of each item over 512 tokens are its text again, within the limit and linked."""
    parts = []
    for name, key, text in (("context_items", "item_id", "content"), ("file_summaries", "summary_id", "summary")):
        items = load(spark, sf_dir, name, key, text)
        parts.append(chunking.whole_again(chunking.split_oversized(items, key, text), items, key, text).withColumn("source_table", F.lit(name)))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of observations with 0.8 of the longer text's words in common."""
    return neardup.near_pairs(load(spark, sf_dir, "observations", "id", "text"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near-duplicates of every observation with words, and its class's links."""
    return neardup.near_groups(load(spark, sf_dir, "observations", "id", "text"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encoding.encode_corpus(load(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 16 consecutive words of an evaluation item."""
    return leakage.find_leaks(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "eval_items", "item_id", "text"))


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked passages with their offsets in the original text."""
    return leakage.find_leaks(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "eval_items", "item_id", "text"), places=True)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language.find_segments(documents, language.fitted(documents, "text", "lang", "doc_id"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the documents that are mixed or have a missing or wrong label."""
    return _segments(spark, sf_dir).where(language.is_case()).select("doc_id", "seg_no", "lang")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language segment with its words and confidence."""
    return _segments(spark, sf_dir)


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p1_flags": p1_flags,
    "p2_percentiles": p2_percentiles,
    "p2_counts": p2_counts,
    "p2_ranks": p2_ranks,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_whole": p3_whole,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_passages": p7_passages,
    "p8_found": p8_found,
    "p8_segments": p8_segments,
}

_OVERSIZED = """
SELECT source_table, item_id{right} FROM (
  SELECT 'context_items' AS source_table, item_id, content AS t FROM context_items
  UNION ALL SELECT 'file_summaries', summary_id, summary FROM file_summaries)
WHERE length(t) > 2048 OR len(regexp_extract_all(t, '{word}')) > 384
"""

_COUNTS = """
WITH once AS (
  SELECT DISTINCT id, tool, category, CAST(created_at AS DATE) AS day, savings_ratio, saved_tokens FROM token_events),
v AS (
  SELECT tool, category, day, 'savings_ratio' AS measure, savings_ratio AS value FROM once WHERE savings_ratio IS NOT NULL AND NOT isnan(savings_ratio)
  UNION ALL SELECT tool, category, day, 'saved_tokens', saved_tokens FROM once WHERE saved_tokens IS NOT NULL)
SELECT 'tool' AS grouping, tool AS member, measure, count(*) AS n{right} FROM v GROUP BY tool, measure
UNION ALL SELECT 'category', category, measure, count(*){right} FROM v GROUP BY category, measure
UNION ALL SELECT 'day', CAST(day AS VARCHAR), measure, count(*){right} FROM v WHERE day IS NOT NULL GROUP BY day, measure
"""

_NEAR = r"""
WITH w AS (
  SELECT id, word, count(*) AS n FROM (
    SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM observations)
  GROUP BY id, word),
l AS (SELECT id, sum(n) AS n FROM w GROUP BY id)
SELECT a.id AS id_a, b.id AS id_b
FROM w a JOIN w b ON a.word = b.word AND a.id < b.id JOIN l la ON la.id = a.id JOIN l lb ON lb.id = b.id
GROUP BY a.id, b.id, la.n, lb.n
HAVING sum(least(a.n, b.n)) * 10 >= greatest(la.n, lb.n) * 8
"""

_LEAKS = r"""
WITH d AS (
  SELECT doc_id, unnest([lower(text), regexp_replace(regexp_replace(lower(text), '<[^<>\n]*>|&(?:[a-zA-Z]+[0-9]*|#[0-9]+|#x[0-9a-f]+);|\]\([^()\s]*\)', ' ', 'g'),
    '(?m)^[ \t\r]*(?:(?:\d+[ \t]*[|:.)\]]|[>#*+|•–%;$-]+|//+|\d+[ \t])[ \t]*)+', ' ', 'g')]) AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[\p{L}\p{N}]+') AS w FROM d),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
x AS (SELECT doc_id, array_to_string(w[k:k + 15], ' ') AS run FROM w, unnest(range(1, len(w) - 14)) AS u(k) WHERE len(w) >= 16),
y AS (SELECT item_id, array_to_string(w[k:k + 15], ' ') AS run FROM i, unnest(range(1, len(w) - 14)) AS u(k) WHERE len(w) >= 16)
SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (run)
"""

SQL = {
    "p7_found": _LEAKS,
    "p5_found": _NEAR,
    "p2_counts": _COUNTS.replace("{right}", ""),
    "p2_ranks": _COUNTS.replace("{right}", ", true AS \"right\""),
    "p3_found": _OVERSIZED.replace("{word}", _WORD).replace("{right}", ""),
    "p3_whole": _OVERSIZED.replace("{word}", _WORD).replace("{right}", ', true AS "whole", true AS "within", true AS "linked"'),
}
