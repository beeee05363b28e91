"""Text edits, truncation, observations made from calls, and small formats, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from contextframe.functions.logs import lines

#: Tools whose calls are not recorded.
SILENT = ("xray", "session_status", "validate_config")


def truncate_at_word(text: Column, most: int) -> Column:
    """The text cut at the last blank within ``most`` characters, with an ellipsis; short texts stay."""
    head = F.substring(text, 1, most)
    back = F.instr(F.reverse(head), " ")
    cut = F.when(back > 0, F.substring(head, F.lit(1), F.length(head) - back)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def observation_type(tool: Column, result: Column) -> Column:
    """The type of the record that a call makes: change, bugfix or discovery."""
    low = F.lower(result)
    failed = (low.contains("failed") & ~low.contains("0 failed")) | low.contains("error[") | low.contains("error:") | result.contains("FAILED")
    return F.when(tool == "smart_edit", "change").when((tool == "smart_run") & failed, "bugfix").otherwise("discovery")


def dedup_hash(tool: Column, path: Column, result: Column) -> Column:
    """The key under which the same call is recorded once."""
    return F.sha2(F.concat_ws(":", tool, F.coalesce(path, F.lit("")), F.substring(result, 1, 100)), 256)


def replace_once(text: Column, old: Column, new: Column) -> Column:
    """The text with its only occurrence of ``old`` replaced; null where there is none or more than one."""
    hits = (F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)
    return F.when((F.length(old) > 0) & (hits == 1), F.replace(text, old, new))


def apply_edits(text: Column, edits: Column) -> Column:
    """The text after edits (old, new) in turn, each of which must match exactly once; null if one does not."""
    return F.aggregate(edits, text, lambda state, e: replace_once(state, e["old"], e["new"]))


def replace_lines(text: Column, first: Column, last: Column, new: Column) -> Column:
    """The text with lines ``first`` to ``last``, counted from 1, replaced; null for a range that is not there."""
    all_lines = lines(text)
    ok = (first >= 1) & (first <= last) & (last <= F.size(all_lines))
    made = F.concat(F.slice(all_lines, F.lit(1), F.greatest(first - 1, F.lit(0))), lines(new), F.slice(all_lines, F.greatest(last + 1, F.lit(1)), F.greatest(F.size(all_lines) - last, F.lit(0))))
    return F.when(ok, F.array_join(made, "\n"))


def guarded(text: Column, expected: Column, edited: Column) -> Column:
    """The edited text if the hash of the text is the expected one, else null."""
    return F.when(F.sha2(text, 256) == expected, edited)


def relative_time(seconds: Column) -> Column:
    """How long ago, in seconds, minutes, hours or days."""
    said = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds < 60, said(1, "s ago")).when(seconds < 3_600, said(60, "m ago")).when(seconds < 86_400, said(3_600, "h ago")).otherwise(said(86_400, "d ago"))


def register(spark: SparkSession) -> list[str]:
    """SQL functions of the library for a session: token estimates, command kinds, shingles, similarity and redaction of assignments."""
    word = r"[^\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
    made = {
        "cf_estimate_tokens(t STRING) RETURNS BIGINT": f"CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, (length(t) + 3) DIV 4, (regexp_count(t, '{word}') * 4 + 2) DIV 3) END",
        "cf_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(array_union(a, b)) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END",
        "cf_savings_ratio(raw BIGINT, compressed BIGINT) RETURNS DOUBLE": "CASE WHEN coalesce(raw, 0) = 0 THEN 0D ELSE (raw - compressed) / raw END",
        "cf_redact_assignments(t STRING) RETURNS STRING": r"regexp_replace(t, '(?i)((?:password|passwd|secret|token|api_?key)\\w*\\s*[:=]\\s*)(\\S{6,})', '$1********')",
    }
    for signature, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [signature.split("(")[0] for signature in made]
