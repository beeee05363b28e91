"""Captured text of version control commands, read as rows.

``captured`` has a key and the text of one command's output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextframe.functions.logs import lines

#: Categories of commits by how their subject begins.
COMMITS = {"feat": "feature", "fix": "bugfix", "refactor": "refactor", "docs": "docs", "chore": "chore", "test": "test", "perf": "performance", "ci": "ci", "style": "style"}


def _numbered(captured: DataFrame, key: str) -> DataFrame:
    return captured.select(key, F.posexplode(lines(F.col("text"))).alias("n", "line"))


def commit_category(subject: Column) -> Column:
    """The category of a commit by its subject; ``other`` if none fits."""
    low, kind = F.lower(subject), F.lit("other")
    for prefix, name in reversed(COMMITS.items()):
        kind = F.when(low.startswith(prefix), name).otherwise(kind)
    return kind


def numstat(captured: DataFrame, key: str) -> DataFrame:
    """(key, path, status, additions, deletions) of numstat lines; ``-`` counts 0, and two zeros mean binary."""
    parts = F.split("line", "\t")
    rows = _numbered(captured, key).where(F.size(parts) >= 3).select(key, F.element_at(parts, 3).alias("path"), F.coalesce(F.element_at(parts, 1).try_cast("bigint"), F.lit(0)).alias("additions"), F.coalesce(F.element_at(parts, 2).try_cast("bigint"), F.lit(0)).alias("deletions"))
    a, d = F.col("additions"), F.col("deletions")
    return rows.select(key, "path", F.when((a == 0) & (d == 0), "binary").when(d == 0, "added").when(a == 0, "deleted").otherwise("modified").alias("status"), "additions", "deletions")


def changelog(captured: DataFrame, key: str) -> DataFrame:
    """(key, hash, author, subject, category, files) of a log in which ``COMMIT:hash|author|subject`` lines head the files."""
    head = F.col("line").startswith("COMMIT:")
    rows = _numbered(captured, key).withColumn("c", F.sum(head.cast("int")).over(Window.partitionBy(key).orderBy("n"))).where("c > 0")
    parts = F.split(F.max(F.when(head, F.regexp_replace("line", "^COMMIT:", ""))), r"\|", 3)
    files = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head & (F.trim("line") != ""), F.struct("n", F.trim("line").alias("f"))))), lambda x: x["f"]), ",")
    return rows.groupBy(key, "c").agg(parts.alias("p"), files.alias("files")).select(
        key, F.try_element_at("p", F.lit(1)).alias("hash"), F.try_element_at("p", F.lit(2)).alias("author"), F.try_element_at("p", F.lit(3)).alias("subject"), "files"
    ).withColumn("category", commit_category(F.col("subject")))


def blame(captured: DataFrame, key: str) -> DataFrame:
    """(key, line_no, hash, author, date, content) of blame output in porcelain form.

    Author and time come once for a commit; every line of the commit gets them.
    """
    head = F.regexp_extract("line", r"^([0-9a-f]{7,40}) \d+ (\d+)", 1)
    rows = _numbered(captured, key).withColumn("h", F.when(head != "", head))
    back = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hash", F.last("h", True).over(back)).withColumn("line_no", F.last(F.when(F.col("h").isNotNull(), F.regexp_extract("line", r"^\S+ \d+ (\d+)", 1)), True).over(back))
    found = lambda word: F.max(F.when(F.col("line").startswith(word + " "), F.regexp_replace("line", f"^{word} ", "")))
    commits = rows.groupBy(key, "hash").agg(found("author").alias("author"), found("author-time").alias("time"))
    own = rows.where(F.col("line").startswith("\t")).select(key, "hash", F.col("line_no").cast("int").alias("line_no"), F.regexp_replace("line", "^\t", "").alias("content"))
    return own.join(commits, [key, "hash"]).select(key, "line_no", "hash", "author", F.date_format(F.timestamp_seconds(F.col("time").cast("bigint")), "yyyy-MM-dd").alias("date"), "content")
