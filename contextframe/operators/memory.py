"""The record store: writes as folds, lookups, filters and timelines.

Times are compared as text, as they are stored; the id breaks every tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextframe.operators.running import numbered

#: The types and concepts a record may have, and the bytes its text may take.
TYPES = ("bugfix", "feature", "refactor", "change", "discovery", "decision")
CONCEPTS = ("how-it-works", "why-it-exists", "what-changed", "problem-solution", "gotcha", "pattern", "trade-off")
MAX_BYTES = 65_536
MAX_DEPTH = 100


def csv_set(column: Column) -> Column:
    """The distinct values of a comma list, trimmed and in lower case, without empty ones, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda v: F.lower(F.trim(v))), lambda v: v != "")))


def valid(observations: DataFrame) -> DataFrame:
    """Records that may be stored: a text within the limit, a known type and only known concepts."""
    concepts = csv_set(F.col("concepts"))
    return observations.where(
        F.col("text").isNotNull() & (F.col("text") != "") & (F.octet_length("text") <= MAX_BYTES) & F.coalesce("observation_type", F.lit("discovery")).isin(*TYPES) & (F.size(F.array_except(concepts, F.array(*map(F.lit, CONCEPTS)))) == 0)
    )


def appended(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` and ``new`` records, the new ones numbered on from the largest id; missing columns become null."""
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    added = numbered(new, ["seq"], "_no").crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + F.col("_no")).drop("last", "seq", "_no")
    return stored.unionByName(added, allowMissingColumns=True)


def insert_or_ignore(observations: DataFrame, key: str = "dedup_hash") -> DataFrame:
    """Of records with the same key only the first by id; a null key never collides."""
    keyed = observations.where(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min("id").alias("id"))
    return keyed.join(first.select("id"), "id", "left_semi").unionByName(observations.where(F.col(key).isNull()))


def insert_or_replace(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *[c for c in names if c not in order])).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in names])


def access_counts(accesses: DataFrame) -> DataFrame:
    """(project, file, access_count, last_accessed, last_mode) of a log of file accesses."""
    return accesses.groupBy("project", "file").agg(F.count("*").alias("access_count"), F.max("at").alias("last_accessed"), F.max_by("mode", F.struct("at", "seq")).alias("last_mode"))


def error_signatures(errors: DataFrame) -> DataFrame:
    """(project, signature, occurrence_count, last_seen, typical_fix); the fix is the last one that is not null."""
    return errors.groupBy("project", "signature").agg(
        F.count("*").alias("occurrence_count"), F.max("at").alias("last_seen"), F.max_by("fix", F.when(F.col("fix").isNotNull(), F.struct("at", "seq"))).alias("typical_fix")
    )


def deleted(observations: DataFrame, ids: DataFrame) -> DataFrame:
    """The records without those of the given ids."""
    return observations.join(ids.select("id").distinct(), "id", "left_anti")


def by_id(observations: DataFrame, wanted: int) -> DataFrame:
    """The record of an id."""
    return observations.where(F.col("id") == wanted).limit(1)


def of_project(observations: DataFrame, project: str) -> DataFrame:
    """All records of a project in order of time."""
    return observations.where(F.col("project") == project).orderBy("created_at", "id")


def recent(observations: DataFrame, project: str, limit: int = 10) -> DataFrame:
    """The newest records of a project or with the project in their files; ``%`` and ``_`` in it match anything."""
    return observations.where((F.col("project") == project) | F.col("files").ilike(f"%{project}%")).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def where(observations: DataFrame, *, project: str | None = None, kind: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The records that meet every condition given."""
    for column, op, value in (("project", "__eq__", project), ("observation_type", "__eq__", kind), ("created_at", "__ge__", start), ("created_at", "__le__", end)):
        if value is not None:
            observations = observations.where(getattr(F.col(column), op)(value))
    return observations


def check_date(value: str) -> str:
    """The date if it looks like one, else an error."""
    if len(value) < 10 or value[4] != "-" or value[7] != "-":
        raise ValueError(f"not a date: {value}")
    return value


def is_private(text: Column) -> Column:
    """Whether a text holds an opening and a closing private tag, in any case."""
    low = F.lower(text)
    return low.contains("<private>") & low.contains("</private>")


def public(observations: DataFrame, flag: str | None = None) -> DataFrame:
    """The records that are neither flagged nor tagged as private."""
    kept = observations.where(~F.coalesce(is_private(F.col("text")), F.lit(False)))
    return kept.where(~F.coalesce(F.col(flag), F.lit(False))) if flag else kept


def timeline(observations: DataFrame, anchor: int, before: int = 5, after: int = 5, project: str | None = None) -> DataFrame:
    """``before`` records up to the anchor, the anchor, and ``after`` behind it, by id.

    The anchor must exist, else an error; a project may leave out the anchor itself. Two
    top-k searches, so only that many rows are ever gathered.
    """
    if observations.where(F.col("id") == anchor).isEmpty():
        raise LookupError(f"no record {anchor}")
    own = where(observations, project=project)
    left = own.where(F.col("id") <= anchor).orderBy(F.desc("id")).limit(min(before, MAX_DEPTH) + 1)
    right = own.where(F.col("id") > anchor).orderBy("id").limit(min(after, MAX_DEPTH))
    return left.unionByName(right).orderBy("id")


def latest_session(sessions: DataFrame) -> DataFrame:
    """The newest session of each project."""
    names = [c for c in sessions.columns if c != "project_path"]
    return sessions.groupBy("project_path").agg(F.max_by(F.struct(*names), F.struct("started_at", "id")).alias("_s")).select("project_path", *[F.col(f"_s.{c}").alias(c) for c in names])


def citation(key: Column) -> Column:
    """The address of a record."""
    return F.concat(F.lit("memory://observation/"), key.cast("string"))


def context_lines(observations: DataFrame) -> DataFrame:
    """The records' lines of a context block: type, title and the first 100 characters."""
    preview = F.replace(F.substring("text", 1, 100), F.lit("\n"), F.lit(" "))
    return observations.select("id", F.format_string("  [%s] %s — %s", "observation_type", F.coalesce("title", F.lit("(untitled)")), preview).alias("line"))


def most_accessed(counts: DataFrame, project: str | None = None) -> DataFrame:
    """The files of :func:`access_counts`, the most read first."""
    kept = counts if project is None else counts.where(F.col("project") == project)
    return kept.orderBy(F.desc("access_count"), "project", "file")


def compact_index(observations: DataFrame, n: int = 10) -> DataFrame:
    """(id, observation_type, title) of the first n records: what is shown before any is read whole."""
    return observations.select("id", "observation_type", "title").orderBy("id").limit(n)


def health_rows(log: DataFrame, factors: dict[str, Column]) -> DataFrame:
    """(file, factors, health): of a log of health rows (file, seq and the factors) the last of each file, with its score."""
    from contextframe.operators.quality import health

    last = insert_or_replace(log.select("file", "seq", *[value.alias(name) for name, value in factors.items()]), "file", ["seq"])
    return last.select("file", *factors, health({name: F.col(name) for name in factors}).alias("health"))


def merged_timeline(parts: list[DataFrame], n: int = 100) -> DataFrame:
    """The last n rows of several timelines (at, key and what else they share), in order of time."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.where("at IS NOT NULL").orderBy(F.desc("at"), F.desc("key")).limit(n).orderBy("at", "key")


def plan_steps(query: str) -> list[str]:
    """How to read the store step by step: index, timeline, whole records."""
    return [f"index of records for '{query}'", "timeline around the chosen ids", "whole records of the ids that are left"]
