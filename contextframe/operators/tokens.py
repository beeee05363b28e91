"""Token accounting: events, summaries, benchmarks, quality, feedback and running counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextframe.operators.running import running_sums

#: Share of the raw tokens, in percent, that each tool's answer is taken to keep.
KEPT_PERCENT = {"smart_read": 10, "project_map": 10, "smart_run": 8, "smart_edit": 50}
KEPT_OTHERWISE = 80
#: Fixed value: milliseconds over which a run that passed counts as slow.
SLOW_MS = 120_000


def savings_ratio(raw: Column, compressed: Column) -> Column:
    """Share of tokens saved; 0 where nothing was raw, negative where the answer grew."""
    return F.when(F.coalesce(raw, F.lit(0)) == 0, F.lit(0.0)).otherwise((raw - compressed).cast("double") / raw)


def _totals() -> list[Column]:
    raw, compressed = F.sum("estimated_raw_tokens"), F.sum("estimated_compressed_tokens")
    return [
        F.count("*").alias("events"),
        F.coalesce(raw, F.lit(0)).alias("raw_tokens"),
        F.coalesce(compressed, F.lit(0)).alias("compressed_tokens"),
        F.coalesce(raw - compressed, F.lit(0)).alias("saved_tokens"),
        savings_ratio(raw, compressed).alias("savings_ratio"),
    ]


def summary(events: DataFrame) -> DataFrame:
    """One row of totals; zeros for no events."""
    return events.agg(*_totals())


def by(events: DataFrame, *keys: str) -> DataFrame:
    """Totals by key, in the order of the keys; the ratio is that of the sums."""
    return events.groupBy(*keys).agg(*_totals()).orderBy(*keys)


def grouping(events: DataFrame) -> DataFrame:
    """Grand total, totals by tool and totals by category in one aggregation."""
    return (
        events.groupingSets([[], ["tool"], ["category"]], "tool", "category")
        .agg(F.grouping_id().cast("bigint").alias("level"), *_totals())
        .withColumn("level", F.when(F.col("level") == 3, "total").when(F.col("level") == 1, "tool").otherwise("category"))
    )


def of_session(events: DataFrame, session_id: str, group_by: str | None = "tool") -> DataFrame:
    """Totals of one session by tool or category, or overall for ``none``; any other grouping means tool."""
    own = events.where(F.col("session_id") == session_id)
    if group_by == "none":
        return summary(own)
    return by(own, group_by if group_by in ("tool", "category") else "tool")


def top_sessions(events: DataFrame, k: int) -> DataFrame:
    """The k sessions that saved most."""
    return events.where("session_id IS NOT NULL").groupBy("session_id").agg(*_totals()).orderBy(F.desc("saved_tokens"), "session_id").limit(k)


def assumed_event(tool: Column, output: Column) -> list[Column]:
    """Raw tokens of an output by bytes, and the compressed ones the tool is taken to need."""
    raw = F.floor(F.octet_length(output) / 4).cast("bigint")
    percent = F.lit(KEPT_OTHERWISE)
    for name, kept in KEPT_PERCENT.items():
        percent = F.when(tool == name, kept).otherwise(percent)
    return [raw.alias("raw_tokens"), F.floor(raw * percent / 100).cast("bigint").alias("compressed_tokens")]


def benchmark(results: DataFrame) -> DataFrame:
    """(cases, passed, failed, mean_ratio) of rows with ``ratio``, ``least`` and ``most``; the mean is one of ratios, 0 for no rows."""
    passed = F.col("ratio").between(F.col("least"), F.col("most"))
    return results.agg(
        F.count("*").alias("cases"),
        F.count_if(passed).alias("passed"),
        F.count_if(~F.coalesce(passed, F.lit(False))).alias("failed"),
        F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("mean_ratio"),
    )


def feedback(ratings: DataFrame) -> DataFrame:
    """Counts of the ratings 1, 2 and 3; others are not valid and not counted."""
    return ratings.agg(*(F.count_if(F.col("rating") == n).alias(name) for n, name in ((1, "bad"), (2, "fine"), (3, "good"))))


def quality(exit_code: Column, failed: Column, duration_ms: Column) -> Column:
    """Bad if a run or one of its tests failed, Warning if it was slow, else Good."""
    return F.when((F.coalesce(exit_code, F.lit(0)) != 0) | (F.coalesce(failed, F.lit(0)) > 0), "Bad").when(duration_ms > SLOW_MS, "Warning").otherwise("Good")


def experiment_report(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Mean ratio and runs of each pipeline; run number i took the pipeline at place i modulo the enabled ones.

    Pipelines are settings of an experiment, a handful, so they are numbered in one task and broadcast.
    """
    enabled = pipelines.where("enabled").withColumn("slot", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("position")) - 1)
    width = enabled.agg(F.count("*").alias("width"))
    return (
        runs.crossJoin(F.broadcast(width))
        .withColumn("slot", F.when(F.col("width") > 0, F.pmod("seq", "width")))
        .join(F.broadcast(enabled.select("slot", "pipeline")), "slot")
        .groupBy("pipeline")
        .agg(F.count("*").alias("runs"), F.round(F.avg("ratio"), 6).alias("mean_ratio"))
    )


def report(totals: DataFrame, kind: str = "markdown") -> DataFrame:
    """A report of one-row totals as text; ``text`` or ``plain`` without mark-up, any other kind is Markdown."""
    numbers = ("events", "raw_tokens", "compressed_tokens", "saved_tokens")
    percent = F.format_string("%.2f%%", F.col("savings_ratio") * 100)
    if kind in ("text", "plain"):
        lines = [F.concat(F.lit(f"{name}: "), F.col(name).cast("string")) for name in numbers] + [F.concat(F.lit("savings: "), percent)]
    else:
        lines = [F.lit("| measure | value |"), F.lit("| --- | --- |")]
        lines += [F.concat(F.lit(f"| {name} | "), F.col(name).cast("string"), F.lit(" |")) for name in numbers]
        lines += [F.concat(F.lit("| savings | "), percent, F.lit(" |"))]
    return totals.select(F.concat_ws("\n", *lines).alias("report"))


def hints(calls: DataFrame, most_calls: int = 40, most_tokens: int = 500_000) -> DataFrame:
    """The call at which a session first passes each limit of calls and of raw tokens; each limit hints once.

    Calls are ordered by ``created_at`` and ``id``; they run within a session's days, so a
    session with a third of all calls is many tasks. Calls without a time come last.
    """
    amount = F.coalesce("estimated_raw_tokens", F.lit(0))
    day = F.coalesce(F.to_date("created_at"), F.lit("9999-12-31").cast("date"))
    ordered = calls.withColumn("_at", F.coalesce(F.col("created_at").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")))
    running = running_sums(ordered, "session_id", day, ["_at", "id"], {"calls": F.lit(1), "tokens": amount})
    before = F.col("tokens") - amount
    found = F.array(F.when(F.col("calls") == most_calls + 1, "calls"), F.when((F.col("tokens") > most_tokens) & (before <= most_tokens), "tokens"))
    return running.select("session_id", "id", "calls", "tokens", F.explode(F.array_compact(found)).alias("hint"))


def snapshot(events: DataFrame) -> DataFrame:
    """Counters by file: calls, tokens before and after."""
    return events.groupBy("subject").agg(F.count("*").alias("calls"), F.sum("estimated_raw_tokens").alias("raw_tokens"), F.sum("estimated_compressed_tokens").alias("compressed_tokens"))


def merged_snapshots(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two snapshots made one by adding the counters of each file."""
    return one.unionByName(other).groupBy("subject").agg(*(F.sum(c).alias(c) for c in ("calls", "raw_tokens", "compressed_tokens")))


def latest(events: DataFrame, n: int = 100) -> DataFrame:
    """The bounded timeline: the last n events by time and id."""
    return events.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(n)
