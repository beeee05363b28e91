"""Structured Streaming versions of the event operators.

Every function takes a streaming DataFrame with the columns of ``token_events`` and returns
one, so that the caller chooses sink and trigger. Each has a batch twin of the same result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextframe.operators.policy import read_denied


def read(spark: SparkSession, path: str, *, files_per_trigger: int = 4) -> DataFrame:
    """A folder or file of events as a stream, with times that watermarks accept."""
    schema = spark.read.parquet(path).schema
    path = path[:-1] + f"[{path[-1]}]"  # only a pattern may stand for a single file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)
    return stream.withColumn("created_at", F.col("created_at").cast("timestamp"))


def metrics(events: DataFrame) -> DataFrame:
    """Running totals by tool, for the complete or update mode."""
    return events.groupBy("tool").agg(F.count("*").alias("calls"), F.sum("estimated_raw_tokens").alias("raw_tokens"), F.sum("estimated_compressed_tokens").alias("compressed_tokens"))


def distinct_events(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events without those sent again.

    All ids are kept as state, so that no event is lost however late it is, clocks that were
    never set among them. With ``late`` an id is kept only until the watermark has passed
    it, and events that are later than that are dropped.
    """
    if late is None:
        return events.dropDuplicates(["id"])
    return events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Totals by tool and time window, final once the watermark has passed the window (an extension)."""
    spans = events.withWatermark("created_at", late).groupBy(F.window("created_at", width), "tool")
    return spans.agg(F.count("*").alias("calls"), F.sum("estimated_raw_tokens").alias("raw_tokens"))


def post_call(events: DataFrame, most_calls: int = 40, most_tokens: int = 500_000, least: int = 50) -> DataFrame:
    """(session_id, kind, detail): what follows the calls of each session, in one stream for the update mode.

    A hint once a session passes the calls or the raw tokens, a loop once it used one tool
    ``least`` times, and a governance row for each call whose subject must not be read. None
    depends on the order in which calls arrive. Hints and loops come again as in
    ``error_loops``; governance rows come once for each call and may be equal, so ``once`` must
    leave them out. State is two sums and a counter for each tool of a session.
    """
    calls = events.where("session_id IS NOT NULL")
    guarded = calls.where(read_denied(F.col("subject"))).select("session_id", F.lit("governance").alias("kind"), F.col("subject").alias("detail"))
    part = lambda kind, detail, n: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), n.cast("bigint").alias("n"))
    parts = F.array(part("hint", F.lit("calls"), F.lit(1)), part("hint", F.lit("tokens"), F.coalesce("estimated_raw_tokens", F.lit(0))), part("loop", F.col("tool"), F.lit(1)))
    sums = calls.select("session_id", F.inline(parts)).where("detail IS NOT NULL").groupBy("session_id", "kind", "detail").agg(F.sum("n").alias("_n"))
    most = F.when(F.col("kind") == "loop", least - 1).when(F.col("detail") == "calls", most_calls).otherwise(most_tokens)
    return sums.where(F.col("_n") > most).select("session_id", "kind", "detail").unionByName(guarded)


def error_loops(errors: DataFrame, least: int = 3) -> DataFrame:
    """(session_id, signature, times): a session that met a signature ``least`` times, for the update mode.

    The row comes with the batch that reaches ``least`` and, the same, with each later one that
    has the signature again; ``drained`` with ``once`` gives it once. State is one counter for a
    session's signature, partial sums of which are made before the shuffle.
    """
    counts = errors.groupBy("session_id", "signature").agg(F.count("*").alias("_n"))
    return counts.where(F.col("_n") >= least).select("session_id", "signature", F.lit(least).cast("bigint").alias("times"))


def drained(stream: DataFrame, place: str, mode: str, once: str | None = None) -> DataFrame:
    """All that is there run through a stream into files below ``place``, and those.

    A batch that runs again after a loss writes its own folder again. In the complete mode
    the last batch is the result. In the update mode rows come again; where the condition
    ``once`` holds, equal rows of the files are one.
    """
    empty = stream.sparkSession.createDataFrame([], stream.schema)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/result" if mode == "complete" else f"{place}/result/batch-{number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    try:
        found = stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{place}/result")
    except AnalysisException:
        return empty
    return found if once is None else found.where(once).distinct().unionByName(found.where(~F.expr(once)))


def append_snapshots(stream: DataFrame, path: str, checkpoint: str, seconds: int = 2):  # noqa: ANN201
    """Every change of a running total written as JSON, by default every two seconds."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").json(path)

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
