"""Session state as folds over logs of actions: phases, slots, blocks, seen files and learned patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextframe.operators.running import carried, running_sums

#: The phase that each tool call or event leads to.
PHASES = {"smart_read": "Analyzing", "smart_edit": "Editing", "smart_run": "Verifying", "task_complete": "Complete"}
#: Slots of a workspace, bytes of a block, and how confidence in patterns starts and grows.
SLOTS = ("goal", "plan", "files", "notes", "decisions", "errors")
BLOCK_BYTES = 10_000
START, STEP, FIX_START = 0.3, 0.1, 0.5
#: Items of a basket whose pairs are made within one row, and numbers of a log that run in one task.
BASKET, PART = 1_000, 10_000


def loops(errors: DataFrame, least: int = 3) -> DataFrame:
    """(session_id, signature, times): error signatures that a session met at least ``least`` times."""
    return errors.groupBy("session_id", "signature").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def phases(calls: DataFrame, bucket: Column | None = None) -> DataFrame:
    """(session_id, seq, tool, phase): the phase after each call; other tools leave it as it is, and it starts as Idle.

    ``bucket`` cuts a session's calls into parts along ``seq``, such as days, that run apart.
    """
    phase = F.lit(None).cast("string")
    for tool, name in PHASES.items():
        phase = F.when(F.col("tool") == tool, name).otherwise(phase)
    found = carried(calls.select("session_id", "seq", "tool"), "session_id", F.lit(0) if bucket is None else bucket, ["seq"], phase, "phase")
    return found.withColumn("phase", F.coalesce("phase", F.lit("Idle")))


def compacted_phases(calls: DataFrame, bucket: Column | None = None) -> DataFrame:
    """:func:`phases` with compactions: ``pre_compact`` shows Compacting and ``post_compact`` brings the phase before it back.

    What happens within a compaction holds until its end; a ``post_compact`` without a
    ``pre_compact``, and ``cwd_changed``, lead to Idle.
    """
    bucket = F.lit(0) if bucket is None else bucket
    own = F.when(F.col("tool") == "cwd_changed", "Idle")
    for tool, name in PHASES.items():
        own = own.when(F.col("tool") == tool, name)
    mark = F.when(F.col("tool").isin("pre_compact", "post_compact"), F.col("tool"))
    rows = carried(calls.select("session_id", "seq", "tool"), "session_id", bucket, ["seq"], mark, "_now")
    rows = carried(rows, "session_id", bucket, ["seq"], mark, "_before", before=True)
    inside = F.coalesce(F.col("_now") == "pre_compact", F.lit(False))
    orphan = (F.col("tool") == "post_compact") & ~F.coalesce(F.col("_before") == "pre_compact", F.lit(False))
    rows = carried(rows, "session_id", bucket, ["seq"], F.when(orphan, "Idle").when(~inside, own), "_outside")
    rows = carried(rows, "session_id", bucket, ["seq"], F.when(F.col("tool") == "pre_compact", "Compacting").when(inside, own), "_inside")
    return rows.select("session_id", "seq", "tool", F.when(inside, F.col("_inside")).otherwise(F.coalesce("_outside", F.lit("Idle"))).alias("phase"))


def slots(actions: DataFrame, part: int = PART) -> DataFrame:
    """(slot, seq, value, full): each read of a slot with the last value written since it was cleared, full on the first read since then.

    ``actions`` has slot, seq, action (read, write or clear) and value. Values run in parts of
    ``part`` numbers of ``seq``, so a slot with most of the actions is many tasks.
    """
    bucket = F.floor(F.col("seq") / part)
    is_read, clears = F.col("action") == "read", F.col("action") == "clear"
    rows = running_sums(actions, "slot", bucket, ["seq"], {"reads": is_read.cast("int")})
    # what the last write or clear left: its value, and how many reads came before the last clear
    left = F.when(F.col("action").isin("write", "clear"), F.struct(F.when(~clears, F.col("value")).alias("value")))
    rows = carried(rows, "slot", bucket, ["seq"], left, "left")
    rows = carried(rows, "slot", bucket, ["seq"], F.when(clears, F.col("reads")), "read_before")
    return rows.where("action = 'read'").select("slot", "seq", F.col("left.value").alias("value"), (F.col("reads") - F.coalesce("read_before", F.lit(0)) == 1).alias("full"))


def valid_slot(name: Column, value: Column) -> Column:
    """Whether a slot of this name may hold this value."""
    return name.isin(*SLOTS) & (F.octet_length(value) <= BLOCK_BYTES)


def blocks(actions: DataFrame, part: int = PART) -> DataFrame:
    """(block, reader, seq, version, delivery): what each read of a versioned block delivers: full, changed or unchanged.

    ``actions`` has block, reader, seq and action; writes over the byte limit change nothing.
    Versions run in parts as in :func:`slots`, and so do a reader's reads of a block.
    """
    write = (F.col("action") == "write") & (F.octet_length("value") <= BLOCK_BYTES)
    rows = running_sums(actions, "block", F.floor(F.col("seq") / part), ["seq"], {"version": F.when(write, 1).otherwise(0)})
    reads = rows.where("action = 'read'").withColumn("_own", F.struct("block", "reader"))
    reads = carried(reads, "_own", F.floor(F.col("seq") / part), ["seq"], F.col("version"), "before", before=True)
    return reads.select("block", "reader", "seq", "version", F.when(F.col("before").isNull(), "full").when(F.col("before") < F.col("version"), "changed").otherwise("unchanged").alias("delivery"))


def stale(files: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, hash, stale): whether a file was never seen or changed since it was last seen; ``seen`` has path, seen_hash and seq."""
    last = seen.groupBy("path").agg(F.max_by("seen_hash", "seq").alias("seen_hash"), F.lit(True).alias("known"))
    return files.join(last, "path", "left").select("path", "hash", (F.col("known").isNull() | ~F.col("hash").eqNullSafe(F.col("seen_hash"))).alias("stale"))


def pairs(baskets: DataFrame, basket: str, item: str, most: int = BASKET) -> DataFrame:
    """(file_a, file_b, evidence): items of the same basket, each undirected pair once, counted over baskets.

    Baskets are what one session or order touched. The pairs of a basket of up to ``most``
    items are made within the row of its sorted items; the items of larger ones are cut into
    blocks of about as many, which meet pairwise, so that no row or task holds all of one.
    """
    items = baskets.where(F.col(item).isNotNull()).select(F.col(basket).alias("_k"), F.col(item).alias("_i")).distinct()
    large = items.groupBy("_k").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("_k", F.ceil(F.col("_n") / most).cast("int").alias("_p"))
    sets = items.join(large, "_k", "left_anti").groupBy("_k").agg(F.array_sort(F.collect_set("_i")).alias("items"))
    two = F.flatten(F.transform("items", lambda a, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda b: F.struct(a.alias("file_a"), b.alias("file_b")))))
    blocked = items.join(large, "_k").withColumn("_b", F.pmod(F.xxhash64("_i"), F.col("_p")).cast("int"))
    hot = blocked.select("_k", "_i", "_b", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("_o")).select("_k", F.least("_b", "_o").alias("_x"), F.greatest("_b", "_o").alias("_y"), "_i", "_b")
    joined = hot.toDF("_k", "_x", "_y", "file_a", "_a").join(hot.toDF("_k", "_x", "_y", "file_b", "_b"), ["_k", "_x", "_y"]).where("file_a < file_b AND (_x = _y OR _a <> _b)").select("file_a", "file_b")
    made = sets.select(F.explode(two).alias("p")).select("p.file_a", "p.file_b").unionByName(joined)
    return made.groupBy("file_a", "file_b").agg(F.count("*").alias("evidence"))


def confidence(evidence: Column, start: float = START) -> Column:
    """Confidence in a pattern seen so often, at most 1."""
    return F.round(F.least(F.lit(1.0), F.lit(start) + F.lit(STEP) * (evidence - 1)), 6)


def decayed(patterns: DataFrame, rate: float, rounds: int, threshold: float) -> DataFrame:
    """Patterns after some rounds of decay, without those whose confidence fell below the threshold."""
    return patterns.withColumn("confidence", F.round(F.col("confidence") * (1 - rate) ** rounds, 6)).where(F.col("confidence") >= threshold)


def known_fixes(fixes: DataFrame) -> DataFrame:
    """(signature, evidence, confidence, fix): how often a signature was fixed, and the last fix."""
    return fixes.groupBy("signature").agg(F.count("*").alias("evidence"), F.max_by("fix", "seq").alias("fix")).withColumn("confidence", confidence(F.col("evidence"), FIX_START))


def neighbours(found: DataFrame, file: str) -> DataFrame:
    """(file, evidence): the files seen together with one."""
    other = F.when(F.col("file_a") == file, F.col("file_b")).otherwise(F.col("file_a"))
    return found.where((F.col("file_a") == file) | (F.col("file_b") == file)).select(other.alias("file"), "evidence")


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, state): each row's other columns as one JSON text."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("state"))


def from_json(states: DataFrame, key: str, schema: str) -> DataFrame:
    """The rows of :func:`as_json` again; a text that is no such JSON gives nulls."""
    return states.select(key, F.from_json("state", schema).alias("_s")).select(key, "_s.*")
