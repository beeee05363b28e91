"""Clusters of records that share files and concepts, their duplicates and summaries.

Records with the same set of values act as one, so a set that a third of all rows share is
compared once. Candidate pairs share one of their rarest values: with a similarity over t,
two sets have a value in common among the ``n - floor(t * n)`` rarest of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextframe.functions.text import let
from contextframe.operators.memory import csv_set
from contextframe.sources.tables import cut_lineage, drop_cut

#: Thresholds that must be exceeded, in tenths, and words of a shingle.
JACCARD, OVERLAP, SIMILAR = 3, 7, 6
SHINGLE, SENTENCE_SHINGLE = 4, 3
#: States of a set while leaders are chosen.
UNDECIDED, LEADS, TAKEN = 0, 1, 2


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _rare_first(sets: DataFrame, group: str) -> DataFrame:
    """Sets with their values ordered by how many sets of the group have them."""
    exploded = sets.select(group, "set_id", F.explode("items").alias("item"))
    often = exploded.groupBy(group, "item").agg(F.count("*").alias("n"))
    return exploded.join(often, [group, "item"]).groupBy(group, "set_id").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("ranked"))


def classes(rows: DataFrame, group: str, order: list[str], key: str = "id") -> DataFrame:
    """(group, items, set_id, first): distinct sets of each group with their first row by ``order``."""
    return rows.where(F.size("items") > 0).groupBy(group, "items").agg(F.min(F.struct(*order, F.col(key).alias("_key"))).alias("first")).withColumn("set_id", F.col("first._key"))


def set_edges(sets: DataFrame, group: str, tenths: int = JACCARD) -> DataFrame:
    """(group, a, b, similarity): pairs of sets with a Jaccard similarity over the threshold, the earlier one as a.

    Only ids and sizes travel with the values; the sets themselves are fetched for the pairs that are left.
    """
    size = F.size("ranked")
    heads = _rare_first(sets, group).select(group, "set_id", size.alias("n"), F.explode(F.slice("ranked", F.lit(1), size - F.floor(size * tenths / 10).cast("int"))).alias("_r")).withColumn("item", F.col("_r.item")).drop("_r")
    a, b = heads.toDF(group, "a", "n_a", "item"), heads.toDF(group, "b", "n_b", "item")
    fits = (F.col("n_a") * 10 > F.col("n_b") * tenths) & (F.col("n_b") * 10 > F.col("n_a") * tenths)
    pairs = a.join(b, [group, "item"]).where((F.col("a") != F.col("b")) & fits).select(group, "a", "b").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(group, F.col("set_id").alias(end), F.col("items").alias(f"items_{end}"), F.col("first").alias(f"first_{end}")), [group, end])
    pairs = pairs.where(F.col("first_a") < F.col("first_b"))
    return pairs.withColumn("similarity", jaccard(F.col("items_a"), F.col("items_b"))).where(F.col("similarity") * 10 > tenths).select(group, "a", "b", "first_a", "first_b", "similarity")


def leaders(rows: DataFrame, group: str, order: list[str], key: str = "id") -> DataFrame:
    """(key, leader): each row's cluster leader, by greedy clustering in order.

    Going through the rows in order, a row joins the first leader its set is similar to, else
    leads a cluster of its own; empty sets are alone. The leaders are the first maximal
    independent set of the similarity graph in that order: an undecided set is taken if an
    earlier neighbour leads, and leads if no earlier neighbour is undecided. Steps are at
    most twice as many as the longest chain of undecided sets; two are made between writes.
    """
    sets = cut_lineage(classes(rows, group, order, key))
    edges = cut_lineage(set_edges(sets, group))

    def step(state: DataFrame) -> DataFrame:
        earlier = edges.select(group, "a", F.col("b").alias("v")).join(state.select(group, F.col("v").alias("a"), F.col("s").alias("_s")), [group, "a"])
        seen = earlier.groupBy(group, "v").agg(F.bool_or(F.col("_s") == UNDECIDED).alias("open"), F.bool_or(F.col("_s") == LEADS).alias("led"))
        after = F.when(F.col("s") != UNDECIDED, F.col("s")).when(F.coalesce("led", F.lit(False)), TAKEN).when(~F.coalesce("open", F.lit(False)), LEADS).otherwise(UNDECIDED)
        return state.join(seen, [group, "v"], "left").select(group, "v", after.alias("s"))

    nodes = edges.select(group, F.col("a").alias("v")).union(edges.select(group, F.col("b").alias("v"))).distinct()
    state = cut_lineage(step(nodes.withColumn("s", F.lit(UNDECIDED))))
    while not state.where(F.col("s") == UNDECIDED).isEmpty():
        before, state = state, cut_lineage(step(step(state)))
        drop_cut(before)
    led = state.where(F.col("s") == LEADS).select(group, "v")
    joins = (
        edges.join(led.withColumnRenamed("v", "a"), [group, "a"], "left_semi")
        .join(led.withColumnRenamed("v", "b"), [group, "b"], "left_anti")
        .groupBy(group, F.col("b").alias("set_id"))
        .agg(F.min_by("a", "first_a").alias("leader"))
    )
    by_set = sets.join(joins, [group, "set_id"], "left").select(group, "items", F.coalesce("leader", "set_id").alias("leader"))
    together = rows.where(F.size("items") > 0).select(group, "items", key).join(by_set, [group, "items"]).select(key, "leader")
    return together.unionByName(rows.where(F.size("items") == 0).select(key, F.col(key).alias("leader")))


def clusters(observations: DataFrame) -> DataFrame:
    """(id, project, leader, cluster): records clustered by files, and each such cluster by concepts; ``cluster`` is the id of its first record."""
    base = observations.where("project IS NOT NULL").select("id", "project", "created_at", csv_set(F.col("files")).alias("items"), csv_set(F.col("concepts")).alias("concepts"))
    by_files = leaders(base, "project", ["created_at"])
    rows = cut_lineage(base.join(by_files, "id").select("id", "project", "created_at", F.col("concepts").alias("items"), F.col("leader").alias("part")))
    by_concepts = leaders(rows, "part", ["created_at"]).withColumnRenamed("leader", "cluster")
    return rows.select("id", "project", F.col("part").alias("leader")).join(by_concepts, "id")


def topics(observations: DataFrame, clustered: DataFrame) -> DataFrame:
    """(cluster, topic): the most frequent file stem and concept of each cluster, the first by name among equals."""
    rows = clustered.join(observations.select("id", "files", "concepts"), "id")
    stem = F.regexp_replace(F.regexp_extract("v", r"([^/]+)/*$", 1), r"(?<=.)\.[^.]*$", "")

    def top(column: str, name: str, value: Column) -> DataFrame:
        counted = rows.select("cluster", F.explode(csv_set(F.col(column))).alias("v")).groupBy("cluster", value.alias(name)).agg(F.count("*").alias("n"))
        return counted.groupBy("cluster").agg(F.min_by(name, F.struct(-F.col("n"), name)).alias(name))

    both = rows.select("cluster").distinct().join(top("files", "file", stem), "cluster", "left").join(top("concepts", "concept", F.col("v")), "cluster", "left")
    topic = F.when(F.col("file").isNotNull() & F.col("concept").isNotNull(), F.format_string("%s (%s)", "file", "concept")).otherwise(F.coalesce("file", "concept", F.lit("uncategorized")))
    return both.select("cluster", topic.alias("topic"))


def shingles(text: Column, n: int) -> Column:
    """The distinct runs of n words in lower case, as numbers; one run of all words where there are fewer."""
    runs = let(
        F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""),
        lambda words: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "))),
    )
    return F.array_distinct(runs)


def duplicates(observations: DataFrame, clustered: DataFrame) -> DataFrame:
    """(id): records that a later one of their cluster contains: over 0.7 of the smaller one's shingles are shared.

    Of records with the same shingles only the latest is compared; the others are duplicates.
    """
    rows = clustered.select("id", "cluster").join(observations.where("text IS NOT NULL").select("id", "text"), "id").select("id", "cluster", F.array_sort(shingles(F.col("text"), SHINGLE)).alias("items"))
    latest = rows.groupBy("cluster", "items").agg(F.max("id").alias("set_id"))
    copies = rows.join(latest, ["cluster", "items"]).where("id <> set_id").select("id")
    sets = latest.withColumn("n", F.size("items"))
    # more than 0.7 * n of the smaller set are shared, so one of its rarest is; the larger one may have any number of others
    head = F.slice("ranked", F.lit(1), F.size("ranked") - F.floor(F.size("ranked") * OVERLAP / 10).cast("int"))
    ranked = _rare_first(sets, "cluster").select("cluster", "set_id", F.size("ranked").alias("n"), "ranked", head.alias("head"))
    heads = ranked.select("cluster", F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.explode("head.item").alias("item"))
    full = ranked.select("cluster", F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.explode("ranked.item").alias("item"))
    pairs = heads.join(full, ["cluster", "item"]).where("a <> b AND n_a <= n_b").select("cluster", "a", "b").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(sets.select("cluster", F.col("set_id").alias(end), F.col("items").alias(f"items_{end}")), ["cluster", end])
    close = pairs.where(F.size(F.array_intersect("items_a", "items_b")) * 10 > F.size("items_a") * OVERLAP)
    return close.select(F.least("a", "b").alias("id")).union(copies).distinct()


def sentences(text: Column) -> Column:
    """The sentences of a text: cut behind ``.``, ``!`` or ``?`` where a blank, a line break or the end follows."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])(?=[ \n])[ \n]*"), lambda s: F.trim(s)), lambda s: s != "")


def norm_words(text: Column) -> Column:
    """The words in lower case without outer marks, of at least two bytes."""
    words = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(words, lambda w: F.octet_length(w) >= 2)


def scored_sentences(observations: DataFrame, clustered: DataFrame) -> DataFrame:
    """(cluster, id, pos, sentence, score): sentences of at least three words by the mean of ln(N / df) + 1 of their words."""
    rows = clustered.select("id", "cluster").join(observations.where("text IS NOT NULL").select("id", "text"), "id")
    size = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    spread = rows.select("cluster", "id", F.explode(F.array_distinct(norm_words(F.col("text")))).alias("word")).groupBy("cluster", "word").agg(F.count("*").alias("df"))
    found = rows.select("cluster", "id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).where(F.size(F.split("sentence", r"\s+")) >= 3)
    words = found.select("cluster", "id", "pos", F.explode(norm_words(F.col("sentence"))).alias("word"))
    score = words.join(spread, ["cluster", "word"]).join(size, "cluster").groupBy("cluster", "id", "pos").agg(F.round(F.avg(F.log(F.col("n") / F.col("df")) + 1), 6).alias("score"))
    return found.join(score, ["cluster", "id", "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def summaries(observations: DataFrame, clustered: DataFrame, most: int = 3) -> DataFrame:
    """(cluster, summary): the best sentences that are not much alike, joined by bars.

    Each of the ``most`` rounds takes the best sentence of each cluster that does not share
    over 0.6 of its three-word runs with one taken before, so no cluster is ever gathered.
    The sentences are written once, and after that only those taken, one for a cluster.
    """
    found = cut_lineage(scored_sentences(observations, clustered).withColumn("runs", shingles(F.col("sentence"), SENTENCE_SHINGLE)))
    taken: list[DataFrame] = []
    for number in range(most):
        left = found
        for before in taken:
            alike = F.size(F.array_intersect("runs", "best_runs")) * 10 > F.least(F.size("runs"), F.size("best_runs")) * SIMILAR
            left = left.join(before.select("cluster", "best_runs"), "cluster").where(~alike).drop("best_runs")
        best = left.groupBy("cluster").agg(F.min_by(F.struct("sentence", "runs"), F.struct(-F.col("score"), "id", "pos")).alias("b"))
        taken.append(cut_lineage(best.select("cluster", F.col("b.sentence").alias("best"), F.col("b.runs").alias("best_runs"), F.lit(number).alias("no"))))
    chosen = taken[0]
    for part in taken[1:]:
        chosen = chosen.unionByName(part)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "best"))), lambda x: x["best"]), " | ")
    return chosen.groupBy("cluster").agg(texts.alias("summary"))


def counters(clustered: DataFrame, dropped: DataFrame) -> DataFrame:
    """How many clusters, summaries and duplicates a run over the records makes."""
    kept = clustered.join(dropped, "id", "left_anti").agg(F.count_distinct("cluster").alias("summaries_created"))
    return clustered.agg(F.count_distinct("cluster").alias("clusters")).crossJoin(kept).crossJoin(dropped.agg(F.count("*").alias("duplicates_removed")))
