"""Rank errors of digests, merged or not, against exact ranks."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contextframe.llm import percentiles as P


def leaves(values):
    return np.floor((np.arcsinh(values / P.FINE) / P._SPAN + 1) * 2 ** (P.LEVELS - 1)).astype(np.int64) + 2**P.LEVELS


def worst(nodes, counts, values):
    """By how many ranks the worst of many percentiles is off."""
    ordered, off = np.sort(leaves(values)), 0
    for q in np.linspace(0.001, 1, 200):
        found = leaves(np.array([P.quantile(nodes, counts, q)]))[0]
        rank = max(1, math.ceil(q * len(values)))
        off = max(off, np.searchsorted(ordered, found) + 1 - rank, rank - np.searchsorted(ordered, found, "right"))
    return off


@pytest.mark.parametrize("k", [50, 400])
@pytest.mark.parametrize("parts", [1, 7])
def test_bound_holds(k, parts):
    rng = np.random.default_rng(3)
    for values in (rng.lognormal(0, 4, 20_000) * rng.choice([-1, 1], 20_000), np.zeros(9_000), np.repeat(rng.normal(size=5), 3_000), np.arange(12_345.0)):
        made = [P.compress(part, np.ones(len(part), np.int64), k) for part in np.array_split(leaves(values), parts)]
        nodes, counts = P.compress(np.concatenate([n for n, _ in made]), np.concatenate([c for _, c in made]), k)
        assert counts.sum() == len(values)
        assert worst(nodes, counts, values) <= P.LEVELS / k * len(values) + 1
        assert len(nodes) <= 3 * k + P.LEVELS


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-1e15, 1e15), min_size=1, max_size=300))
def test_small_sets_are_exact(values):
    values = np.array(values)
    nodes, counts = P.compress(leaves(values), np.ones(len(values), np.int64))
    for q in (0.5, 0.9, 1.0):
        exact = np.sort(values)[max(1, math.ceil(q * len(values))) - 1]
        assert abs(P.quantile(nodes, counts, q) - exact) <= 2e-5 * abs(exact) + 2e-11


def test_merging_days_gives_the_union(spark):
    df = spark.range(40_000).select((F.col("id") % 3).cast("string").alias("g"), (F.rand(1) * 1000).alias("x"), (F.col("id") % 2).alias("day"))
    whole = {r.g: r for r in P.percentiles(P.digests(df, ["g"], F.col("x"), 200), ["g"], k=200).collect()}
    days = P.digests(df.where("day = 0"), ["g"], F.col("x"), 200).unionByName(P.digests(df.where("day = 1"), ["g"], F.col("x"), 200))
    for row in P.percentiles(P.merged(days, ["g"], 200), ["g"], k=200).collect():
        values = np.sort([r.x for r in df.where(F.col("g") == row.g).collect()])
        for found in (row, whole[row.g]):
            assert found.n == len(values)
            for name, q in (("p50", 0.5), ("p99", 0.99)):
                rank = np.searchsorted(values, found[name])
                assert abs(rank - q * len(values)) <= found.rank_error + 2


def test_what_counts(spark):
    rows = [("a", "t", "c", 1.0, 5), ("a", "t", "c", 1.0, 5), ("b", None, "c", float("nan"), 7), ("d", "t", None, None, None), (None, "t", "c", 3.0, 1), (None, "t", "c", 3.0, 1)]
    df = spark.createDataFrame(rows, "id string, tool string, category string, savings_ratio double, saved_tokens bigint").withColumn("created_at", F.lit("2025-01-01 10:00:00").cast("timestamp"))
    n = {(r.grouping, r.member, r.measure): r.n for r in P.event_digests(df).withColumn("n", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)).collect()}
    assert n[("tool", "t", "savings_ratio")] == 3 and n[("tool", None, "saved_tokens")] == 1
    assert ("tool", None, "savings_ratio") not in n and n[("day", "2025-01-01", "saved_tokens")] == 4
    assert P.event_digests(df.limit(0)).count() == 0
    ends = df.select(F.lit("x").alias("g"), F.explode(F.array(F.lit(float("inf")), F.lit(-float("inf")), F.lit(1e300)))).limit(3)
    assert sum(P.digests(ends, ["g"], F.col("col")).first().counts) == 3
    assert {(r.grouping, r.member, r.measure): r.n for r in P.rank_checks(df).where("right").collect()} == n


def test_names_of_percentiles(spark):
    found = P.percentiles(P.digests(spark.range(1_000), ["id"], F.col("id")).where("id = 7"), ["id"], (0.5, 0.99, 0.999))
    assert found.columns == ["id", "n", "p50", "p99", "p99_9", "rank_error"] and abs(found.first().p99_9 - 7) < 1e-3


def test_a_hot_key_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN", 4)
    df = spark.range(0, 60_000, 1, 40).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 997).cast("string")).alias("g"), F.hash("id").alias("x"))
    made = P.digests(df, ["g"], F.col("x"), 100)
    hot = made.where("g = 'hot'").collect()
    assert len(hot) == 1 and len(hot[0].nodes) <= 300 + P.LEVELS and sum(hot[0].counts) == 40_000
    assert made.count() == df.select("g").distinct().count()
    (row,) = P.percentiles(made.where("g = 'hot'"), ["g"], k=100).collect()
    below = df.where((F.col("g") == "hot") & (F.col("x") < row.p90)).count()
    assert abs(below - 36_000) <= row.rank_error + 1
