"""Pairs and groups against every pair counted one by one, with and without splits."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from contextframe.llm import neardup as N


def brute(rows):
    bags = [(key, Counter(re.findall(r"\w+", text.lower()))) for key, text in rows if text]
    bags = [(key, bag, bag.total()) for key, bag in bags if bag]
    return {(min(a, b), max(a, b)) for k, (a, x, n) in enumerate(bags) for b, y, m in bags[:k] if (x & y).total() * 10 >= 8 * max(n, m) and a != b}


def corpus(seed, size):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["the", "of"] * 20
    rows: list[tuple[int, str | None]] = []
    for key in range(size):
        if rows and rng.random() < 0.6 and rows[-1][1]:
            text = rng.choice(rows)[1] or "x"
            parts = text.split()
            for _ in range(rng.randint(0, 4)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            rng.shuffle(parts)
            rows.append((key, " ".join(parts).upper() if rng.random() < 0.3 else ", ".join(parts)))
        else:
            rows.append((key, " ".join(rng.choices(words, k=rng.randint(1, 30)))))
    return [*rows, (size, None), (size + 1, ""), (size + 2, "?!"), (size + 3, "é" * 50_000), (size + 4, "é" * 50_000), (size + 5, "long " * 5_000), (size + 6, "long " * 4_000), (size + 7, "long " * 3_999)]


@pytest.mark.parametrize(("leaf", "pivots"), [(20_000, 8), (12, 4), (40, 4)])
def test_pairs(spark, monkeypatch, leaf, pivots):
    monkeypatch.setattr(N.split, "__defaults__", (leaf, pivots))
    rows = corpus(leaf, 250)
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("*", "'x' AS class", "1 AS elements").repartition(3)
    found = [tuple(r) for r in N.near_pairs(df, leaf=leaf).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows)


def test_groups(spark):
    rows = corpus(3, 150)
    found = {r.id: r.group_id for r in N.near_groups(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    parent = {key: key for key, text in rows if text and re.search(r"\w", text)}

    def root(key):
        while parent[key] != key:
            key = parent[key]
        return key

    for a, b in brute(rows):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert found == {key: root(key) for key in parent}


def test_empty(spark):
    assert N.near_pairs(spark.createDataFrame([], "id bigint, text string")).count() == 0
    assert N.near_groups(spark.createDataFrame([(1, None)], "id bigint, text string")).count() == 0


def test_one_class_of_copies(spark):
    df = spark.range(60).selectExpr("id", "'same words here' AS text")
    assert N.near_pairs(df).count() == 60 * 59 // 2
    assert [tuple(r) for r in N.near_groups(df).select("group_id", "links").distinct().collect()] == [(0, 0)]


def test_copies_in_blocks(spark):
    rows = [(k, "one two three four five six seven eight nine ten") for k in range(70)] + [(k, "one two three four five six seven eight nine x") for k in range(70, 100)] + [(100, "one two three four five six seven eight nine ten y")]
    found = [tuple(r) for r in N.near_pairs(spark.createDataFrame(rows, "id bigint, text string"), copies=9).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_splits_of_many_texts(spark, monkeypatch):
    """100,000 texts of a template whose rarest words are few, so that regions are large; every planted pair and no other comes out."""
    from pyspark.sql import functions as F

    words = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("base", k), F.lit(400)).cast("string")))
    df = spark.range(100_000).withColumn("base", F.floor(F.col("id") / 2)).select("id", F.concat_ws(" ", words, F.concat(F.lit("v"), (F.col("id") % 2).cast("string"))).alias("text"))
    seen = []
    deeper = N._deeper
    monkeypatch.setattr(N, "_deeper", lambda *args: seen.append(1) or deeper(*args))
    found = N.near_pairs(df, leaf=1_000)
    assert found.count() == found.where("id_b = id_a + 1 AND id_a % 2 = 0").count() == 50_000 and seen
