"""Ignore files, state as JSON, merged parts and folds that are cut into parts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from contextframe.operators import memory as M
from contextframe.operators import search as S
from contextframe.operators import session as E
from contextframe.operators.matching import contained
from contextframe.sources import files


@pytest.mark.parametrize(
    ("rules", "path", "ignored"),
    [
        ("*.log", "a/b.log", True), ("*.log", "a/b.logs", False), ("/target/", "target/x", True), ("/target/", "a/target/x", False), ("build/", "a/build/x", True), ("build/", "a/build", False),
        ("build", "a/build", True), ("*.md\n!keep.md", "a/keep.md", False), ("docs/\n!docs/keep.md", "docs/keep.md", True), ("docs/*\n!docs/keep.md", "docs/keep.md", False), ("a/**/z", "a/z", True),
        ("a/**/z", "a/b/c/z", True), ("**/tmp", "x/tmp/y", True), ("x[0-9].py", "d/x7.py", True), ("x[!0-9].py", "d/x7.py", False), ("a/*.rs", "a/b/c.rs", False), ("# no\n\n\\#yes", "#yes", True), ("sp ace  ", "sp ace", True),
    ],
)
def test_ignore_rules(spark, rules, path, ignored):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(files.by_rules(F.col("path"), files.ignore_rules(rules))).first()[0] is ignored


def test_scan_unignored(spark, tmp_path):
    for name, text in (("a.rs", "x"), ("b.log", "y"), ("sub/c.rs", "z"), ("sub/d.rs", "w"), (".gitignore", "*.log\n"), ("sub/.gitignore", "d.rs\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.scan_unignored(spark, str(tmp_path), endings=("rs", "log"))
    assert sorted((r.path, r.content) for r in found.collect()) == [("a.rs", "x"), ("sub/c.rs", "z")]


def test_index_gives_what_the_scan_gives(spark):
    rows = [(1, "Alpha beta", "the naïve cache"), (2, None, "cache beta alpha, the lock-file"), (3, "x", None), (4, "lock", "file cache cache"), (5, "", "lock file")]
    df = spark.createDataFrame(rows, "id bigint, title string, text string")
    for query in ("cache", "naive cache", '"lock-file"', "alpha beta", "missing cache"):
        index = S.postings(df, columns=("title", "text"))
        assert S.search_postings(*index, query).collect() == S.search(df, query, columns=("title", "text")).collect()
    assert [r.id for r in S.search(df, "NAÏVE", columns=("title", "text")).collect()] == [1]
    empty = S.postings(df.limit(0), columns=("title", "text"))
    assert S.search_postings(*empty, "cache").count() == 0


def test_parts_do_not_show(spark):
    acts = [(s, r, k, a, v) for k, (s, r, a, v) in enumerate([("g", "a", "write", "1"), ("g", "a", "read", None), ("g", "b", "read", None), ("p", "a", "read", None), ("g", "a", "clear", None), ("g", "a", "read", None), ("g", "b", "write", "2"), ("g", "a", "read", None), ("g", "b", "read", None)] * 5)]
    df = spark.createDataFrame(acts, "slot string, reader string, seq int, action string, value string")
    whole = sorted(map(tuple, E.slots(df).collect()), key=str)
    assert whole == sorted(map(tuple, E.slots(df, part=2).collect()), key=str)
    by_block = df.withColumnRenamed("slot", "block")
    assert sorted(map(tuple, E.blocks(by_block).collect())) == sorted(map(tuple, E.blocks(by_block, part=2).collect()))
    baskets = spark.createDataFrame([(k % 3, k) for k in range(60)], "b int, i int")
    assert sorted(map(tuple, E.pairs(baskets, "b", "i").collect())) == sorted(map(tuple, E.pairs(baskets, "b", "i", most=4).collect()))
    calls = df.select(F.col("slot").alias("session_id"), "seq", F.when(F.col("action") == "clear", "pre_compact").when(F.col("action") == "write", "post_compact").otherwise("smart_read").alias("tool"))
    assert sorted(map(tuple, E.compacted_phases(calls).collect())) == sorted(map(tuple, E.compacted_phases(calls, F.floor(F.col("seq") / 3)).collect()))


def test_blocks_of_needles(spark):
    texts = spark.createDataFrame([("t1", "alpha beta"), ("t2", "gamma"), ("t3", None), ("t4", "")], "path string, content string")
    needles = spark.createDataFrame([("alpha",), ("beta",), ("mm",), ("",), (None,), ("alpha",)], "name string")
    for block in (1, 6, 1_000):
        assert sorted(map(tuple, contained(texts, "path", "content", needles, "name", block).collect())) == [("t1", "alpha"), ("t1", "beta"), ("t2", "mm")]


def test_totals_of_nothing(spark):
    none = spark.createDataFrame([], "path string, content string")
    row = files.totals(files.project_map(none, 3)).first()
    assert (row.files, row.loc, row.symbols, row.dependencies, row.suggested_start) == (0, 0, 0, [], [])


def test_timelines(spark):
    one = spark.createDataFrame([(3, "a"), (1, "b"), (None, "c")], "at int, key string")
    assert [r.key for r in M.merged_timeline([one, one.withColumn("at", F.col("at") + 1)], 3).collect()] == ["b", "a", "a"]
    assert len(M.plan_steps("x")) == 3
