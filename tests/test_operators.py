"""Operators on small fixtures with known results, and on empty and odd input."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contextframe.functions import edits as X
from contextframe.functions import logs as L
from contextframe.functions import text as T
from contextframe.operators import cluster as C
from contextframe.operators import codegraph as G
from contextframe.operators import matching, memory, policy, quality, running, search, session, tokens
from contextframe.plans.fixtures import LOGS
from contextframe.sources import config, files, git
from contextframe.streaming import events as E


def one(spark, column, **values):
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, F.lit(value))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "tokens_n"), [("", 0), ("a", 2), ("abcde", 2), ("a b c d e f", 8), ("x" * 2048, 512), ("hello world from somewhere", 7)])
def test_token_estimate(spark, text, tokens_n):
    assert one(spark, T.estimate_tokens(F.col("t")), t=text) == tokens_n
    assert one(spark, T.tokens_over(F.col("t"), 512), t=text) == (tokens_n > 512)


def test_tokens_over_counts_words(spark):
    assert one(spark, T.tokens_over(F.col("t"), 512), t="a " * 385) is True
    assert one(spark, T.tokens_over(F.col("t"), 512), t="a " * 384) is False


def test_savings_ratio(spark):
    ratio = tokens.savings_ratio(F.col("r"), F.col("c"))
    assert one(spark, ratio, r=100, c=125) == -0.25
    assert one(spark, ratio, r=0, c=5) == 0.0
    empty = spark.createDataFrame([], "tool string, category string, estimated_raw_tokens bigint, estimated_compressed_tokens bigint")
    assert tuple(tokens.summary(empty).first()) == (0, 0, 0, 0, 0.0)


def test_health_and_coverage(spark):
    factors = dict(zip(quality.HEALTH, map(F.lit, (80, 60, 40, 70, 50)), strict=True))
    assert spark.range(1).select(quality.health(factors).alias("h")).first().h == 62
    functions = spark.createDataFrame([("src/lib.rs", "add", 1), ("src/lib.rs", "multiply", 5)], "path string, name string, line_no int")
    tests = spark.createDataFrame([("tests/t.rs", "add(1, 2)")], "path string, content string")
    row = quality.coverage(quality.tested(functions, tests)).first()
    assert (row.functions, row.tested, row.percent) == (2, 1, 50.0)


def test_health_fold(spark):
    log = spark.createDataFrame([("f", k, e) for k, e in enumerate(["edit"] * 9 + ["passed", "failed", "failed", "failed", "failed", "passed"])], "file string, seq int, event string")
    assert tuple(quality.folded_health(log).first()) == ("f", 10, 70, 5)


def test_config_score(spark):
    rows = [("x/settings.json", json.dumps({"permissions": {"allow": ["Bash", "Read(.env)"]}})), ("N.md", "x\n" * 201)]
    found = quality.config_findings(spark.createDataFrame(rows, "path string, content string"))
    assert sorted(r.code for r in found.collect()) == ["QUL-001", "QUL-002", "SEC-001", "SEC-002"]
    assert tuple(quality.config_score(found).first()) == (4, 8, 10, 73, "C")


def test_clusters_follow_the_greedy_loop(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("pq"), f"2025-01-{rng.randint(1, 28):02d}", ",".join(rng.sample("abcdefgh", rng.randint(0, 4))), ",".join(rng.sample("uvwxyz", rng.randint(0, 3)))) for k in range(120)]
    df = spark.createDataFrame(rows, "id bigint, project string, created_at string, files string, concepts string")
    got = {r.id: (r.leader, r.cluster) for r in C.clusters(df).collect()}

    def greedy(items):
        found, leaders = {}, []
        for key, values in items:
            values = set(filter(None, values.split(",")))
            near = next((lead for lead, own in leaders if values and len(own & values) * 10 > 3 * len(own | values)), None)
            found[key] = near if near is not None else key
            if values and near is None:
                leaders.append((key, values))
        return found

    expected = {}
    for project in "pq":
        own = sorted((r for r in rows if r[1] == project), key=lambda r: (r[2], r[0]))
        by_files = greedy([(r[0], r[3]) for r in own])
        for lead in set(by_files.values()):
            members = [r for r in own if by_files[r[0]] == lead]
            for key, sub in greedy([(r[0], r[4]) for r in members]).items():
                expected[key] = (lead, sub)
    assert got == expected


def test_duplicates_and_summaries(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "p", "2025-01-01", "f", "c", base + "."), (2, "p", "2025-01-02", "f", "c", base + " more."), (3, "p", "2025-01-03", "f", "c", "Something else entirely is written here! And a second sentence follows. Short one."), (4, "p", "2025-01-04", "f", "c", base + " more.")]
    df = spark.createDataFrame(rows, "id bigint, project string, created_at string, files string, concepts string, text string")
    clustered = C.cut_lineage(C.clusters(df))
    dropped = C.duplicates(df, clustered)
    assert sorted(r.id for r in dropped.collect()) == [1, 2]
    text = C.summaries(df, clustered).first().summary
    assert text.count(" | ") == 2
    assert tuple(C.counters(clustered, dropped).first()) == (1, 1, 2)
    assert C.clusters(df.limit(0)).count() == 0


def test_search_terms():
    assert search.terms_of('title:alpha "b-c"') == [["titlealpha"], ["b", "c"]]
    with pytest.raises(ValueError):
        search.terms_of(' : "" ')


def test_timeline(spark):
    df = spark.createDataFrame([(k, "p" if k % 2 else "q") for k in range(1, 11)], "id bigint, project string")
    assert [r.id for r in memory.timeline(df, 6, 3, 3).collect()] == [3, 4, 5, 6, 7, 8, 9]
    assert [r.id for r in memory.timeline(df, 6, 0, 0).collect()] == [6]
    assert [r.id for r in memory.timeline(df, 6, 1, 1, "p").collect()] == [3, 5, 7]
    with pytest.raises(LookupError):
        memory.timeline(df, 99)
    with pytest.raises(ValueError):
        memory.check_date("01.02.2025")


def test_compressors(spark):
    logs = {r.id: r for r in LOGS.df(spark).select("id", L.compress(F.col("command"), F.col("raw"), 6).alias("short"), L.summary_line(L.classify(F.col("command")), F.col("raw"), F.col("raw")).alias("line"), L.error_signature(F.col("raw")).alias("sign")).collect()}
    assert logs[1].short.startswith("test result: FAILED") and "unit::adds — thread panicked at src/lib.rs:9 | left: 3 | right: 4" in logs[1].short
    assert logs[2].short.split("\n")[0] == "2 failed, 7 passed in 0.12s" and "tests/test_a.py::test_x — assert 1 == 2" in logs[2].short
    assert logs[3].short.split("\n") == ["error[E0308]: mismatched types", "  --> src/main.rs:4:5", "error[E0425]: cannot find value", "  --> src/lib.rs:10:1", "error: aborting due to 2 previous errors", "error: could not compile `app`"]
    assert logs[10].short == "src/a.rs: +3 -1 (2 hunks)\nb.py: +0 -1 (1 hunk)"
    assert logs[3].line == "error[E0308]: mismatched types" and logs[11].line == "(no output)"
    assert logs[11].short == "" and logs[12].sign == ""


def test_signature_ignores_times(spark):
    a, b = "2025-01-01T10:00:00Z error: x", "2026-02-02T11:11:11Z error: x"
    signs = [one(spark, L.error_signature(F.col("t")), t=t) for t in (a, "ERROR at 2025-01-01T10:00:00Z", "ERROR at 2026-02-02T11:11:11Z", b)]
    assert signs[1] == signs[2] != "" and signs[0] == ""


def test_bounded_output(spark):
    assert len(one(spark, L.bounded(F.repeat(F.lit("é"), 60_000)), t=1).encode()) == 102_400
    assert one(spark, L.bounded(F.col("t")), t="short") == "short"


def test_bounded_output_ends_between_characters(spark):
    """The limit may lie anywhere in a character, and a replacement character of the text itself stays."""
    texts = ["a" * shift + char * (L.MAX_OUTPUT // len(char.encode()) + 2) for char in "aé€😀�" for shift in range(4)]
    texts += ["a" * (L.MAX_OUTPUT - 3) + "�" + "b", "é" * (L.MAX_OUTPUT // 2), None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", L.bounded(F.col("t")).alias("short"))
    for k, short in df.collect():
        assert short == (texts[k] and texts[k].encode()[: L.MAX_OUTPUT].decode(errors="ignore")), k


def test_rename_keeps_strings_and_comments(spark):
    source = "main()\n# main\nprint('main')\nx = main + 'main'\nmaintain()\n"
    rows = G.renames(spark.createDataFrame([("a.py", source)], "path string, content string"), "main", "start").collect()
    assert [(r.line_no, r.after) for r in rows] == [(1, "start()"), (4, "x = start + 'start'")]


def test_contained_in_blocks(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "k int, t string")
    needles = spark.createDataFrame([("alp",), ("beta",), ("x",), ("",), (None,)], "n string")
    for block in (1, 2, 100):
        assert sorted(tuple(r) for r in matching.contained(texts, "k", "t", needles, "n", block).collect()) == [(1, "alp"), (1, "beta")]
    assert matching.contained(texts, "k", "t", needles.limit(0), "n").count() == 0


def test_edits(spark):
    assert one(spark, X.truncate_at_word(F.col("t"), 8), t="one two three") == "one two…"
    assert one(spark, X.truncate_at_word(F.col("t"), 5), t="abcdefgh") == "abcde…"
    assert one(spark, X.replace_once(F.col("t"), F.lit("a"), F.lit("b")), t="aa") is None


def test_paths(spark):
    assert one(spark, policy.normalised(F.col("t")), t="/a/./b//../c") == "/a/c"
    assert one(spark, policy.within(F.col("t"), "/w"), t="/w/../etc/passwd") is False


def test_blame_gives_every_line_its_author(spark):
    text = "abcdef1 1 1 1\nauthor A\nauthor-time 1700000000\n\tx\n1234567 2 2 1\nauthor B\nauthor-time 0\n\ty\nabcdef1 3 3\n\tz\n"
    rows = git.blame(spark.createDataFrame([(1, text)], "id int, text string"), "id").orderBy("line_no").collect()
    assert [(r.author, r.date, r.content) for r in rows] == [("A", "2023-11-14", "x"), ("B", "1970-01-01", "y"), ("A", "2023-11-14", "z")]


def test_files_and_settings(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src" / "a.rs").write_text("fn main() {}\n")
    (tmp_path / "src" / "b.rs").write_bytes(b"\x00\x01")
    (tmp_path / "target" / "c.rs").write_text("x")
    (tmp_path / "src" / "big.rs").write_text("x" * 200_000)
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.scan(spark, str(tmp_path), endings=("rs",)).collect()}
    assert sorted(rows) == ["a.rs", "b.rs"] and rows["b.rs"].binary and rows["a.rs"].content == "fn main() {}\n"
    (tmp_path / "x.toml").write_text("[a]\nloop_threshold = 7\n[b.c]\ndecay_rate = 0.5\nother = 1\n")
    assert config.settings(str(tmp_path / "x.toml")) == config.Settings(loop_threshold=7, decay_rate=0.5)
    assert config.settings(str(tmp_path / "none.toml")) == config.Settings()
    states = spark.createDataFrame([("p", 1, "a"), ("p", 3, "b"), ("q", 2, "c")], "project string, saved_at int, state string")
    config.append_json(states, str(tmp_path / "states"))
    assert config.latest_state(spark, str(tmp_path / "states"), "p").first().state == "b"


def test_patterns(spark):
    baskets = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "a"), (3, "c")], "s int, f string")
    found = session.pairs(baskets, "s", "f").collect()
    assert [tuple(r) for r in found] == [("a", "b", 2)]
    assert one(spark, session.confidence(F.col("n")), n=3) == 0.5
    assert one(spark, session.confidence(F.col("n")), n=30) == 1.0


def test_stream_writes_snapshots(spark, data, tmp_path):
    query = E.append_snapshots(E.metrics(E.read(spark, f"{data}/token_events.parquet")), str(tmp_path / "out"), str(tmp_path / "ck"), 1)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    total = spark.read.json(str(tmp_path / "out")).groupBy("tool").agg(F.max("calls").alias("n")).agg(F.sum("n")).first()[0]
    assert total == spark.read.parquet(f"{data}/token_events.parquet").count()


@pytest.mark.parametrize("part", [1, 4, 1000])
def test_health_fold_in_parts(spark, part):
    rng = random.Random(part)
    rows = [(f, k, rng.choice(["edit", "passed", "failed", "other"])) for f in "ab" for k in range(60)]
    got = {r.file: (r.stability, r.test_coverage, r.error_rate) for r in quality.folded_health(spark.createDataFrame(rows, "file string, seq int, event string"), part).collect()}
    for file in "ab":
        stability = tests = errors = 50
        for _, _, event in sorted(r for r in rows if r[0] == file):
            stability = max(stability - 5, 10) if event == "edit" else stability
            tests = min(tests + 10, 100) if event == "passed" else tests
            errors = min(errors + 5, 100) if event == "passed" else max(errors - 15, 0) if event == "failed" else errors
        assert got[file] == (stability, tests, errors)


def test_running_values_across_buckets(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), k, rng.randint(0, 9), rng.choice([None, "x", "y"])) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, k int, v int, w string")
    sums = {(r.g, r.k): r.total for r in running.running_sums(df, "g", F.floor(F.col("k") / 7), ["k"], {"total": F.col("v")}).collect()}
    last = {(r.g, r.k): r.seen for r in running.carried(df, "g", F.floor(F.col("k") / 7), ["k"], F.col("w"), "seen").collect()}
    for g in "ab":
        total, seen = 0, None
        for _, k, v, w in (r for r in rows if r[0] == g):
            total, seen = total + v, w or seen
            assert (sums[(g, k)], last[(g, k)]) == (total, seen)
    assert [r.no for r in running.numbered(df, ["k"], "no").orderBy("k").collect()] == list(range(1, 201))


def test_large_baskets_are_joined(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.randint(0, 5), f"f{rng.randint(0, 12)}") for _ in range(120)] + [(9, None)], "s int, f string")
    assert sorted(map(tuple, session.pairs(df, "s", "f", 3).collect())) == sorted(map(tuple, session.pairs(df, "s", "f").collect()))


def test_log_queries_read_all_runs(spark, data):
    from contextframe.plans import logs

    runs = logs._runs(spark, data).count()
    for name in ("compress_test", "compress_compiler", "compress_linter", "compress_packages", "compress_formatter", "compress_dispatch", "run_summary_line"):
        assert logs.QUERIES[name](spark, data).count() == runs, name


def _calls(spark, path, seed, files=5, rows=60):
    """Random calls in several files, with a session that has most of them, nulls, and a batch for each file."""
    rng = random.Random(seed)
    calls = [[(rng.choice(["s", "s", "s", "t", None]), rng.choice(["read", "edit", None]), rng.choice([".env", "a.py", None]), rng.choice([0, 10, None])) for _ in range(rows)] for _ in range(files)]
    for part in calls:
        spark.createDataFrame(part, "session_id string, tool string, subject string, estimated_raw_tokens long").withColumn("created_at", F.lit("2025-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    return [call for part in calls for call in part], E.read(spark, path, files_per_trigger=1)


def test_stream_tells_loops_once_without_python(spark, tmp_path):
    calls, stream = _calls(spark, str(tmp_path / "events"), 4)
    loops = E.error_loops(stream.withColumnRenamed("tool", "signature"), 7)
    assert "Python" not in (plan := loops._jdf.queryExecution().analyzed().toString()) and "TransformWithState" not in plan
    told = E.drained(loops, str(tmp_path / "run"), "update", "true").collect()
    counts = Counter((call[0], call[1]) for call in calls)
    assert Counter(map(tuple, told)) == Counter((*key, 7) for key, n in counts.items() if n >= 7)


def test_stream_of_calls_tells_each_governance_row_without_python(spark, tmp_path):
    calls, stream = _calls(spark, str(tmp_path / "events"), 5)
    told = E.post_call(stream, 30, 400, 20)
    assert "Python" not in (plan := told._jdf.queryExecution().analyzed().toString()) and "TransformWithState" not in plan
    got = E.drained(told, str(tmp_path / "run"), "update", "kind <> 'governance'").collect()
    calls = [call for call in calls if call[0]]
    wanted = Counter((session, "governance", subject) for session, _, subject, _ in calls if subject == ".env")
    wanted.update((key, "hint", "calls") for key in "st" if sum(call[0] == key for call in calls) > 30)
    wanted.update((key, "hint", "tokens") for key in "st" if sum(call[3] or 0 for call in calls if call[0] == key) > 400)
    wanted.update((*key, tool) for (key, tool), n in Counter(((session, "loop"), tool) for session, tool, _, _ in calls if tool).items() if n >= 20)
    assert Counter(map(tuple, got)) == wanted and max(wanted.values()) > 1
