"""Coverage, test selection, semantic differences, confidence, health and configuration scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextframe.operators.matching import contained

#: A bound that no factor reaches.
_FAR = 1_000_000_000
#: Points a finding costs by its severity, the weights of scores, and the advice for each factor.
DEDUCTIONS = {"critical": 3.0, "warning": 1.0, "suggestion": 0.5}
CATEGORIES = {"SEC": "security", "QUL": "quality", "EFF": "efficiency"}
CONFIDENCE = {"test_coverage": 0.30, "caller_impact": 0.20, "type_safety": 0.20, "git_stability": 0.15, "semantic_risk": 0.15}
HEALTH = {"test_coverage": 0.25, "stability": 0.20, "error_rate": 0.20, "complexity": 0.20, "documentation": 0.15}
SUGGESTIONS = {
    "test_coverage": "Add or update tests to cover the modified symbol.",
    "caller_impact": "Review all callers to ensure compatibility with the change.",
    "type_safety": "Consider using a language server for precise type analysis.",
    "git_stability": "This file changes frequently — consider refactoring to reduce churn.",
    "semantic_risk": "Public API or unsafe change — ensure backward compatibility.",
}


def is_test_file(path: Column, content: Column, lang: Column) -> Column:
    """Whether a file holds tests, by its place, its name or its content."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    place = F.regexp_like(path, F.lit(r"(?:^|/)tests?/"))
    return (
        place
        | ((lang == "rust") & (content.contains("#[test]") | content.contains("#[cfg(test)]")))
        | ((lang == "python") & (name.startswith("test_") | name.endswith("_test.py")))
        | (lang.isin("typescript", "javascript") & (name.contains(".test.") | name.contains(".spec.") | path.contains("__tests__/")))
        | ((lang == "java") & (name.endswith("Test.java") | name.endswith("Spec.java")))
    )


def tested(functions: DataFrame, tests: DataFrame) -> DataFrame:
    """(path, name, line_no, test_files): each function with the number of test files that hold its name."""
    hits = contained(tests, "path", "content", functions, "name").groupBy(F.col("needle").alias("name")).agg(F.count_distinct("key").alias("test_files"))
    return functions.join(hits, "name", "left").withColumn("test_files", F.coalesce("test_files", F.lit(0)))


def coverage(functions: DataFrame) -> DataFrame:
    """Functions, tested ones and percent by file and in all, of :func:`tested` functions; the least covered first."""
    percent = F.when(F.col("functions") == 0, 0.0).otherwise(F.round(100 * F.col("tested") / F.col("functions"), 1))
    per = functions.groupBy("path").agg(F.count("*").alias("functions"), F.count_if(F.col("test_files") > 0).alias("tested"))
    return per.withColumn("percent", percent).orderBy("percent", "path")


def selected_tests(tests: DataFrame, module: str, symbols: list[str]) -> DataFrame:
    """(path, reason): tests whose content names the edited module or one of the edited symbols."""
    content = F.col("content")
    reasons = [F.when(content.contains(module), f"references module '{module}'")] if module else []
    reasons += [F.when(content.contains(symbol), f"references symbol '{symbol}'") for symbol in symbols]
    return tests.select("path", F.concat_ws(", ", *reasons).alias("reason")).where("reason <> ''")


def test_command(selected: DataFrame) -> DataFrame:
    """One row with the command that runs the selected Rust tests, or all of them if none is selected."""
    stem = F.regexp_extract("path", r"([^/]*)\.rs$", 1)
    names = F.array_sort(F.collect_set(F.when(stem != "", F.concat(F.lit("--test "), stem))))
    return selected.agg(F.concat_ws(" ", F.lit("cargo test"), names).alias("command"))


def project_tests(files: DataFrame) -> DataFrame:
    """(runner, command, test_files) of a project: one row, by the manifests in its root; Cargo if none tells.

    Test files are those directly in ``tests`` with an ending of the runners.
    """
    has = lambda *names: F.coalesce(F.bool_or(F.col("path").isin(*names)), F.lit(False))
    runner = F.when(has("Cargo.toml"), "cargo").when(has("package.json"), "npm").when(has("pytest.ini", "setup.py"), "pytest").otherwise("cargo")
    count = F.count_if(F.regexp_like("path", F.lit(r"^tests/[^/]*(?:\.rs|\.py|\.test\.ts|\.test\.js)$")))
    command = F.when(F.col("runner") == "npm", "npm test").when(F.col("runner") == "pytest", "pytest").otherwise("cargo test")
    return files.agg(runner.alias("runner"), count.alias("test_files")).select("runner", command.alias("command"), "test_files")


def selective_command(selected: DataFrame, runner: str) -> DataFrame:
    """One row with the command that runs the selected tests with the project's runner: what it runs is one text."""
    if runner == "cargo":
        return test_command(selected)
    names = F.array_sort(F.collect_set("path"))
    return selected.agg(F.concat_ws(" ", F.lit("npx jest" if runner == "npm" else "pytest"), names).alias("command"))


def semantic_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, name, before, after, breaking): symbols removed, added and changed between two versions, by name and kind.

    One full outer join tells the three apart; a change of visibility comes beside one of
    the signature.
    """
    both = old.alias("o").join(new.alias("n"), ["name", "kind"], "full_outer")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    row = lambda change, before, after, breaking: F.struct(F.lit(change).alias("change"), before.cast("string").alias("before"), after.cast("string").alias("after"), breaking.alias("breaking"))
    none = F.lit(None)
    kept = o("signature").isNotNull() & n("signature").isNotNull()
    narrowed = (o("visibility") == "public") & n("visibility").isin("private", "protected")
    changes = F.array_compact(
        F.array(
            F.when(n("signature").isNull(), row("symbol_removed", o("signature"), none, F.lit(True))),
            F.when(o("signature").isNull(), row("symbol_added", none, n("signature"), F.lit(False))),
            F.when(kept & (o("signature") != n("signature")), row("signature_changed", o("signature"), n("signature"), F.lit(True))),
            F.when(kept & ~o("visibility").eqNullSafe(n("visibility")), row("visibility_changed", o("visibility"), n("visibility"), F.coalesce(narrowed, F.lit(False)))),
            F.when(kept & (o("signature") == n("signature")) & (o("size") != n("size")), row("body_changed", F.concat(o("size").cast("string"), F.lit(" lines")), F.concat(n("size").cast("string"), F.lit(" lines")), F.lit(False))),
        )
    )
    return both.select("name", F.explode(changes).alias("c")).select("name", "c.*")


def _steps(value: Column, steps: tuple[tuple[int, int], ...], rest: int) -> Column:
    score = F.lit(rest)
    for most, points in reversed(steps):
        score = F.when(value <= most, points).otherwise(score)
    return score


def confidence(edits: DataFrame) -> DataFrame:
    """``edits`` with factor scores, the weighted score, a verdict, the weakest factor and what to do about it.

    Reads test_file_exists, symbol_in_test, callers, trust, git_changes (-1: unknown),
    is_public, signature_changed, has_unsafe and error_widened.
    """
    trust = F.lit(20)
    for name, points in (("exact", 100), ("structural", 80), ("heuristic", 50), ("degraded", 30)):
        trust = F.when(F.col("trust") == name, points).otherwise(trust)
    flag = lambda name, points: F.when(F.col(name), points).otherwise(0)
    factors = {
        "test_coverage": F.when(F.col("test_file_exists") & F.col("symbol_in_test"), 100).when(F.col("test_file_exists"), 50).otherwise(0),
        "caller_impact": _steps(F.col("callers"), ((0, 100), (1, 90), (3, 70), (10, 50)), 20),
        "type_safety": trust,
        "git_stability": F.when(F.col("git_changes") == -1, 60).otherwise(_steps(F.col("git_changes"), ((0, 100), (2, 80), (5, 60), (10, 40)), 20)),
        "semantic_risk": F.greatest(F.lit(0), 100 - flag("is_public", 20) - flag("signature_changed", 30) - flag("has_unsafe", 20) - flag("error_widened", 20)),
    }
    scored = edits.select("*", *[score.alias(name) for name, score in factors.items()])
    total = F.lit(0.0)
    for name, weight in CONFIDENCE.items():
        total = total + F.col(name) * weight
    least = F.least(*factors)
    weakest, advice = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(CONFIDENCE):
        weakest = F.when(F.col(name) == least, name).otherwise(weakest)
        advice = F.when(F.col(name) == least, SUGGESTIONS[name]).otherwise(advice)
    score = F.round(F.round(total, 6)).cast("int")
    return scored.select("*", score.alias("score"), F.when(score >= 80, "safe").when(score >= 60, "review").otherwise("risky").alias("verdict"), weakest.alias("weakest"), advice.alias("suggestion"))


def health(factors: dict[str, Column]) -> Column:
    """The health of a file from its five factors."""
    total = F.lit(0.0)
    for name, weight in HEALTH.items():
        total = total + factors[name] * weight
    return F.round(F.round(total, 6)).cast("int")


def after_read(loc: Column, symbols: Column, documented: Column) -> list[Column]:
    """Complexity and documentation as a read shows them."""
    doc = F.when(documented, F.when(symbols > 0, 80).otherwise(60)).otherwise(F.when(symbols > 5, 20).otherwise(40))
    return [_steps(loc, ((50, 100), (100, 85), (200, 70), (500, 50)), 30).alias("complexity"), doc.alias("documentation")]


def folded_health(log: DataFrame, part: int = 1_000) -> DataFrame:
    """(file, stability, test_coverage, error_rate): factors after all edits and test runs of a file, in order, from 50 each.

    Edits cost 5 of stability down to 10. A test that passes adds 10 and 5 up to 100, one that
    fails takes 15 of the error rate down to 0. Each event moves a factor and keeps it within
    bounds, and such moves, one after another, are again one move with bounds. So parts of a
    file's log are folded apart, and no task holds a whole log.
    """
    edit, good, bad = (F.col("event") == kind for kind in ("edit", "passed", "failed"))
    moves = {
        "stability": F.when(edit, F.struct(F.lit(-5).alias("by"), F.lit(10).alias("low"), F.lit(_FAR).alias("high"))),
        "test_coverage": F.when(good, F.struct(F.lit(10).alias("by"), F.lit(-_FAR).alias("low"), F.lit(100).alias("high"))),
        "error_rate": F.when(good, F.struct(F.lit(5).alias("by"), F.lit(-_FAR).alias("low"), F.lit(100).alias("high"))).when(bad, F.struct(F.lit(-15).alias("by"), F.lit(0).alias("low"), F.lit(_FAR).alias("high"))),
    }

    def composed(moved: Column) -> Column:
        still = F.struct(F.lit(0).alias("by"), F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high"))
        clamp = lambda x, m: F.least(F.greatest(x + m["by"], m["low"]), m["high"])
        return F.aggregate(moved, still, lambda s, m: F.struct((s["by"] + m["by"]).alias("by"), clamp(s["low"], m).alias("low"), clamp(s["high"], m).alias("high")))

    def fold(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        lists = rows.groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col(n).isNotNull(), F.struct(F.col(order).alias("o"), F.col(n).alias("m"))))).alias(n) for n in moves])
        return lists.select(*keys, *[composed(F.transform(n, lambda x: x["m"])).alias(n) for n in moves])

    rows = log.select("file", "seq", F.floor(F.col("seq") / part).alias("part"), *[move.alias(n) for n, move in moves.items()])
    parts = fold(rows, ["file", "part"], "seq")
    whole = fold(parts, ["file"], "part")
    return whole.select("file", *[F.least(F.greatest(50 + F.col(f"{n}.by"), F.col(f"{n}.low")), F.col(f"{n}.high")).alias(n) for n in moves])


def unhealthiest(scores: DataFrame, k: int) -> DataFrame:
    """The k files with the lowest score."""
    return scores.orderBy("health", "file").limit(k)


def precision(rows: DataFrame) -> DataFrame:
    """(total, correct, precision) of rows with a flag ``correct``; 0 for none."""
    right = F.count_if("correct")
    return rows.agg(F.count("*").alias("total"), right.alias("right"), F.when(F.count("*") == 0, 0.0).otherwise(F.round(right / F.count("*"), 6)).alias("precision"))


def config_findings(files: DataFrame) -> DataFrame:
    """(path, code, severity) of configuration files: permissions, instructions and settings."""
    c, name = F.col("content"), F.regexp_extract("path", r"([^/]*)$", 1)
    allow = F.coalesce(F.from_json(F.get_json_object(c, "$.permissions.allow"), "array<string>"), F.array().cast("array<string>"))
    settings, notes, tool = name == "settings.json", F.upper(name).endswith(".MD"), name.endswith(".toml")
    found = lambda code, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    many = lambda condition, code: F.transform(F.filter(allow, condition), lambda _: found(code, "critical"))
    n_lines = F.size(F.split(F.regexp_replace(c, "\n$", ""), "\n"))
    single = F.array_compact(
        F.array(
            F.when(settings & F.try_parse_json(c).isNull(), found("SEC-002", "critical")),
            F.when(notes & (n_lines > 200), found("QUL-001", "warning")),
            F.when(notes & ~(F.lower(c).contains("build") | c.contains("cargo") | c.contains("npm") | c.contains("make")), found("QUL-002", "suggestion")),
            F.when(tool & c.contains("scan_secrets = false"), found("SEC-003", "warning")),
            F.when(tool & ~c.contains("languages"), found("QUL-003", "warning")),
            F.when(tool & ~c.contains("[compression]"), found("EFF-001", "suggestion")),
            F.when(tool & ~c.contains("skeleton_threshold_loc"), found("EFF-002", "suggestion")),
        )
    )
    entries = F.when(settings & F.try_parse_json(c).isNotNull(), F.concat(many(lambda e: e.isin("Bash(*)", "Bash"), "SEC-001"), many(lambda e: e.contains(".env"), "SEC-002"))).otherwise(F.slice(single, 1, 0))
    return files.select("path", F.explode(F.concat(single, entries)).alias("f")).select("path", "f.*")


def config_score(findings: DataFrame) -> DataFrame:
    """(security, quality, efficiency, score, grade): ten points for each category less what its findings cost."""
    cost = F.lit(0.0)
    for severity, points in DEDUCTIONS.items():
        cost = F.when(F.col("severity") == severity, points).otherwise(cost)
    sums = [F.floor(F.greatest(F.lit(0.0), 10 - F.coalesce(F.sum(F.when(F.col("code").startswith(prefix), cost)), F.lit(0.0)))).cast("int").alias(name) for prefix, name in CATEGORIES.items()]
    score = F.floor((F.col("security") + F.col("quality") + F.col("efficiency")) * 100 / 30).cast("int")
    grade = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    return findings.agg(*sums).select("*", score.alias("score"), grade.alias("grade"))


def prefetch(opened: DataFrame, files: DataFrame, read: DataFrame, most: int = 3) -> DataFrame:
    """(path, next): up to three files to read next: the test of each opened file, then its siblings, without those read already."""
    from pyspark.sql import Window

    stem, folder = F.regexp_extract("path", r"([^/]*?)\.[^./]*$", 1), F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    here = opened.select("path", stem.alias("stem"), folder.alias("folder"))
    unread = files.join(read.select("path"), "path", "left_anti")
    known = unread.select(F.col("path").alias("next"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), folder.alias("folder"))
    tests = here.select("path", F.explode(F.array(*[F.concat(F.lit(a), F.col("stem"), F.lit(b)) for a, b in (("test_", ".py"), ("", "_test.rs"), ("test_", ".rs"), ("", ".test.ts"))])).alias("file"))
    by_name = tests.join(known.select("next", "file"), "file").select("path", "next", F.lit(0).alias("rank"))
    # of a folder, no file needs more siblings than it shows and itself
    first = known.withColumn("k", F.row_number().over(Window.partitionBy("folder").orderBy("next"))).where(F.col("k") <= most + 1).drop("k")
    beside = here.join(first, "folder").where("path <> next").select("path", "next", F.lit(1).alias("rank"))
    wanted = by_name.unionByName(beside).groupBy("path", "next").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("path").orderBy("rank", "next")
    return wanted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("path", "next", "k")
