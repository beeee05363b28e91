"""Deny lists, policy findings, governance events, path checks, tools and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of paths that may not be read or edited, and of commands that may not run.
READ = (r"(?i)^\.env$", r"(?i)^\.env\.", r"(?i)(^|/)secrets/", r"(?i)(^|/)credentials\.", r"(?i)\.pem$", r"(?i)\.key$", r"(?i)(^|/)node_modules/", r"(?i)(^|/)target/")
EDIT = (r"(?i)\.wasm$", r"(?i)\.so$", r"(?i)\.dylib$", r"(?i)\.exe$", r"(?i)\.dll$", r"(?i)\.generated\.", r"(?i)(^|/)Cargo\.lock$", r"(?i)(^|/)package-lock\.json$", r"(?i)(^|/)yarn\.lock$")
COMMAND = (r"rm\s+-[a-zA-Z]*r[a-zA-Z]*f[a-zA-Z]*\s+[/.]", r"rm\s+-[a-zA-Z]*f[a-zA-Z]*r[a-zA-Z]*\s+[/.]", r"curl\s+.*\|\s*(sh|bash|zsh|fish|dash)", r"wget\s+.*\|\s*(sh|bash|zsh|fish|dash)", r"(?:^|\s)sudo\s")
#: What a policy denies unless told otherwise.
DENIED_COMMANDS, DENIED_PATHS = ("rm -rf /", "shutdown"), ("/etc",)
#: Words of a result that speak of weaker settings.
WEAKER = ("disabled", '"false"', "'false'", "= false", ": false", '"off"', "'off'", "removed", "deleted rule", "allow(")
CORE_TOOLS = ("smart_read", "smart_run", "token_stats", "code_search")
#: What to do about an error, and the errors worth another try.
RECOVERY = {
    "E_AMBIGUOUS_MATCH": "Try strategy=lines or strategy=symbol instead of strategy=text",
    "E_STALE_READ": "File changed since last read. Call smart_read again.",
    "E_HASH_MISMATCH": "Concurrent edit detected. Re-read the file first.",
    "E_LSP_TIMEOUT": "LSP is slow. tree-sitter fallback will be used.",
    "E_PARSE_FAILED": "tree-sitter parse failed. Regex fallback active.",
}
RECOVERY_OTHERWISE = "Check the error code and retry with adjusted parameters."
RETRY = ("E_STALE_READ", "E_HASH_MISMATCH", "E_LSP_TIMEOUT")


def _any(value: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.regexp_like(value, F.lit(p)) for p in patterns])


def file_name(path: Column) -> Column:
    """The part of a path behind the last slash."""
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def read_denied(path: Column) -> Column:
    """Whether a path, or its file name, may not be read."""
    return _any(path, READ) | _any(file_name(path), READ)


def edit_denied(path: Column) -> Column:
    """Whether a path, or its file name, may not be edited."""
    return _any(path, EDIT) | _any(file_name(path), EDIT)


def command_denied(command: Column) -> Column:
    """Whether a command may not run."""
    return _any(command, COMMAND)


def findings(rows: DataFrame, key: str, commands: tuple[str, ...] = DENIED_COMMANDS, paths: tuple[str, ...] = DENIED_PATHS) -> DataFrame:
    """(key, code, message): one row for each entry of the deny lists that a row's command holds or its path begins with."""
    found = [F.when(F.col("command").contains(c), F.struct(F.lit("SEC-CMD-001").alias("code"), F.lit(f"Denied command pattern detected: {c}").alias("message"))) for c in commands]
    found += [F.when(F.col("path").startswith(p), F.struct(F.lit("SEC-PATH-001").alias("code"), F.lit(f"Denied path access: {p}").alias("message"))) for p in paths]
    return rows.select(key, F.explode(F.array_compact(F.array(*found))).alias("f")).select(key, "f.*")


def governance(tool: Column, path: Column, result: Column) -> Column:
    """The kind of event that a tool's result is for governance, the first that fits, or null."""
    low, said = F.lower(path), F.lower(result)
    edit = (tool == "smart_edit") & path.isNotNull()
    config = F.regexp_like(low, F.lit(r"\.(?:toml|json|ya?ml)$|eslint|prettier|\.clippy"))
    weaker = reduce(Column.__or__, [said.contains(word) for word in WEAKER])
    return (
        F.when((tool == "smart_refactor") & result.contains("renamed"), "symbol_rename")
        .when(edit & F.regexp_like(low, F.lit(r"auth|security|\.env|secret")), "security_edit")
        .when(edit & F.regexp_like(low, F.lit("test|spec")) & said.contains("removed"), "test_removed")
        .when(edit & config & weaker, "config_weakened")
    )


def normalised(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty parts; parts above the root are dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def within(path: Column, root: str) -> Column:
    """Whether a path lies within the root and in no hidden version control folder but its ``HEAD``."""
    clean = normalised(path)
    inside = (clean == root) | clean.startswith(root.rstrip("/") + "/")
    hidden = F.regexp_like(clean, F.lit(r"(?:^|/)\.(?:git|svn|hg)(?:/|$)")) & ~clean.endswith("/.git/HEAD")
    return inside & ~hidden


def tools(requested: Column, policy: Column) -> list[Column]:
    """Tools that a policy enables, and the others: the core ones, the first eight, or all."""
    enabled = F.when(policy == "minimal", F.filter(requested, lambda t: t.isin(*CORE_TOOLS))).when(policy == "focus", F.slice(requested, 1, 8)).otherwise(requested)
    return [enabled.alias("enabled"), F.filter(requested, lambda t: ~F.array_contains(enabled, t)).alias("disabled")]


def rules_for(rules: DataFrame, module: str) -> DataFrame:
    """The rules of a module and those of all modules."""
    return rules.where(F.col("module").isin(module, "*"))


def route(task: Column, capabilities: list[tuple[str, str]]) -> Column:
    """The first server, in order, one of whose capabilities the task names."""
    server = F.lit(None).cast("string")
    for name, capability in reversed(capabilities):
        server = F.when(F.lower(task).contains(capability.lower()), name).otherwise(server)
    return server


def recovery(error: Column) -> list[Column]:
    """What to do about an error, and whether to try again."""
    hint = F.lit(RECOVERY_OTHERWISE)
    for code, text in RECOVERY.items():
        hint = F.when(error == code, text).otherwise(hint)
    return [hint.alias("hint"), F.coalesce(error.isin(*RETRY), F.lit(False)).alias("retry")]


def oversized_answer(answer: Column, limit: int = 5_000) -> Column:
    """A warning for an answer of more bytes than the limit, else null."""
    size = F.octet_length(answer)
    return F.when(size > limit, F.format_string("answer of %d bytes", size))


def browser(snapshot: DataFrame) -> DataFrame:
    """(url, console_errors, failed_requests, lines, forms, buttons) of browser snapshots."""
    return snapshot.select(
        "url",
        F.size(F.filter("console", lambda m: F.lower(m) == "error")).alias("console_errors"),
        F.size(F.filter("network", lambda s: s >= 400)).alias("failed_requests"),
        F.size(F.split(F.regexp_replace("html", "\n$", ""), "\n")).alias("lines"),
        F.regexp_count(F.lower("html"), F.lit("<form")).alias("forms"),
        F.regexp_count(F.lower("html"), F.lit("<button")).alias("buttons"),
    )


def workspace(repositories: DataFrame) -> DataFrame:
    """One row with the number of repositories and their names in order."""
    return repositories.agg(F.count("*").alias("repositories"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def cross_repository(repositories: DataFrame, query: str) -> DataFrame:
    """(name, hit): the front page of each repository whose name contains the query."""
    return repositories.where(F.lower("name").contains(query.lower())).select("name", F.concat("path", F.lit("/README.md")).alias("hit"))
