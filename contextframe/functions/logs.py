"""Command output: classification, compression, signatures and summaries, as Column expressions.

Every function works within one row, on the array of its lines, so nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from contextframe.functions.text import let

#: Commands by the kind of their output, by the first word or the first two.
KINDS_BY_TWO = (
    ("test_runner", ("cargo test", "go test", "npm test", "npx vitest", "npx jest")),
    ("compiler", ("cargo build", "go build")),
    ("linter", ("cargo clippy",)),
    ("package_mgr", ("cargo add", "npm install", "pip install", "go get", "yarn add")),
)
KINDS_BY_ONE = (
    ("test_runner", ("pytest", "jest", "phpunit")),
    ("compiler", ("rustc", "tsc", "gcc", "g++", "javac")),
    ("linter", ("eslint", "ruff", "phpstan", "golangci-lint", "pylint")),
    ("formatter", ("rustfmt", "prettier", "black", "gofmt")),
    ("search", ("grep", "rg", "ag", "find", "fd")),
)
#: Package manager lines that are noise, and those that matter.
NOISE = ("Downloading ", "Fetching ", "Unpacking ")
KEPT = ("error", "warning", "Downloaded", "added ", "Compiling", "Finished", "Installing", "Installed", "Removed", "Summary")
MAX_OUTPUT = 102_400


def lines(text: Column) -> Column:
    """The lines of a text: none for an empty one, no empty one behind a final line break, CRLF as LF."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def any_prefix(line: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a line starts with one of the prefixes."""
    return reduce(Column.__or__, [line.startswith(p) for p in prefixes])


def classify(command: Column) -> Column:
    """The kind of a command's output; ``generic`` for all others."""
    words = F.filter(F.split(command, r"\s+"), lambda w: w != "")
    one, two = F.try_element_at(words, F.lit(1)), F.array_join(F.slice(words, 1, 2), " ")
    kind = F.lit("generic")
    for name, first in reversed(KINDS_BY_ONE):
        kind = F.when(one.isin(*first), name).otherwise(kind)
    kind = F.when(F.trim(command).startswith("git "), "git_info").otherwise(kind)
    for name, pair in reversed(KINDS_BY_TWO):
        kind = F.when(two.isin(*pair), name).otherwise(kind)
    return kind


def _join(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def generic(text: Column, most: int) -> Column:
    """The first two thirds of ``most`` lines and the last third, with a note of what lies between."""
    head = most * 2 // 3
    tail = most - head

    def short(all_lines: Column) -> Column:
        note = F.concat(F.lit("... "), (F.size(all_lines) - most).cast("string"), F.lit(" Zeilen ausgelassen ..."))
        cut = _join(F.concat(F.slice(all_lines, 1, head), F.array(note), F.slice(all_lines, F.size(all_lines) - tail + 1, tail)))
        return F.when((F.size(all_lines) <= most) | F.lit(most == 0), text).otherwise(cut)

    return let(lines(text), short)


def _blocks(all_lines: Column, begins) -> Column:  # noqa: ANN001
    """The lines that begin a block, each with the place line behind it if there is one."""
    n = F.size(all_lines)
    taken = F.transform(
        all_lines,
        lambda line, i: F.struct(
            line.alias("line"),
            begins(line).alias("begins"),
            F.when((i + 1 < n) & F.ltrim(F.try_element_at(all_lines, i + 2)).startswith("-->"), F.try_element_at(all_lines, i + 2)).alias("place"),
        ),
    )
    return F.transform(F.filter(taken, lambda b: b["begins"]), lambda b: F.struct(F.concat_ws("\n", b["line"], b["place"]).alias("block"), F.when(b["place"].isNotNull(), 2).otherwise(1).alias("size"), b["line"].alias("line")))


def _budget(blocks: Column, most: int | Column, skip: bool, used: Column | int = 0) -> Column:
    """The blocks that fit the line budget: with ``skip`` smaller ones may follow one that does not fit, else it ends the list."""
    start = F.struct(F.lit(used).cast("int").alias("used") if isinstance(used, int) else used.alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, block: Column) -> Column:
        fits = (state["used"] + block["size"] <= most) & ~state["full"]
        return F.when(fits, F.struct((state["used"] + block["size"]).alias("used"), state["full"].alias("full"), F.concat(state["kept"], F.array(block["block"])).alias("kept"))).otherwise(
            F.struct(state["used"].alias("used"), F.lit(not skip).alias("full"), state["kept"].alias("kept"))
        )

    return F.aggregate(blocks, start, step)


def compiler(text: Column, most: int) -> Column:
    """Errors that fit, then closing lines, then warnings up to the first that does not fit."""
    return let(lines(text), lambda all_lines: _compiler(text, all_lines, most))


def _compiler(text: Column, all_lines: Column, most: int) -> Column:
    closing = lambda x: x.startswith("error: aborting") | x.startswith("error: could not compile")
    errors = _budget(_blocks(all_lines, lambda x: ~closing(x) & (x.startswith("error[") | (x.startswith("error") & x.contains("]:")))), most, True)
    ends = F.filter(all_lines, closing)
    room = F.greatest(F.lit(most) - errors["used"], F.lit(0))
    shown = F.slice(ends, F.lit(1), room)
    warnings = _budget(_blocks(all_lines, lambda x: x.startswith("warning:")), most, False, errors["used"] + F.size(shown))
    return F.when(F.size(all_lines) <= most, text).otherwise(_join(F.concat(errors["kept"], shown, warnings["kept"])))


def linter(text: Column, most: int) -> Column:
    """Errors, warnings and suggestions in this order, up to the first that does not fit."""
    return let(lines(text), lambda all_lines: _linter(text, all_lines, most))


def _linter(text: Column, all_lines: Column, most: int) -> Column:
    kinds = (("error:", "error["), ("warning:",), ("suggestion:", "note:", "help:"))
    blocks = F.concat(*[_blocks(all_lines, lambda x, p=prefixes: any_prefix(x, p)) for prefixes in kinds])
    return F.when(F.size(all_lines) <= most, text).otherwise(_join(_budget(blocks, most, False)["kept"]))


def package_manager(text: Column, most: int) -> Column:
    """Lines without progress; if still too many, those that matter; then the first ``most`` and a note; the end of the output if none is left."""
    return let(lines(text), lambda all_lines: _package_manager(text, all_lines, most))


def _package_manager(text: Column, all_lines: Column, most: int) -> Column:
    noise = lambda x: F.regexp_like(x, F.lit("^(?: {1,4}Downloading | {2,4}Fetching | {2,3}Unpacking |  Locking )"))
    quiet = F.filter(all_lines, lambda x: ~noise(x))
    kept = F.when(F.size(quiet) > most, F.filter(all_lines, lambda x: any_prefix(F.ltrim(x), KEPT))).otherwise(quiet)
    note = F.concat(F.lit("... "), (F.size(kept) - most).cast("string"), F.lit(" more lines"))
    short = F.when(F.size(kept) > most, F.concat(F.slice(kept, 1, most), F.array(note))).otherwise(kept)
    tail = F.slice(all_lines, F.greatest(F.size(all_lines) - most + 1, F.lit(1)), most)
    return F.when(F.size(all_lines) <= most, text).when(F.size(kept) == 0, _join(tail)).otherwise(_join(short))


def formatter(text: Column, most: int) -> Column:
    """The last summary line, then formatted files, ``most`` lines in all; else the first lines."""
    trimmed = F.transform(lines(text), lambda x: F.trim(x))
    done = lambda x: x.startswith("Formatted ") | x.startswith("Reformatted ")
    files = F.filter(trimmed, done)
    closing = F.filter(trimmed, lambda x: ~done(x) & x.contains("file") & (x.contains("formatted") | x.contains("changed")))
    both = F.concat(F.slice(closing, -1, 1), files)
    both = F.when(F.size(closing) > 0, F.concat(F.array(F.try_element_at(closing, F.lit(-1))), files)).otherwise(files)
    return F.when(F.size(trimmed) <= most, text).when(F.size(both) > 0, _join(F.slice(both, 1, most))).otherwise(_join(F.slice(lines(text), 1, most)))


def diff_files(text: Column) -> Column:
    """(path, added, removed, hunks) of each file of a diff."""
    start = F.array().cast("array<struct<path:string,added:int,removed:int,hunks:int>>")

    def step(files: Column, line: Column) -> Column:
        last = F.try_element_at(files, F.lit(-1))
        path = F.regexp_replace(F.try_element_at(F.filter(F.split(line, r"\s+"), lambda w: w != ""), F.lit(-1)), r"^(?:b/)+", "")
        bumped = F.struct(
            last["path"].alias("path"),
            (last["added"] + (line.startswith("+") & ~line.startswith("+++")).cast("int")).alias("added"),
            (last["removed"] + (line.startswith("-") & ~line.startswith("---")).cast("int")).alias("removed"),
            (last["hunks"] + line.startswith("@@").cast("int")).alias("hunks"),
        )
        new = F.struct(path.alias("path"), F.lit(0).alias("added"), F.lit(0).alias("removed"), F.lit(0).alias("hunks"))
        return F.when(line.startswith("diff --git "), F.concat(files, F.array(new))).when(
            (F.size(files) > 0) & F.regexp_like(line, F.lit(r"^[-+@]")), F.concat(F.slice(files, F.lit(1), F.size(files) - 1), F.array(bumped))
        ).otherwise(files)

    return F.aggregate(lines(text), start, step)


def git(text: Column, most: int) -> Column:
    """A diff as one line for each file; other output as its first lines and a note."""
    all_lines = lines(text)
    plural = lambda f: F.when(f["hunks"] == 1, "").otherwise("s")
    files = F.transform(diff_files(text), lambda f: F.format_string("%s: +%d -%d (%d hunk%s)", f["path"], f["added"], f["removed"], f["hunks"], plural(f)))
    note = F.concat(F.lit("... "), (F.size(all_lines) - max(most - 1, 0)).cast("string"), F.lit(" more lines"))
    return (
        F.when(F.size(all_lines) <= most, text)
        .when(text.contains("diff --git"), _join(F.slice(files, 1, most)))
        .otherwise(_join(F.concat(F.slice(all_lines, 1, max(most - 1, 0)), F.array(note))))
    )


def search(text: Column, most: int) -> Column:
    """The first two matches of each file and how many more it has, within the budget; then how many files are left."""
    return let(lines(text), lambda all_lines: _search(text, all_lines, most))


def _search(text: Column, all_lines: Column, most: int) -> Column:
    file_of = lambda x: F.substring_index(x, ":", 1)
    none = F.array().cast("array<string>")

    def of(file: Column) -> Column:
        more = lambda own: F.when(F.size(own) > 2, F.array(F.format_string("  ... and %d more matches in %s", F.size(own) - 2, file))).otherwise(none)
        return let(F.filter(all_lines, lambda x: file_of(x) == file), lambda own: F.concat(F.slice(own, 1, 2), more(own)))

    def noted(files: Column, shown: Column) -> Column:
        # every file takes a line at least, so no more than the first ``most`` files can be shown
        left = F.size(files) - F.size(F.filter(F.slice(files, 1, most), lambda f: F.exists(shown, lambda x: (file_of(x) == f) & F.array_contains(all_lines, x))))
        return _join(F.concat(shown, F.when(left > 0, F.array(F.format_string("... %d more files with matches", left))).otherwise(none)))

    short = let(F.array_distinct(F.transform(all_lines, file_of)), lambda files: let(F.slice(F.flatten(F.transform(F.slice(files, 1, most), of)), 1, most), lambda shown: noted(files, shown)))
    return F.when(F.size(all_lines) <= most, text).otherwise(short)


def failure_blocks(all_lines: Column) -> Column:
    """(name, message) of each failed test of a test log; the message is its first three lines that are not blank."""
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<name:string,parts:array<string>>>").alias("blocks"))

    def step(state: Column, line: Column) -> Column:
        blocks, last = state["blocks"], F.try_element_at(state["blocks"], F.lit(-1))
        begins = line.startswith("---- ") & line.endswith(" stdout ----")
        name = F.regexp_replace(F.regexp_replace(line, "^(?:---- )+", ""), "(?: stdout ----)+$", "")
        new = F.struct(name.alias("name"), F.array().cast("array<string>").alias("parts"))
        ends = line.startswith("---- ") | line.startswith("failures:")
        adds = state["open"] & (F.trim(line) != "") & (F.size(last["parts"]) < 3)
        longer = F.struct(last["name"].alias("name"), F.concat(last["parts"], F.array(F.trim(line))).alias("parts"))
        return (
            F.when(begins, F.struct(F.lit(True).alias("open"), F.concat(blocks, F.array(new)).alias("blocks")))
            .when(ends, F.struct(F.lit(False).alias("open"), blocks.alias("blocks")))
            .when(adds, F.struct(F.lit(True).alias("open"), F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(longer)).alias("blocks")))
            .otherwise(state)
        )

    found = F.aggregate(all_lines, start, step)["blocks"]
    return F.transform(found, lambda b: F.struct(b["name"].alias("name"), F.array_join(b["parts"], " | ").alias("message")))


def test_output(text: Column, most: int) -> Column:
    """The result line and the failures of a test run of either kind; other output as :func:`generic`."""
    return let(lines(text), lambda all_lines: _test_output(text, all_lines, most))


def _test_output(text: Column, all_lines: Column, most: int) -> Column:
    result = F.try_element_at(F.filter(all_lines, lambda x: x.startswith("test result:")), F.lit(1))
    heading = F.array(F.lit(""), F.lit("Failures:"))
    room = max(most - 1 - 3, 1)

    def shown(first: Column, entries: Column) -> Column:
        return _join(F.concat(F.array(first), F.when(F.size(entries) > 0, F.concat(heading, F.slice(entries, 1, room))).otherwise(F.array().cast("array<string>"))))

    blocks = F.transform(failure_blocks(all_lines), lambda b: F.format_string("  %s — %s", b["name"], b["message"]))
    session = F.try_element_at(F.filter(all_lines, lambda x: x.startswith("=") & (x.contains("passed") | x.contains("failed"))), F.lit(1))
    failed = F.transform(F.filter(all_lines, lambda x: x.startswith("FAILED ")), lambda x: F.trim(F.regexp_replace(x, "^(?:FAILED )+", "")))
    entries = F.transform(failed, lambda x: F.when((F.instr(x, " - ") > 0) & ~x.endswith(" - "), F.concat(F.lit("  "), F.regexp_replace(x, "^(.*?) - ", "$1 — "))).otherwise(F.concat(F.lit("  "), F.regexp_replace(x, " - $", ""))))
    title = F.trim(F.regexp_replace(session, "^=+|=+$", ""))
    return (
        F.when(F.size(all_lines) <= most, text)
        .when(result.isNotNull(), shown(result, blocks))
        .when(text.contains("test session starts") & session.isNotNull(), shown(title, entries))
        .otherwise(generic(text, most))
    )


def compress(command: Column, text: Column, most: int) -> Column:
    """A command's output by the compressor of its kind."""
    kind = classify(command)
    by_kind = (("test_runner", test_output), ("compiler", compiler), ("linter", linter), ("git_info", git), ("package_mgr", package_manager), ("formatter", formatter), ("search", search))
    shown = generic(text, most)
    for name, how in by_kind:
        shown = F.when(kind == name, how(text, most)).otherwise(shown)
    return shown


def error_signature(text: Column) -> Column:
    """Sixteen hex digits of the error lines, with times made equal; empty where there are none."""
    wrong = F.filter(lines(text), lambda x: F.lower(F.trim(x)).startswith("error") | F.lower(x).contains("panic") | (F.lower(x).contains("failed") & ~F.lower(x).contains("0 failed")))
    bare = F.regexp_replace(F.array_join(wrong, "\n"), r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[Z\w]*", "<TS>")
    return F.when(F.size(wrong) == 0, "").otherwise(F.substring(F.sha2(bare, 256), 1, 16))


def summary_line(kind: Column, compressed: Column, raw: Column) -> Column:
    """The line that sums up a run: the first error, the result of a test run, else the first line with anything in it."""
    first = lambda text, rule: F.try_element_at(F.filter(lines(text), rule), F.lit(1))
    error = first(raw, lambda x: x.startswith("error[") | x.startswith("error:"))
    issue = first(raw, lambda x: any_prefix(x, ("error[", "error:", "warning:")))
    result = first(raw, lambda x: x.startswith("test result:"))
    passed = F.trim(F.regexp_replace(first(raw, lambda x: x.startswith("=") & x.contains("passed")), "^=+|=+$", ""))
    rest = F.coalesce(first(compressed, lambda x: F.trim(x) != ""), F.lit("(no output)"))
    special = F.when(kind == "compiler", error).when(kind == "test_runner", F.coalesce(result, passed)).when(kind == "linter", issue)
    return F.coalesce(special, rest)


def bounded(text: Column) -> Column:
    """The first MAX_OUTPUT bytes of a text, cut between characters."""
    over, octets = F.octet_length(text) > MAX_OUTPUT, text.cast("binary")
    # the four bytes up to the one behind the limit end in as many bytes within a character as have to go
    inner = F.regexp_extract(F.hex(F.substring(octets, MAX_OUTPUT - 2, 4)), "^(?:..)*?((?:[89AB].)*)$", 1)
    kept = F.substring(octets, F.lit(1), MAX_OUTPUT - (F.length(inner) / 2).cast("int")).cast("string")
    return F.when(over, kept).otherwise(text)


def line_ratio(raw: Column, compressed: Column) -> Column:
    """Share of lines saved, rounded to four places; 0 for no lines."""
    return F.when(F.coalesce(raw, F.lit(0)) == 0, 0.0).otherwise(F.round(1 - compressed / raw, 4))


def test_errors(text: Column) -> Column:
    """The lines of a log that speak of errors."""
    return F.filter(lines(text), lambda x: F.regexp_like(F.lower(x), F.lit("error|failed|panic")))


def file_hints(text: Column) -> Column:
    """The distinct paths of source files that the lines name, one a line at most, in order."""

    def hint(line: Column) -> Column:
        words = F.transform(F.split(line, r"\s+"), lambda w: F.regexp_replace(w, "^[:,()]+|[:,()]+$", ""))
        return F.try_element_at(F.filter(words, lambda w: F.regexp_like(w, F.lit(r"/.*\.(?:rs|py|ts|js|php)$|^.*/.*\.(?:rs|py|ts|js|php)$"))), F.lit(1))

    return F.array_distinct(F.array_compact(F.transform(lines(text), hint)))


def triage(line: Column) -> Column:
    """Whether a line of project context is about architecture, a rule, or noise."""
    low = F.lower(line)
    return F.when(F.regexp_like(low, F.lit("architecture|runtime|database")), "architecture").when(F.regexp_like(low, F.lit("must|never|rule")), "rule").otherwise("noise")
