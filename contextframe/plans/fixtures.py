"""Small literal tables for operators whose input the test tables do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_sql, value)) + "]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


class Fixture:
    """A literal table for both engines."""

    def __init__(self, schema: str, rows: list[tuple]) -> None:
        self.schema, self.rows = schema, rows
        self.names = [part.split()[0] for part in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        """The table as a DataFrame."""
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        """The table as a SQL subquery, without an alias."""
        rows = ", ".join("(" + ", ".join(map(_sql, row)) + ")" for row in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) AS v({', '.join(self.names)}))"


_TEST_LOG = "\n".join(
    ["running 12 tests", *[f"test unit::case_{k} ... ok" for k in range(9)], "", "failures:", "", "---- unit::adds stdout ----", "thread panicked at src/lib.rs:9", "", "left: 3", "right: 4", "note: run with backtrace", "---- unit::splits stdout ----", "assertion failed", "failures:", "    unit::adds", "", "test result: FAILED. 10 passed; 2 failed; 0 ignored"]
)
_PYTEST_LOG = "\n".join(["===== test session starts =====", "collected 9 items", *[f"tests/test_{k}.py ." for k in range(9)], "FAILED tests/test_a.py::test_x - assert 1 == 2", "FAILED tests/test_b.py::test_y", "===== 2 failed, 7 passed in 0.12s ====="])
_COMPILE_LOG = "\n".join(["   Compiling app v0.1.0", "error[E0308]: mismatched types", "  --> src/main.rs:4:5", "   |", "error[E0425]: cannot find value", "  --> src/lib.rs:10:1", "warning: unused variable", "  --> src/main.rs:2:9", "warning: unused import", "error: aborting due to 2 previous errors", "error: could not compile `app`", "", "For more information", "try rustc --explain"])
_LINT_LOG = "\n".join(["help: consider this", "warning: needless return", "  --> src/a.rs:3:5", "note: on by default", "error: this loop never ends", "  --> src/b.rs:7:1", "warning: large enum", "error[E1]: bad", "suggestion: use x", "plain", "plain", "plain"])
_PACKAGES = "\n".join(["   Downloading crates ...", " Downloading a v1", "  Fetching index", "  Downloaded a v1", "  Downloaded b v2", "   Compiling a v1", "   Compiling b v2", "warning: unused manifest key", "note: something", "other line", "   Finished dev in 3s", "  Locking 4 packages", "  Summary: 2 packages"])
_FORMAT = "\n".join(["Reformatted src/a.py", "checked src/b.py", "Formatted src/c.py", "some note", "2 files reformatted, 1 file left unchanged", "All done!", "Reformatted src/d.py", "end"])
_SEARCH = "\n".join(["src/a.rs:1:fn main() {", "src/a.rs:5:let x = 1;", "src/a.rs:9:let y = 2;", "src/b.rs:2:use a;", "src/c.rs:4:mod b;", "src/a.rs:30:}", "src/d.rs:1:x", "src/e.rs:1:y", "src/f.rs:2:z"])

LOGS = Fixture(
    "id int, command string, raw string",
    [
        (1, "cargo test --all", _TEST_LOG),
        (2, "pytest -q", _PYTEST_LOG),
        (3, "cargo build", _COMPILE_LOG),
        (4, "cargo clippy", _LINT_LOG),
        (5, "npm install", _PACKAGES),
        (6, "black .", _FORMAT),
        (7, "rg let src", _SEARCH),
        (8, "git log", "\n".join(f"commit {k}" for k in range(15))),
        (9, "ls -la", "\n".join(f"file {k}" for k in range(20))),
        (10, "git diff", "\n".join(["diff --git a/src/a.rs b/src/a.rs", "--- a/src/a.rs", "+++ b/src/a.rs", "@@ -1 +1 @@", "-old", "+new", "+more", "@@ -9 +9 @@", "+x", "diff --git a/b.py b/b.py", "@@ -1 +0 @@", "-gone"])),
        (11, "make", ""),
        (12, "  go   build ./...", "ok"),
    ],
)
