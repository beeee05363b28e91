"""Symbols, imports, calls and tests of source files, and questions about them.

``files`` has path and content. Everything is heuristic: lines are matched, not parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextframe.functions.logs import lines
from contextframe.functions.text import estimate_tokens_marks

#: Patterns of lines that define a symbol, and the symbol's kind.
SYMBOLS = (
    (r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", "function"),
    (r"^(?:pub\s+)?struct\s+(\w+)", "struct"),
    (r"^(?:pub\s+)?enum\s+(\w+)", "enum"),
    (r"^(?:pub\s+)?trait\s+(\w+)", "trait"),
    (r"^def\s+(\w+)", "function"),
    (r"^class\s+(\w+)", "class"),
    (r"^(?:export\s+)?function\s+(\w+)", "function"),
    (r"^(?:export\s+)?class\s+(\w+)", "class"),
    (r"^(?:export\s+)?interface\s+(\w+)", "interface"),
)
#: Languages by extension, in the three forms that different callers expect.
READ_LANGUAGES = {"rust": "rs", "python": "py", "typescript": "ts tsx", "javascript": "js jsx", "go": "go", "php": "php", "swift": "swift", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp hh hxx"}
INDEX_LANGUAGES = {"Rust": "rs", "TypeScript": "ts tsx", "JavaScript": "js jsx", "Python": "py", "Php": "php", "Go": "go", "Swift": "swift", "Java": "java"}
MAP_LANGUAGES = {
    "rust": "rs", "python": "py", "javascript": "js mjs cjs jsx", "typescript": "ts mts cts tsx", "go": "go", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp", "ruby": "rb", "php": "php", "swift": "swift",
    "kotlin": "kt kts", "toml": "toml", "json": "json", "yaml": "yaml yml", "markdown": "md", "shell": "sh bash",
}
INTELLIGENT = ("rust", "python", "typescript", "javascript", "go", "php", "swift", "java", "c", "cpp")


def language(path: Column, languages: dict[str, str], otherwise: str | None = None, *, fold: bool = False) -> Column:
    """The language of a path by its extension."""
    end = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    end = F.lower(end) if fold else end
    found = F.lit(otherwise)
    for name, ends in languages.items():
        found = F.when(end.isin(*ends.split()), name).otherwise(found)
    return found


def intelligence(lang: Column, has_server: Column) -> Column:
    """How well a language is understood: by a server, by a syntax tree, or by patterns."""
    return F.when(has_server, "server").when(lang.isin(*INTELLIGENT), "tree").otherwise("pattern")


def numbered(files: DataFrame) -> DataFrame:
    """(path, line_no, line): the lines of all files, counted from 1."""
    return files.select("path", F.posexplode(lines(F.col("content"))).alias("_n", "line")).select("path", (F.col("_n") + 1).alias("line_no"), "line")


def _first_symbol(line: Column) -> Column:
    found = F.lit(None).cast("struct<name:string,kind:string>")
    for pattern, kind in reversed(SYMBOLS):
        name = F.regexp_extract(line, pattern, 1)
        found = F.when(name != "", F.struct(name.alias("name"), F.lit(kind).alias("kind"))).otherwise(found)
    return found


def symbols(files: DataFrame) -> DataFrame:
    """(path, line_no, name, kind): definitions at line starts; of neighbours with one name the first."""
    found = numbered(files).withColumn("s", _first_symbol(F.col("line"))).where("s IS NOT NULL")
    order = Window.partitionBy("path").orderBy("line_no")
    return found.withColumn("before", F.lag("s.name").over(order)).where("before IS NULL OR before <> s.name").select("path", "line_no", "s.name", "s.kind")


def visibility(lang: Column, signature: Column, name: Column) -> Column:
    """Whether a symbol is public, by its language's rule."""
    return (
        F.when(lang == "rust", F.when(signature.startswith("pub"), "public").otherwise("private"))
        .when(lang == "python", F.when(name.startswith("_"), "private").otherwise("public"))
        .when(lang.isin("typescript", "javascript"), F.when(signature.startswith("export"), "public").otherwise("private"))
        .when(lang == "go", F.when(F.regexp_like(name, F.lit("^[A-Z]")), "public").otherwise("private"))
        .when(F.regexp_like(signature, F.lit(r"\bprivate\b")), "private")
        .when(F.regexp_like(signature, F.lit(r"\bprotected\b")), "protected")
        .when(lang != "c", "public")
    )


def imports(files: DataFrame) -> DataFrame:
    """(path, import): use and mod lines without the closing semicolon."""
    line = F.trim("line")
    return numbered(files).where(F.regexp_like(line, F.lit("^(?:use |pub use |mod )"))).select("path", "line_no", F.regexp_replace(line, ";+$", "").alias("import"))


def test_lines(files: DataFrame) -> DataFrame:
    """(path, test): lines that define a test function."""
    return numbered(files).where(F.trim("line").startswith("fn test_")).select("path", "line_no", F.trim("line").alias("test"))


def calls(files: DataFrame) -> DataFrame:
    """(path, line_no, from_symbol, to_symbol): names followed by a bracket, under the function that the line stands in.

    The function is carried forward over the lines of its file; lines before the first
    one stand in ``<module>``. A name is reported where the line holds it before a bracket
    anywhere, even as the end of a longer name.
    """
    rows = numbered(files).withColumn("line", F.trim("line"))
    own = F.when(F.regexp_like("line", F.lit("^(?:pub )?fn ")), F.trim(F.regexp_extract("line", r"^(?:pub )?fn ([^(]*)", 1)))
    rows = rows.withColumn("from_symbol", F.coalesce(F.last(own, True).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)), F.lit("<module>")))
    tokens = F.filter(F.split("line", r"[^\p{L}\p{N}_]"), lambda t: (F.octet_length(t) > 2))
    rows = rows.where(F.col("line").contains("(")).select("path", "line_no", "line", "from_symbol", F.explode(tokens).alias("to_symbol"))
    return rows.where(F.col("line").contains(F.concat("to_symbol", F.lit("("))) & (F.col("to_symbol") != F.col("from_symbol"))).drop("line")


def find(found: DataFrame, column: str, query: str, *, fold: bool = True) -> DataFrame:
    """Rows whose column contains the query, in any case with ``fold``."""
    value = F.lower(F.col(column)) if fold else F.col(column)
    return found.where(value.contains(query.lower() if fold else query))


def impact(changed: str, found: DataFrame, used: DataFrame, tests: DataFrame) -> DataFrame:
    """(changed_path, symbols, imports, tests, risk_score) of a changed file: three filtered counts, one row each."""
    own = F.col("path") == changed
    counts = found.where(own).agg(F.count("*").alias("symbols")).crossJoin(used.where(own).agg(F.count("*").alias("imports"))).crossJoin(tests.where(own).agg(F.count("*").alias("tests")))
    return counts.select(F.lit(changed).alias("changed_path"), "symbols", "imports", "tests", (3 * F.col("symbols") + 2 * F.col("imports") + F.col("tests")).alias("risk_score"))


def build_index(files: DataFrame, most: int = 500, ending: str = ".rs") -> dict[str, DataFrame]:
    """The parts of an index over the first ``most`` files by path with an ending: symbols, imports, calls and tests.

    The number of candidates is what an index is limited to; ``sources/config.py: write_index``
    keeps the parts, so that questions need not build them again.
    """
    chosen = files.where(F.col("path").endswith(ending)).orderBy("path").limit(most)
    return {"symbols": symbols(chosen), "imports": imports(chosen), "calls": calls(chosen), "tests": test_lines(chosen)}


def index_counts(found: DataFrame, used: DataFrame, made: DataFrame, tests: DataFrame) -> DataFrame:
    """(symbols, imports, calls, tests): how many rows each part of an index has; one row each, so the joins are of single rows."""
    parts = [part.agg(F.count("*").alias(name)) for name, part in (("symbols", found), ("imports", used), ("calls", made), ("tests", tests))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(parts[3])


def tier(symbols_n: Column, calls_n: Column, impact_n: Column) -> Column:
    """The model tier for a task of this complexity."""
    score = 2 * symbols_n + 2 * calls_n + impact_n
    return F.when(score < 20, "Cheap").when(score < 80, "Balanced").otherwise("Premium")


def budget(limits: dict[str, int], used: dict[str, Column]) -> list[Column]:
    """What remains of each limit, whether all hold, and whether the tokens are nearly spent."""
    left = {name: F.lit(limit) - used[name] for name, limit in limits.items()}
    ok = F.lit(True)
    for column in left.values():
        ok = ok & (column >= 0)
    return [*(column.alias(f"{name}_left") for name, column in left.items()), ok.alias("ok"), (left["context_tokens"] < 5_000).alias("nearly_spent")]


def context_items(found: DataFrame, used: DataFrame, made: DataFrame, tests: DataFrame, goal: str, most: int = 12) -> DataFrame:
    """(section, pos, content, tokens): the first symbols that match the goal, and the first imports, calls and tests."""

    def first(rows: DataFrame, section: int, content: Column) -> DataFrame:
        text = content.alias("content")
        top = rows.select("path", "line_no", text).orderBy("path", "line_no", "content").limit(most)
        return top.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy("path", "line_no", "content")).alias("pos"), "content")

    parts = [
        first(find(found, "name", goal), 1, F.format_string("Symbol: %s %s in %s:%d", "kind", "name", "path", "line_no")),
        first(used, 2, F.format_string("Import: %s -> %s", "path", "import")),
        first(made, 3, F.format_string("Call: %s -> %s in %s", "from_symbol", "to_symbol", "path")),
        first(tests, 4, F.format_string("Test: %s references %s", "path", "test")),
    ]
    items = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return items.withColumn("tokens", estimate_tokens_marks(F.col("content")))


#: Files and tokens of a package that is made of summaries, and what stands in one without anything.
SUMMARY_FILES, SUMMARY_TOKENS = 8, 30_000
STUB = "No context was found for this goal."


def task_context(found: DataFrame, used: DataFrame, made: DataFrame, tests: DataFrame, files: DataFrame, goal: str, word: str, most: int = 12) -> DataFrame:
    """(level, section, pos, content, tokens) of a goal's package: the items of the index, else summaries of the best files, else a stub.

    Files are ranked by the goal's words in their paths; summaries end with the one that
    reaches the tokens. Paths must be unique.
    """
    first = context_items(found, used, made, tests, word, most).select(F.lit(1).alias("level"), "section", "pos", "content", "tokens")
    ranked = rank_paths(files.select("path", F.lit(0).alias("pos")), goal).orderBy(F.desc("score"), "path").limit(SUMMARY_FILES)
    texts = files.join(F.broadcast(ranked), "path").select(F.lit(0).alias("one"), "path", "score", summary(F.col("path"), F.col("content")).alias("content"))
    placed = texts.withColumn("pos", F.row_number().over(Window.partitionBy("one").orderBy(F.desc("score"), "path"))).withColumn("tokens", estimate_tokens_marks(F.col("content")))
    second = within_tokens(placed, SUMMARY_TOKENS, ["one"], ["pos"]).select(F.lit(2).alias("level"), F.lit(5).alias("section"), "pos", "content", "tokens")
    third = files.sparkSession.range(1).select(F.lit(3).alias("level"), F.lit(6).alias("section"), F.lit(1).alias("pos"), F.lit(STUB).alias("content")).withColumn("tokens", estimate_tokens_marks(F.col("content")))
    items = first.unionByName(second).unionByName(third)
    best = items.agg(F.min("level").alias("level"))
    return items.join(F.broadcast(best), "level")


def within_tokens(items: DataFrame, most: int, keys: list[str], order: list[str]) -> DataFrame:
    """The items of each key before the tokens run out; the one that crosses the limit stays."""
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.withColumn("_before", before).where(F.col("_before") < most).drop("_before")


def rank_paths(paths: DataFrame, goal: str) -> DataFrame:
    """(path, pos, score, reason): paths by how many of the goal's words of over two letters they hold, equal ones in order."""
    terms = F.array(*[F.lit(term) for term in goal.lower().split() if len(term) > 2])
    score = F.size(F.filter(terms, lambda term: F.lower(F.col("path")).contains(term)))
    return paths.select("path", "pos", score.alias("score"), F.when(score > 0, "Matched goal keywords").otherwise("Fallback candidate").alias("reason")).orderBy(F.desc("score"), "pos")


def summary(path: Column, content: Column) -> Column:
    """The summary of a file: its size and its first twelve lines."""
    all_lines = lines(content)
    head = F.format_string("%s: %d chars, %d lines\n%s", path, F.length(content), F.size(all_lines), F.array_join(F.slice(all_lines, 1, 12), "\n"))
    return F.when(F.length(content) == 0, F.concat(path, F.lit(" is empty."))).otherwise(head)


def grep(files: DataFrame, query: str, most: int = 8) -> DataFrame:
    """(path, line_no, line, symbol): the first lines with the query, by path and line, with the name they define if any."""
    hint = F.regexp_extract(F.trim("line"), r"^(?:fn|struct|enum|class|interface|trait) (\w+)", 1)
    found = numbered(files).where(F.col("line").contains(query))
    return found.select("path", "line_no", "line", F.when(hint != "", hint).alias("symbol")).orderBy("path", "line_no").limit(most)


def focused(files: DataFrame, query: str, around: int = 5) -> DataFrame:
    """(path, line_no, line): the lines with the query and those around them, each once."""
    near = Window.partitionBy("path").orderBy("line_no").rowsBetween(-around, around)
    return numbered(files).withColumn("hit", F.max(F.col("line").contains(query)).over(near)).where("hit").drop("hit")


def read_mode(loc: Column, has_focus: Column) -> Column:
    """How a file is read: in part if asked for, whole if short, else as a skeleton."""
    return F.when(has_focus, "focused").when(loc < 100, "full").otherwise("skeleton")


def skeleton(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, skeleton): the defining lines of each file with their numbers."""
    rows = numbered(files).join(found.select("path", "line_no"), ["path", "line_no"], "left_semi")
    shown = F.struct("line_no", F.concat(F.lpad(F.col("line_no").cast("string"), 4, " "), F.lit("| "), "line").alias("text"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["text"]), "\n").alias("skeleton"))


def in_string_or_comment(line: Column, before: Column) -> Column:
    """Whether a match behind ``before`` lies in a comment line or within quotes, by the number of open quotes."""
    comment = F.regexp_like(F.ltrim(line), F.lit(r"^(?://|#|--|;;|%|/\*|\*)"))
    odd = F.lit(False)
    for quote in ("'", '"', "`"):
        odd = odd | (F.pmod(F.regexp_count(before, F.lit(rf"(?<!\\){quote}")), F.lit(2)) == 1)
    return comment | odd


def renames(files: DataFrame, old: str, new: str) -> DataFrame:
    """(path, line_no, before, after): lines where a name stands outside strings and comments, with all of it replaced."""
    word = rf"\b{old}\b"
    rows = numbered(files).where(F.regexp_like("line", F.lit(word)))
    pieces = F.split("line", word)
    outside = F.exists(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: ~in_string_or_comment(F.col("line"), F.array_join(F.slice(pieces, F.lit(1), i), old)))
    return rows.where(outside).select("path", "line_no", F.col("line").alias("before"), F.regexp_replace("line", word, new).alias("after"))
