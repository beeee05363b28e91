"""File trees as tables of paths and contents."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contextframe.functions.logs import lines
from contextframe.operators import codegraph as G

#: Folders that hold no sources, endings of binary files, and bytes of the largest file read.
IGNORED = (".git", ".hg", ".svn", "target", "node_modules", "dist", "build", "vendor", "__pycache__", ".venv", ".idea", ".vscode")
BINARY = ("png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "gz", "tar", "exe", "dll", "so", "dylib", "wasm", "woff", "woff2", "ttf", "mp3", "mp4", "class", "jar", "o", "a", "bin")
SOURCE = ("rs", "py", "ts", "tsx", "js", "jsx", "go", "java", "c", "h", "cpp", "hpp", "cc", "php", "swift", "rb", "kt", "cs")
MOST_BYTES = 102_400


def ignored(path: Column) -> Column:
    """Whether a path runs through a folder without sources or has a binary ending."""
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED))) | end.isin(*BINARY)


def scan(spark: SparkSession, root: str, *, endings: tuple[str, ...] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, bytes, binary, hash, content) of all files under a folder, without ignored and larger ones.

    Size and name are checked before contents are read. A file with a zero byte among its
    first 8,192 counts as binary and has no content.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if endings:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(endings) + "}")
    found = reader.load(root).where((F.col("length") <= most_bytes) & ~ignored(F.col("path")))
    raw = F.col("content")
    binary = F.instr(F.hex(F.substring(raw, 1, 8_192)), "00") > 0
    zero = F.regexp_like(F.hex(F.substring(raw, 1, 8_192)), F.lit("^(?:..)*00"))
    prefix = F.regexp_replace("path", "^file:/*", "/")
    return found.select(prefix.alias("path"), F.col("length").alias("bytes"), (binary & zero).alias("binary"), F.sha2(raw, 256).alias("hash"), F.when(~(binary & zero), F.decode(raw, "utf-8")).alias("content"))


def ignore_rules(text: str, folder: str = "") -> list[tuple[str, bool, bool]]:
    """(pattern, only folders, ignored) of the lines of an ignore file that lies in ``folder``, in order.

    A pattern without an inner slash holds at any depth; ``*`` and ``?`` stop at slashes,
    ``**`` does not; ``!`` takes back; a slash at the end means folders only.
    """
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        ignored = not line.startswith("!")
        line = line[not ignored :].removeprefix("\\")
        only_folders = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body, k = "", 0
        line = line.removeprefix("/")
        while k < len(line):
            if line.startswith("**/", k) and (k == 0 or line[k - 1] == "/"):
                body, k = body + "(?:.*/)?", k + 3
            elif line.startswith("**", k):
                body, k = body + ".*", k + 2
            elif line[k] == "*":
                body, k = body + "[^/]*", k + 1
            elif line[k] == "?":
                body, k = body + "[^/]", k + 1
            elif line[k] == "[" and (end := line.find("]", k + 2)) > 0:
                inner = line[k + 1 : end].replace("\\", "\\\\")
                body, k = body + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            elif line[k] == "\\" and k + 1 < len(line):
                body, k = body + re.escape(line[k + 1]), k + 2
            else:
                body, k = body + re.escape(line[k]), k + 1
        at = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
        rules.append((f"^{at}{'' if anchored else '(?:.*/)?'}{body}$", only_folders, ignored))
    return rules


def by_rules(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """Whether a path, relative to where the rules begin, is ignored: it or a folder above it, by the last rule that fits each."""

    def state(name: Column, folder: Column) -> Column:
        found = F.lit(False)
        for pattern, only_folders, ignored in rules:
            fits = F.regexp_like(name, F.lit(pattern))
            found = F.when(fits & folder if only_folders else fits, ignored).otherwise(found)
        return found

    parts = F.split(path, "/")
    return F.exists(F.sequence(F.lit(1), F.size(parts)), lambda k: state(F.array_join(F.slice(parts, F.lit(1), k), "/"), k < F.size(parts)))


def scan_unignored(spark: SparkSession, root: str, **how) -> DataFrame:  # noqa: ANN003
    """:func:`scan` without what the ignore files below ``root`` name; those of deeper folders come later and so win.

    The ignore files, small text files, are read on the driver; paths come relative to ``root``.
    """
    base = Path(root.removeprefix("file:")).resolve()
    rules: list[tuple[str, bool, bool]] = []
    for file in sorted(base.rglob(".gitignore"), key=lambda f: len(f.parts)):
        rules += ignore_rules(file.read_text(encoding="utf-8", errors="replace"), file.parent.relative_to(base).as_posix().removeprefix("."))
    found = scan(spark, root, **how).withColumn("path", F.regexp_replace("path", "^" + re.escape(base.as_posix()) + "/", ""))
    return found.where(~by_rules(F.col("path"), rules)) if rules else found


#: What the names of manifests say about a project's dependencies.
MANIFESTS = {"cargo.toml": "cargo", "package.json": "npm", "go.mod": "go", "requirements.txt": "pip", "pyproject.toml": "pip", "gemfile": "bundler"}


def totals(mapped: DataFrame, most: int = 3) -> DataFrame:
    """(files, loc, symbols, dependencies, suggested_start) of a :func:`project_map`: one row.

    The kinds of dependencies come once each, by the place of their first manifest; to
    start with, the longest files are suggested.
    """
    kind = F.lit(None).cast("string")
    for name, value in MANIFESTS.items():
        kind = F.when(F.lower(F.regexp_extract("path", r"([^/]*)$", 1)) == name, value).otherwise(kind)
    place = F.struct((-F.col("loc")).alias("loc"), "path")
    kinds = mapped.select(kind.alias("kind"), place.alias("place")).where("kind IS NOT NULL").groupBy("kind").agg(F.min("place").alias("place"))
    listed = kinds.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"]).alias("dependencies"))
    first = mapped.select(place.alias("place")).orderBy("place").limit(most).agg(F.transform(F.array_sort(F.collect_list("place")), lambda x: x["path"]).alias("suggested_start"))
    sums = mapped.agg(F.count("*").alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"), F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"))
    return sums.crossJoin(listed).crossJoin(first)


def discover(files: DataFrame, goal: str, most: int = 500) -> DataFrame:
    """(path, pos, score, reason): the first files in order of their paths, ranked by a goal; the cap comes before the rank."""
    first = files.select("path").orderBy("path").limit(most)
    from pyspark.sql import Window

    return G.rank_paths(first.withColumn("pos", F.row_number().over(Window.orderBy("path"))), goal)


def project_map(files: DataFrame, depth: int, lang: str | None = None) -> DataFrame:
    """(path, language, loc, symbols): files of at most so many path parts, the longest first."""
    kept = files.where((F.size(F.split("path", "/")) <= depth) & ~ignored(F.col("path")))
    rows = kept.select("path", G.language(F.col("path"), G.MAP_LANGUAGES, fold=True).alias("language"), F.size(F.filter(lines(F.col("content")), lambda x: F.trim(x) != "")).cast("bigint").alias("loc"))
    counts = G.symbols(kept).groupBy("path").agg(F.count("*").alias("symbols"))
    rows = rows.join(counts, "path", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))
    return (rows.where(F.col("language") == lang) if lang else rows).orderBy(F.desc("loc"), "path")


def members(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, member): packages of a workspace manifest; a pattern ``dir/*`` stands for the folders below that hold files.

    Cargo comes before npm and npm before Go, as only the first kind found counts.
    """
    name, c = F.regexp_extract("path", r"([^/]*)$", 1), F.col("content")
    quoted = lambda text: F.regexp_extract_all(text, F.lit(r'"([^"]+)"'), F.lit(1))
    cargo = quoted(F.regexp_extract(c, r"(?s)\[workspace\].*?members\s*=\s*\[(.*?)\]", 1))
    npm = F.from_json(F.get_json_object(c, "$.workspaces"), "array<string>")
    go = F.regexp_extract_all(c, F.lit(r"(?m)^\s*(?:use\s+)?\(?\s*\./([\w./-]+)"), F.lit(1))
    rank = F.when((name == "Cargo.toml") & c.contains("[workspace]"), 1).when((name == "package.json") & npm.isNotNull(), 2).when(name == "go.work", 3)
    found = manifests.select(rank.alias("rank"), F.when(rank == 1, cargo).when(rank == 2, npm).otherwise(go).alias("found")).where("rank IS NOT NULL")
    first = found.agg(F.min("rank").alias("rank"))
    patterns = found.join(F.broadcast(first), "rank").select("rank", F.explode("found").alias("pattern"))
    folders = files.select(F.regexp_extract("path", r"^((?:[^/]+/)*[^/]+)/[^/]+$", 1).alias("folder")).where("folder <> ''").distinct()
    parent = folders.select("folder", F.concat(F.regexp_extract("folder", r"^(.*)/[^/]+$", 1), F.lit("/*")).alias("pattern"))
    wild = patterns.where(F.col("pattern").endswith("/*")).join(parent, "pattern").select("rank", F.col("folder").alias("member"))
    plain = patterns.where(~F.col("pattern").endswith("/*")).select("rank", F.col("pattern").alias("member"))
    kind = F.when(F.col("rank") == 1, "cargo").when(F.col("rank") == 2, "npm").otherwise("go")
    return wild.unionByName(plain).distinct().select(kind.alias("kind"), "member")
