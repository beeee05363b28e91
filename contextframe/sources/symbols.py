"""Symbols of source files in ten languages, by a scan of definitions and braces.

Comments and strings are blanked out first, so braces in them do not count. A definition
ends with the brace that closes it, or with its line; definitions inside a type belong to
it. Python files are read by their syntax tree. The scan is heuristic: macros and
preprocessor branches are not followed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextframe.operators.codegraph import READ_LANGUAGES, language
from contextframe.sources.python_symbols import SCHEMA, python_symbols

_WORD = r"[A-Za-z_]\w*"
_JAVA = r"(?:(?:public|protected|private|static|final|abstract|sealed|synchronized|native|default|override|open|internal|fileprivate|mutating|readonly|async|virtual|inline|constexpr|explicit|extern|unsafe|export|declare)\s+)*"
#: Definitions of each language: kind and pattern with the name; the kinds in _TYPES hold members.
DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("function", rf"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?fn\s+(?P<n>{_WORD})"),
        *((kind, rf"(?:pub(?:\([^)]*\))?\s+)?{kind}\s+(?P<n>{_WORD})") for kind in ("struct", "enum", "trait", "mod", "const", "static", "type")),
        ("impl", rf"(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<n>{_WORD})"),
    ],
    "typescript": [
        ("function", rf"{_JAVA}function\s*\*?\s*(?P<n>{_WORD})"),
        ("class", rf"{_JAVA}class\s+(?P<n>{_WORD})"),
        ("interface", rf"{_JAVA}interface\s+(?P<n>{_WORD})"),
        ("enum", rf"{_JAVA}(?:const\s+)?enum\s+(?P<n>{_WORD})"),
        ("type", rf"{_JAVA}type\s+(?P<n>{_WORD})\s*[=<]"),
        ("function", rf"{_JAVA}(?:const|let|var)\s+(?P<n>{_WORD})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_WORD})\s*(?::[^=]+)?=>"),
        ("method", rf"{_JAVA}(?:get\s+|set\s+|\*\s*)?(?P<n>#?{_WORD})\s*(?:<[^>]*>)?\([^;{{]*\)\s*(?::[^{{;]+)?\{{"),
    ],
    "go": [
        ("method", rf"func\s+\([^)]*\)\s*(?P<n>{_WORD})"),
        ("function", rf"func\s+(?P<n>{_WORD})"),
        ("struct", rf"type\s+(?P<n>{_WORD})(?:\[[^\]]*\])?\s+struct\b"),
        ("interface", rf"type\s+(?P<n>{_WORD})(?:\[[^\]]*\])?\s+interface\b"),
        ("type", rf"type\s+(?P<n>{_WORD})\b"),
    ],
    "php": [
        ("function", rf"{_JAVA}function\s+&?(?P<n>{_WORD})"),
        *((kind, rf"{_JAVA}{kind}\s+(?P<n>{_WORD})") for kind in ("class", "interface", "trait", "enum")),
    ],
    "swift": [
        ("function", rf"{_JAVA}(?:class\s+)?func\s+(?P<n>{_WORD})"),
        *((kind, rf"{_JAVA}{kind}\s+(?P<n>{_WORD})") for kind in ("class", "struct", "enum", "protocol", "extension", "actor")),
        ("method", rf"{_JAVA}(?P<n>init)[?!]?\s*\("),
    ],
    "java": [
        *((kind, rf"{_JAVA}{kind}\s+(?P<n>{_WORD})") for kind in ("class", "interface", "enum", "record")),
        ("method", rf"{_JAVA}(?:<[^>]*>\s*)?(?!return\b|new\b|else\b|throw\b)(?:[\w.<>\[\],?]+\s+)?(?P<n>{_WORD})\s*\([^;{{]*\)\s*(?:throws\s+[\w., ]+)?\{{"),
    ],
    "c": [
        ("struct", rf"(?:typedef\s+)?struct\s+(?P<n>{_WORD})\s*\{{"),
        ("enum", rf"(?:typedef\s+)?enum\s+(?P<n>{_WORD})\s*\{{"),
        ("type", rf"typedef\b[^{{;]*?(?P<n>{_WORD})\s*;"),
        ("function", rf"(?!return\b|else\b|typedef\b)(?:[\w*&:<>,]+[ \t]+)+[*&]*(?P<n>~?{_WORD}(?:::~?{_WORD})*)\s*\([^;{{}}]*\)\s*(?:const\s*|noexcept\s*|override\s*)*\{{"),
    ],
}
DEFINITIONS["javascript"] = DEFINITIONS["typescript"]
DEFINITIONS["cpp"] = [
    ("class", rf"(?:template\s*<[^>]*>\s*)?class\s+(?P<n>{_WORD})[^;{{]*\{{"),
    ("namespace", rf"namespace\s+(?P<n>{_WORD})\s*\{{"),
    *DEFINITIONS["c"],
    ("method", rf"{_JAVA}(?P<n>~?{_WORD})\s*\([^;{{}}]*\)\s*(?::[^{{;]*)?\{{"),
]
_TYPES = {"class", "struct", "enum", "trait", "interface", "impl", "protocol", "extension", "actor", "record"}
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "else", "do", "try", "match", "sizeof", "func"}
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.){1,2}'|`(?:[^`\\]|\\.)*`", re.S)
_HASH_NOISE = re.compile(r"#[^\n\[]*")
_COMPILED = {lang: [(kind, re.compile(r"^[ \t]*" + pattern, re.M)) for kind, pattern in of] for lang, of in DEFINITIONS.items()}


def _bare(source: str, lang: str) -> str:
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    source = _NOISE.sub(blank, source)
    return _HASH_NOISE.sub(blank, source) if lang in ("php", "c", "cpp") else source


def _end(bare: str, at: int) -> int:
    """Where the definition that begins before ``at`` ends: behind its closing brace, or at a semicolon or line end before any brace."""
    opening = bare.find("{", at)
    semicolon = bare.find(";", at)
    if opening < 0 or 0 <= semicolon < opening:
        line = bare.find("\n", at)
        return semicolon if semicolon >= 0 else (line if line >= 0 else len(bare))
    depth = 0
    for match in re.compile(r"[{}]").finditer(bare, opening):
        depth += 1 if match[0] == "{" else -1
        if depth == 0:
            return match.end()
    return len(bare)


def visible(lang: str, signature: str, name: str, parent_part: str) -> str | None:
    """The visibility of a definition by its language's rule; ``parent_part`` is the text of its type before it."""
    if lang == "rust":
        return "public" if signature.startswith("pub") else "private"
    if lang == "go":
        return "public" if name[:1].isupper() else "private"
    if lang == "c":
        return None
    if lang == "cpp":
        labels = re.findall(r"\b(public|protected|private)\s*:", parent_part)
        return labels[-1] if labels else ("private" if parent_part else "public")
    if lang in ("typescript", "javascript") and not parent_part:
        return "public" if signature.startswith("export") else "private"
    found = re.search(r"\b(private|protected|fileprivate)\b", signature)
    return "private" if found and found[1] == "fileprivate" else (found[1] if found else "public")


def scan(source: str, lang: str) -> list[tuple]:
    """(name, kind, parent, signature, start_line, end_line, doc, visibility) of each definition, in order."""
    bare, lines = _bare(source, lang), source.split("\n")
    breaks = [at for at, c in enumerate(source) if c == "\n"]
    found: dict[int, tuple[str, str, int, int]] = {}
    for kind, pattern in _COMPILED[lang]:
        for match in pattern.finditer(bare):
            name, at = match["n"], match.start("n")
            if name not in _NOT_NAMES and at not in found:
                found[at] = (name, kind, match.start() + len(match[0]) - len(match[0].lstrip()), _end(bare, match.end() - (bare[match.end() - 1] == "{")))
    rows, open_types = [], []
    inside = -1  # the end of the function that hides what it holds
    for at in sorted(found):
        name, kind, begin, end = found[at]
        while open_types and open_types[-1][1] <= begin:
            open_types.pop()
        parent = open_types[-1] if open_types else None
        if begin < inside or kind == "method" and not parent and lang != "go":
            continue
        if kind in _TYPES:
            open_types.append((name, end, begin))
        elif kind in ("function", "method"):
            inside = end
            kind = "method" if parent else kind
        if kind in ("impl", "extension"):
            continue
        first, last = bisect_left(breaks, begin), bisect_left(breaks, max(begin, end - 1))
        doc = re.match(r"\s*(?:///?|/?\*+|#)\s?(.*?)(?:\*/)?\s*$", lines[first - 1]) if first else None
        rows.append((name, kind, parent[0] if parent else None, lines[first].strip(), first + 1, last + 1, doc[1] if doc else None, visible(lang, lines[first].strip(), name, bare[parent[2] : begin] if parent else "")))
    return rows


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind, parent, signature, start_line, end_line, doc, visibility) of files in the ten languages.

    Null and empty files and other languages have none.
    """
    known = files.select("path", "content", language(F.col("path"), READ_LANGUAGES).alias("lang")).where("lang IS NOT NULL AND content <> ''")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *row) for path, content, lang in zip(batch["path"], batch["content"], batch["lang"], strict=True) for row in scan(content, lang)]
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in SCHEMA.split(", ")])

    return known.where("lang <> 'python'").mapInPandas(read, SCHEMA).unionByName(python_symbols(known.where("lang = 'python'")))
