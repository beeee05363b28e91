"""Symbols of Python files by their syntax tree, as a table function."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, name string, kind string, parent string, signature string, start_line int, end_line int, doc string, visibility string"


def _walk(node: ast.AST, source: list[str], parent: str | None) -> Iterator[tuple]:
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(child, ast.ClassDef) else ("method" if parent else "function")
            signature = source[child.lineno - 1].strip()
            yield child.name, kind, parent, signature, child.lineno, child.end_lineno, ast.get_docstring(child), "private" if child.name.startswith("_") else "public"
            if isinstance(child, ast.ClassDef):
                yield from _walk(child, source, child.name)


def python_symbols(files: DataFrame) -> DataFrame:
    """Classes, functions and methods of Python files; files that do not parse, null and empty ones have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with warnings.catch_warnings(action="ignore"):
                        tree = ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                rows += [(path, *row) for row in _walk(tree, (content or "").splitlines(), None)]
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(read, SCHEMA)
