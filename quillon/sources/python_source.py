"""Symbols and edges of Python source files, by the standard library's parser.

A class is ``module.Class``, a method ``module.Class#name``, a function ``module#name``. A file that doesn't parse gives no rows.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, row string, src string, kind string, name string, start_line int, end_line int"


def module_of(path: str) -> str:
    return path.removesuffix(".py").removesuffix("/__init__").strip("/").replace("/", ".")


def parsed(path: str, text: str) -> Iterator[tuple]:
    """Rows of a file: symbols, then edges whose ``name`` is a hint."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    todo: list[tuple[ast.AST, str, bool]] = [(tree, module_of(path), False)]
    while todo:
        node, owner, in_class = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                fqn = f"{owner}.{child.name}"
                yield path, "symbol", fqn, "class", child.name, child.lineno, child.end_lineno
                for base in child.bases:
                    yield path, "edge", fqn, "extends", ast.unparse(base), base.lineno, base.end_lineno
                todo.append((child, fqn, True))
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                fqn = f"{owner}#{child.name}"
                yield path, "symbol", fqn, "method" if in_class else "function", child.name, child.lineno, child.end_lineno
                todo.append((child, fqn, False))
            else:
                if isinstance(child, ast.Call):
                    f = child.func
                    own = isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "self"
                    yield path, "edge", owner, "calls", f"#{f.attr}" if own else ast.unparse(f), child.lineno, child.end_lineno
                todo.append((child, owner, in_class))


def parse_files(files: DataFrame) -> DataFrame:
    """Symbol and edge rows of ``path, text``; a null text gives none."""

    def run(batches):
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                yield pd.DataFrame(list(parsed(path, text)) if path and text else [], columns=["path", "row", "src", "kind", "name", "start_line", "end_line"])

    return files.select("path", "text").mapInPandas(run, SCHEMA)
