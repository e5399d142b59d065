"""Functions, classes and methods of Python sources; Spark has no parser for them."""

from __future__ import annotations

import ast

import pandas as pd

KINDS = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "async function", ast.ClassDef: "class"}


def symbols(source: str) -> list[tuple[str, str, int, int]]:
    """(qualified name, kind, first line, last line); only definitions directly inside one another are followed."""
    try:
        waiting = [("", False, ast.parse(source))]
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    while waiting:
        prefix, in_class, node = waiting.pop()
        inner = []
        for child in ast.iter_child_nodes(node):
            if kind := KINDS.get(type(child)):
                kind = kind.replace("function", "method") if in_class and kind != "class" else kind
                out.append((prefix + child.name, kind, child.lineno, child.end_lineno or child.lineno))
                inner.append((f"{prefix}{child.name}.", type(child) is ast.ClassDef, child))
        waiting += reversed(inner)
    return sorted(out, key=lambda s: (s[2], -s[3]))


def symbol_rows(keys: list[str]):
    def run(frames):
        for frame in frames:
            rows = [(*k, i, *s) for *k, content in frame[[*keys, "content"]].itertuples(index=False) for i, s in enumerate(symbols(content or ""))]
            yield pd.DataFrame(rows, columns=[*keys, "ordinal", "qualified_name", "kind", "start_line", "end_line"])

    return run
