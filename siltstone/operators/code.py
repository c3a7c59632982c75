"""Symbols and references of source files."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Per language the declarations that a pattern can find: kind and expression with the name as its group.
PATTERNS = {
    "javascript": (("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>"), ("interface", r"^\s*(?:export\s+)?(?:interface|type)\s+([A-Za-z_$][\w$]*)")),
    "csharp": (("class", r"^\s*(?:(?:public|internal|private|protected|sealed|static|abstract|partial)\s+)*(?:class|struct|record|interface|enum)\s+([A-Za-z_]\w*)"), ("method", r"^\s*(?:(?:public|internal|private|protected|static|async|override|virtual|sealed)\s+)+[\w<>\[\],.? ]+\s+([A-Za-z_]\w*)\s*\(")),
    "go": (("function", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*[\[(]"), ("type", r"^type\s+([A-Za-z_]\w*)\s")),
    "rust": (("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([A-Za-z_]\w*)"), ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|type|mod)\s+([A-Za-z_]\w*)")),
    "powershell": (("function", r"(?i)^\s*function\s+(?:global:|script:)?([\w-]+)"),),
    "sql": (("table", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?(?:table|view|function|procedure|index)\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"),),
    "css": (("selector", r"^\s*([.#]?[A-Za-z][\w-]*)\s*(?:,|\{)"),),
    "markup": (("heading", r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"),),
}
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "mjs": "javascript", "cs": "csharp", "go": "go", "rs": "rust", "ps1": "powershell", "sql": "sql", "css": "css", "md": "markup"}
CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
IMPORT = re.compile(r"^\s*(?:import\s+(?:.*\s+from\s+)?['\"]?([\w./@-]+)|from\s+([\w.]+)\s+import|using\s+([\w.]+)\s*;|use\s+([\w:]+))")
NOT_CALLED = frozenset("if for while switch catch return function def class func fn match with elif and or not in print new throw await typeof sizeof".split())
SYMBOLS = "path string, language string, kind string, name string, qualified_name string, line int, parser_status string"
REFERENCES = "path string, relation string, target string, line int, source_symbol string"


def python_symbols(text: str) -> list[tuple[str, str, str, int]] | None:
    """kind, name, qualified name and line of classes and functions; null if the text does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[tuple[str, str, str, int]] = []
    stack: list[tuple[ast.AST, str, bool]] = [(tree, "", False)]
    while stack:
        node, prefix, in_class = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                klass = isinstance(child, ast.ClassDef)
                name = f"{prefix}{child.name}"
                out.append(("class" if klass else "method" if in_class else "function", child.name, name, child.lineno))
                stack.append((child, f"{name}.", klass))
            else:
                stack.append((child, prefix, in_class))
    return sorted(out, key=lambda s: (s[3], s[2]))


def symbols_of(path: str, text: str | None) -> list[tuple]:
    language = LANGUAGES.get(path.rpartition(".")[2].lower(), "text")
    if not text:
        return []
    if language == "python" and (found := python_symbols(text)) is not None:
        return [(path, language, *s, "parsed") for s in found]
    rules = PATTERNS.get(language, ()) if language != "python" else (("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)"))
    out = []
    for number, line in enumerate(text.split("\n"), 1):
        for kind, rule in rules:
            if (m := re.match(rule, line)) is not None:
                out.append((path, language, kind, m[1], m[1], number, "fallback"))
                break
    return out


def references_of(path: str, text: str | None) -> list[tuple]:
    """Imports and calls with the symbol in whose lines they stand; each once."""
    if not text:
        return []
    starts = [(s[5], s[4]) for s in symbols_of(path, text)]
    out: dict[tuple, None] = {}
    at, current = 0, None
    for number, line in enumerate(text.split("\n"), 1):
        while at < len(starts) and starts[at][0] <= number:
            current = starts[at][1]
            at += 1
        if (m := IMPORT.match(line)) is not None:
            out[path, "import", next(g for g in m.groups() if g), number, None] = None
        for m in CALL.finditer(line):
            if m[1].lower() not in NOT_CALLED and not re.match(r"\s*(?:async\s+)?(?:def|function|func|fn|class)\s", line[: m.start() + 1]):
                out[path, "call", m[1], number, current] = None
    return list(out)


def _per_file(files: DataFrame, path: str, text: str, schema: str, names: list[str], one) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([row for p, t in zip(batch["path"], batch["text"], strict=True) if p is not None for row in one(p, t)], columns=names)

    return files.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(run, schema)


def code_symbols(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Declarations of each file; a file that does not parse is read by patterns and says so."""
    return _per_file(files, path, text, SYMBOLS, ["path", "language", "kind", "name", "qualified_name", "line", "parser_status"], symbols_of)


def code_references(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    return _per_file(files, path, text, REFERENCES, ["path", "relation", "target", "line", "source_symbol"], references_of)
