"""Symbols of source files: Python by its grammar, other languages by their declarations."""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

from factline.functions.scalar import LANGUAGES
from factline.sources.declarations import declared

SYMBOLS = (
    "path string, symbol_id string, name string, qualified_name string, kind string, line int, end_line int, signature string, docstring string, "
    "decorators array<string>, parent string, byte_offset long, byte_length long, content_hash string"
)
NAMES = [c.split()[0] for c in SYMBOLS.split(", ")]
MOST_SIGNATURE = 100


def is_constant(name: str) -> bool:
    """No lower-case letter, or an upper-case first one and an underscore."""
    return bool(name) and (not any(c.isalpha() and not c.isupper() for c in name) or (len(name) > 1 and name[0].isupper() and "_" in name))


def _unquoted(text: str) -> str:
    text = text.strip()
    for q in ('"""', "'''", '"', "'"):
        if text.startswith(q) and text.endswith(q) and len(text) >= 2 * len(q):
            return text[len(q) : -len(q)].strip()
    return text


def _python(content: str) -> Iterator[tuple]:
    """Like ``declared``, but start and end are in bytes; a file that the grammar refuses gives none."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return
    raw = content.encode()
    # the grammar counts lines at \n, \r\n and \r
    starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", raw))]
    count = -1

    def at(line: int, column: int) -> int:
        return starts[line - 1] + column

    def text(a: int, b: int) -> str:
        return raw[a:b].decode(errors="replace")

    def walk(node: ast.AST, above: str, holder: int, in_class: bool) -> Iterator[tuple]:
        nonlocal count
        for n in ast.iter_child_nodes(node):
            name, place, of_class = above, holder, in_class
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                of_class = isinstance(n, ast.ClassDef)
                name = f"{above}.{n.name}" if above else n.name
                kind = "class" if of_class else "method" if in_class else "function"
                first = n.body[0]
                begins = min([at(first.lineno, first.col_offset), *(at(d.lineno, d.col_offset) - 1 for d in getattr(first, "decorator_list", ()))])
                start, end = at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset)
                strings = (s.value for s in n.body if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str))
                doc = next((_unquoted(text(at(v.lineno, v.col_offset), at(v.end_lineno, v.end_col_offset))) for v in strings), "")
                decorators = ["@" + text(at(d.lineno, d.col_offset), at(d.end_lineno, d.end_col_offset)) for d in n.decorator_list]
                count += 1
                place = count
                yield n.name, name, kind, n.lineno, n.end_lineno, text(start, begins).strip().rstrip("{: \n\t"), doc, decorators, holder, start, end
            elif isinstance(n, (ast.Assign, ast.AnnAssign)) and holder < 0:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and is_constant(t.id):
                        start, end = at(t.lineno, t.col_offset), at(n.end_lineno, n.end_col_offset)
                        count += 1
                        yield t.id, t.id, "constant", t.lineno, n.end_lineno, text(start, end)[:MOST_SIGNATURE].strip(), "", [], -1, start, end
            yield from walk(n, name, place, of_class)

    yield from walk(tree, "", -1, False)


def extract(path: str, content: str | None, language: str) -> list[tuple]:
    """Symbols of one file in document order; ids that repeat get ``~1``, ``~2``, ...  A null text has none.

    A function in a container is a method; the parent is the enclosing symbol's id before such an ordinal."""
    content = content or ""
    if language == "python":
        found = list(_python(content))
        place = list
    else:
        found = list(declared(content, language))
        ahead = [0, *accumulate(len(line.encode()) for line in content.splitlines(keepends=True))] if not content.isascii() else None
        chars = [0, *accumulate(len(line) for line in content.splitlines(keepends=True))]

        def place(spans):
            if ahead is None:
                return list(spans)
            out = []
            for i in spans:
                n = bisect_right(chars, i) - 1
                out.append(ahead[n] + len(content[chars[n] : i].encode()))
            return out

    raw = content.encode()
    ids = [f"{path}::{s[1]}#{s[2]}" for s in found]
    repeated = {i for i, n in Counter(ids).items() if n > 1}
    out, seen = [], Counter()
    for s, i in zip(found, ids, strict=True):
        parent = ids[s[8]] if s[8] >= 0 else ""
        if i in repeated:
            seen[i] += 1
            i = f"{i}~{seen[i]}"
        a, b = place(s[9:11])
        out.append((path, i, *s[:8], parent, a, b - a, hashlib.sha256(raw[a:b]).hexdigest()))
    return out


def symbols_of(files: DataFrame) -> DataFrame:
    """Symbols of (path, content) files, language by extension; files of other languages give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                m = re.search(r"\.[^./]*$", path or "")
                rows += extract(path, content, LANGUAGES.get(m[0].lower() if m else "", ""))
            yield pd.DataFrame(rows, columns=NAMES)

    return files.select("path", "content").mapInPandas(run, SYMBOLS)
