"""Scalar building blocks of the facts model, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix/`` and 24 hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.concat(F.lit(f"{prefix}/"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 24))


def side(value: Column) -> Column:
    """Lower-cased and trimmed side, anything else is unknown."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("client", "server", "shared"), low).otherwise("unknown")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def dirname(path: Column) -> Column:
    """Directory of a path; a bare name is in "/"."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


#: File extensions and their language ids.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust",
    ".java": "java", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp",
    ".rb": "ruby", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".lua": "lua",
}


def language(path: Column) -> Column:
    """Language id by extension, empty for others."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(""))


def fuzzy_threshold(length: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(length / 4).cast("int"))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ``**`` crosses directories, ``*`` and ``?`` don't, ``{a,b}`` and ``[..]`` as usual."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inside = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]", end + 1
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x)[1:-1] for x in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def matches_glob(path: Column, pattern: str) -> Column:
    """Whole path, or its last part if the pattern has no slash."""
    whole = path.rlike(glob_regex(pattern))
    return whole if "/" in pattern else whole | basename(path).rlike(glob_regex(pattern))


def savings(raw: Column, response: Column) -> Column:
    """Tokens saved by a response: a quarter of the bytes that it leaves out."""
    return F.greatest(F.lit(0), F.floor((raw - response) / 4)).cast("long")


def smart_truncate(text: str, most: int) -> str:
    """Keep the first and last lines of a text within ``most`` bytes, 60 to 40, with a note of the lines left out."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    lines = text.split("\n")
    if len(lines) <= 3:
        return raw[:most].decode("utf-8", "ignore")
    head, tail, left = [], [], most - 48
    room = left * 6 // 10
    for line in lines:
        room -= len(line.encode()) + 1
        if room < 0:
            break
        head.append(line)
    room = left - sum(len(x.encode()) + 1 for x in head)
    for line in reversed(lines[len(head) :]):
        room -= len(line.encode()) + 1
        if room < 0:
            break
        tail.append(line)
    omitted = len(lines) - len(head) - len(tail)
    return "\n".join([*head, f"... [{omitted} lines omitted] ...", *reversed(tail)])


def with_context(content: Column, first: Column, last: Column, context: int) -> Column:
    """Lines ``first`` to ``last`` (from 1) with ``context`` lines before and after."""
    lines = F.split(content, "\n", -1)
    begin = F.greatest(first - context, F.lit(1)).cast("int")
    return F.array_join(F.slice(lines, begin, (F.least(last + context, F.size(lines)) - begin + 1).cast("int")), "\n")


def numbered_lines(text: Column, count: int) -> list[Column]:
    """Of a reply of lines like "2. words", the words for each number up to ``count``, 120 characters at most; of several
    lines with one number the last counts, and a number that is missing gives an empty string."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))

    def of(k: int) -> Column:
        number = lambda x: F.regexp_extract(x, r"^(\d{1,3})\.", 1).try_cast("int")
        own = F.filter(lines, lambda x: (F.length(x) >= 3) & number(x).eqNullSafe(F.lit(k)))
        found = F.regexp_replace(F.get(own, F.size(own) - 1), r"^\d+\.\s*", "")
        return F.coalesce(F.substring(found, 1, 120), F.lit(""))

    return [of(k) for k in range(1, count + 1)]


def module_path(content: Column) -> Column:
    """The path that a Go module file declares."""
    return F.regexp_extract(content, r"(?m)^module\s+(\S+)", 1)
