"""Declarations of brace and end languages: a scanner that blanks comments and strings, pairs blocks and nests by span.

Not a grammar: macros, template literals that hold backticks, and declarations split by preprocessor branches can mislead
it.  A file that is cut off keeps its open blocks to its end.  Definitions only: uses of a type's name give no symbol.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

START = r"(?:^[ \t]*+|(?<=[{};])\s*+)"
_C = r"/\*.*?(?:\*/|\Z)|//[^\n]*"
_Q = r'"(?:\\.|[^"\\\n])*"?'
_A = r"'(?:\\.|[^'\\\n])*'?"
#: What is blanked, by language: comments and strings.
COMMENT = {"php": rf"{_C}|\#(?!\[)[^\n]*", "ruby": r"^=begin\b.*?(?:^=end\b|\Z)|#(?!\{)[^\n]*", "lua": r"--\[(?P<lc>=*)\[.*?(?:\](?P=lc)\]|\Z)|--[^\n]*"}
STRING = {
    "go": rf"`[^`]*`?|{_Q}|{_A}",
    "rust": rf'r(?P<h>#*)"(?:(?!"(?P=h)).)*(?:"(?P=h)|\Z)|"(?:\\.|[^"\\])*"?|\'(?:\\[^\n]+?|[^\\\'\n])\'',
    "javascript": rf"`(?:\\.|[^`\\])*`?|{_Q}|{_A}|(?P<before>[(,=:\[!&|?{{}};]|\breturn\b)[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/",
    "lua": rf"\[(?P<ls>=*)\[.*?(?:\](?P=ls)\]|\Z)|{_Q}|{_A}",
    "kotlin": rf'""".*?(?:"""|\Z)|{_Q}|{_A}',
    "swift": rf'""".*?(?:"""|\Z)|{_Q}',
    "java": rf'""".*?(?:"""|\Z)|{_Q}|{_A}',
}


class Rule(NamedTuple):
    """Kind, whether functions within are its methods, the pattern (name as group ``name``), where it may stand (inside a
    container's block, outside functions, anywhere), and whether a body or a whole text makes the signature."""

    kind: str
    container: bool
    pattern: str
    where: str = "anywhere"
    body: str = "needed"


_JS_MODIFIERS = r"(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*"
_JS = [
    Rule("function", False, r"(?:\basync\s+)?\bfunction\s+(?P<name>[\w$]+)\s*(?:<[^(){}]*>)?\("),
    Rule("class", True, r"(?<!abstract )\bclass\s+(?P<name>[\w$]+)"),
    Rule("method", False, START + r"(?:@[\w.]+(?:\([^)]*\))?\s*)*(?P<start>)" + _JS_MODIFIERS + r"(?:\*\s*)?(?P<name>\#?[\w$]+)\s*(?:<[^(){}]*>)?\(", "class"),
    Rule("function", False, r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=;\n]+)?=\s*(?P<start>)(?:async\s+)?(?:(?:<[^()=]*>\s*)?\((?:[^()]|\([^()]*\))*\)\s*(?::[^=;{]+)?|[\w$]+\s*)=>", body="arrow"),
    Rule("function", False, r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=;\n]+)?=\s*(?P<start>)(?:async\s+)?function\b\s*[\w$]*\s*\("),
]
_TS = [Rule("type", False, r"\b(?:interface|(?:const\s+)?enum)\s+(?P<name>[\w$]+)"), Rule("type", False, START + r"(?:export\s+)?(?:declare\s+)?(?P<start>)type\s+(?P<name>[\w$]+)\s*(?:<[^={}]*>)?\s*=", body="whole")]
_C_CALLS = r"(?!(?:if|while|for|switch|else|return|do|catch|sizeof)\b)"
_C_FUNCTION = START + r"(?:(?:public|private|protected)\s*:(?!:)\s*)?(?:template\s*<[^{};]*>\s*)?(?P<start>)(?:[\w:]++(?:<[^(){};]*>)?(?:\s++|(?=[*&])))*?(?P<name>(?:[*&]+\s*(?:const\s+)?)*" + _C_CALLS + r"~?[A-Za-z_][\w:~]*(?:operator\s*[^\s\w(]+)?\s*\((?:[^(){};]|\([^(){};]*\))*\)(?:\s*const\b)?)(?:\s*(?:noexcept|override|final))*\s*(?::[^{};]*)?(?=\{)"
_MODIFIED = START + r"(?P<start>)(?:@\w+(?:\([^)]*\))?\s+|(?:public|private|protected|internal|open|final|static|abstract|override|data|sealed|inline|suspend|mutating|class|enum|inner|fileprivate|indirect|annotation|operator|infix|companion|value)\s+)*"
_JAVA = START + r"(?P<start>)(?:@[\w.]+(?:\([^)]*\))?\s*|(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|sealed|non-sealed)\s+)*"
_VISIBLE = r"(?:pub(?:\([^)]*\))?\s+)?"
RULES: dict[str, list[Rule]] = {
    "javascript": _JS,
    "typescript": _JS + _TS,
    "tsx": _JS + _TS,
    "go": [
        Rule("function", False, r"^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\("),
        Rule("method", False, r"^func\s*\([^)]*\)\s*(?P<name>\w+)\s*\("),
        Rule("type", False, r"^[ \t]*type\s+(?:\(\s*)?(?P<name>\w+)(?:\[[^\]=]+\])?[ \t]+(?!=)", body="whole"),
    ],
    "rust": [
        Rule("function", False, START + r"(?:#!?\[[^\n]*\]\s*)*(?P<start>)" + _VISIBLE + r"(?:(?:const|async|unsafe|extern)\s+)*fn\s+(?P<name>\w+)"),
        Rule("type", False, START + r"(?:#!?\[[^\n]*\]\s*)*(?P<start>)" + _VISIBLE + r"(?:struct|enum)\s+(?P<name>\w+)", body="optional"),
        Rule("type", True, START + r"(?:#!?\[[^\n]*\]\s*)*(?P<start>)" + _VISIBLE + r"(?:unsafe\s+)?trait\s+(?P<name>\w+)"),
        Rule("type", False, START + r"(?:#!?\[[^\n]*\]\s*)*(?P<start>)" + _VISIBLE + r"type\s+(?P<name>\w+)[^=;]*=", "outside", "whole"),
    ],
    "java": [
        Rule("class", True, _JAVA + r"class\s+(?P<name>\w+)"),
        Rule("type", True, _JAVA + r"(?:interface|enum)\s+(?P<name>\w+)"),
        Rule("method", False, _JAVA + r"(?:<[^(){};]*>\s*)?(?:(?!(?:new|return|else|throw)\b)[\w.$]+(?:<[^(){};=]*>)?(?:\s*\[\s*\])*\s+)?(?P<name>\w+)\s*\(", "class", "optional"),
    ],
    "php": [
        Rule("class", True, START + r"(?P<start>)(?:(?:final|abstract|readonly)\s+)*class\s+(?P<name>\w+)"),
        Rule("type", True, START + r"(?P<start>)(?:interface|trait)\s+(?P<name>\w+)"),
        Rule("type", False, START + r"(?P<start>)enum\s+(?P<name>\w+)"),
        Rule("function", False, START + r"(?P<start>)(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?\s*(?P<name>\w+)\s*\(", body="optional"),
    ],
    "c": [Rule("function", False, _C_FUNCTION, "outside"), Rule("type", False, r"\b(?:struct|enum)\s+(?P<name>\w+)(?=\s*\{)")],
    "cpp": [
        Rule("function", False, _C_FUNCTION, "outside"),
        Rule("class", True, r"(?<!enum )\bclass\s+(?P<name>\w+)(?:\s+final)?(?=\s*(?::[^:{};()][^{};()]*)?\{)"),
        Rule("type", True, r"(?<!enum )\bstruct\s+(?P<name>\w+)(?:\s+final)?(?=\s*(?::[^:{};()][^{};()]*)?\{)"),
        Rule("type", True, r"\bnamespace\s+(?P<name>[\w:]+)(?=\s*\{)"),
        Rule("type", False, r"\benum\s+(?:(?:class|struct)\s+)?(?P<name>\w+)(?=\s*(?::[^{};()]*)?\{)"),
    ],
    "kotlin": [
        Rule("class", True, _MODIFIED + r"(?:(?<=[\s{};])|^)(?:fun\s+)?(?:class|interface|object)\s+(?P<name>\w+)", body="line"),
        Rule("function", False, _MODIFIED + r"fun\s+(?:<[^(){}]*>\s*)?(?:[\w<>?, ]+\.)?(?P<name>\w+)\s*\(", body="line"),
    ],
    "swift": [
        Rule("class", True, _MODIFIED + r"(?:class|struct|enum|actor|extension)\s+(?!func\b|var\b|let\b)(?P<name>[\w.]+)"),
        Rule("type", True, _MODIFIED + r"protocol\s+(?P<name>\w+)"),
        Rule("function", False, _MODIFIED + r"func\s+(?P<name>\w+)\s*(?:<[^(){}]*>)?\(", "no protocol"),
    ],
    "ruby": [Rule("class", True, r"^[ \t]*class\s+(?P<name>[A-Z][\w:]*)"), Rule("type", True, r"^[ \t]*module\s+(?P<name>[A-Z][\w:]*)"), Rule("function", False, r"^[ \t]*(?:(?:private|public|protected|private_class_method)\s+)?(?P<start>)def\s+(?:\w+\.)?(?P<name>[^\s(;.]+)")],
    "lua": [Rule("function", False, r"(?:\blocal\s+)?\bfunction\s+(?P<name>[\w.:]+)\s*\(")],
}
_SAME = {"typescript": "javascript", "tsx": "javascript"}
_TOKENS = {n: re.compile(rf"(?P<comment>{COMMENT.get(n, _C)})|{STRING.get(_SAME.get(n, n), f'{_Q}|{_A}')}", re.S | re.M) for n in RULES}
_RULES = {n: [(r, re.compile(r.pattern, re.M)) for r in rules] for n, rules in RULES.items()}
_WORDS = {
    "lua": (re.compile(r"\b(?:function|if|do|repeat)\b"), re.compile(r"\b(?:end|until)\b")),
    "ruby": (re.compile(r"(?<![.:\w])(?:(?:class|module|def|begin|case|do)\b(?!:)|(?:(?<=\n)|\A|(?<==)|(?<=;))[ \t]*(?:if|unless|while|until|for)\b)"), re.compile(r"(?<![.:\w])end\b(?!:)")),
}
_ONE_LINE_DO = re.compile(r"\b(?:while|until|for)\b[^\n]*?\bdo\b")
_ENDLESS = re.compile(r"def\s+[^\s(=]+(?:\([^\n]*?\))?\s*=(?!=)")
_DECORATOR = re.compile(r"#\[[^\n]*\]|@[\w.]+(?:\([^()]*\))?")
_STOPS = {x: re.compile(rf"[(\[{re.escape(x)}]") for x in ("{;", "{;\n", "{\n;", ";\n,)", "\n")}
_MARK = re.compile(r"^(?:/\*\*|/\*|///|//!|//|\*(?!/))")


class Found(NamedTuple):
    """A declaration: spans are of characters; ``body`` is where the signature ends."""

    name: str
    kind: str
    container: bool
    start: int
    body: int
    end: int
    decorators: tuple[str, ...]


def masked(content: str, language: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with comments and strings blanked, breaks kept, and the spans of comments."""
    out, comments, last = [], [], 0
    for m in _TOKENS[language].finditer(content):
        at = m.start()
        if m.groupdict().get("before"):
            at += len(m["before"])
        if m["comment"] is not None:
            comments.append(m.span())
        out += [content[last:at], re.sub(r"[^\n]", " ", content[at : m.end()])]
        last = m.end()
    return "".join([*out, content[last:]]), comments


class Blocks:
    """Paired blocks of a masked text, by their opening place."""

    def __init__(self, text: str, language: str) -> None:
        self.close: dict[int, int] = {}
        self.parent: dict[int, int | None] = {}
        if language in _WORDS:
            opening, closing = _WORDS[language]
            marks = sorted([(m.end(), 1) for m in opening.finditer(text)] + [(m.end(), -1) for m in closing.finditer(text)])
            if language == "ruby":
                gone = {m.end() for m in _ONE_LINE_DO.finditer(text)} | {m.start() + 3 for m in _ENDLESS.finditer(text)}
                marks = [x for x in marks if x[0] not in gone]
        else:
            marks = [(m.start(), 1 if m[0] == "{" else -1) for m in re.finditer(r"[{}]", text)]
        stack: list[int] = []
        for at, step in marks:
            if step > 0:
                self.parent[at] = stack[-1] if stack else None
                stack.append(at)
            elif stack:
                self.close[stack.pop()] = at
        for at in stack:
            self.close[at] = len(text)
        self.opens = sorted(self.parent)
        self.pairs: dict[int, int] = {}
        held: list[int] = []
        for m in re.finditer(r"[()\[\]]", text):
            if m[0] in "([":
                held.append(m.start())
            elif held:
                self.pairs[held.pop()] = m.start()

    def around(self, place: int) -> int | None:
        """The innermost block that holds a place."""
        i = bisect_right(self.opens, place) - 1
        at = self.opens[i] if i >= 0 else None
        while at is not None and not at < place <= self.close[at]:
            at = self.parent[at]
        return at


def _stop(text: str, at: int, stops: str, blocks: Blocks) -> int:
    """The next of ``stops`` outside parentheses and brackets; one that never closes holds nothing."""
    pattern = _STOPS[stops]
    while m := pattern.search(text, at):
        if m[0] in stops:
            return m.start()
        at = blocks.pairs.get(m.start(), m.start()) + 1
    return len(text)


def _line_stop(text: str, at: int, blocks: Blocks) -> int:
    """Where a declaration's header ends in languages without semicolons: a block, or a line that the next one doesn't go on."""
    while True:
        at = _stop(text, at, "{\n;", blocks)
        following = re.compile(r"\s*(?:([{])|([:=.]|where\b|->))").match(text, at + 1) if text[at : at + 1] == "\n" else None
        if following is None:
            return at
        at = following.start(1) if following[1] else following.end()


def _spans(text: str, rule: Rule, m: re.Match, blocks: Blocks, language: str) -> tuple[int, int] | None:
    """Where the signature and the declaration end, or None if a body that it needs is missing."""
    if language in _WORDS:
        # the header's own word opens the block
        word = bisect_right(blocks.opens, m.start("name"))
        opened = blocks.opens[word - 1] if word and blocks.opens[word - 1] > m.start() else None
        header = text.find(")", m.end()) + 1 if text[m.end() - 1 : m.end()] == "(" else text.find("\n", m.end())
        header = header if header > 0 else len(text)
        return header, blocks.close[opened] if opened is not None else header
    at = m.end()
    if m[0].endswith("("):
        at = blocks.pairs.get(at - 1, len(text)) + 1
    if rule.body == "arrow":
        first = re.compile(r"\s*").match(text, at).end()
        return first, blocks.close[first] + 1 if first in blocks.close else _stop(text, first, ";\n,)", blocks)
    if rule.body in ("line", "whole") and language in ("kotlin", "go"):
        stop = _line_stop(text, at, blocks)
        if text[at:stop].lstrip().startswith("=") and text[stop : stop + 1] == "{":
            stop = _stop(text, blocks.close[stop] + 1, "\n", blocks)
            return stop, stop
        end = blocks.close[stop] + 1 if stop in blocks.close else stop
        return end, end
    if rule.body == "whole":
        stop = at
        while True:
            stop = _stop(text, stop, "{;\n" if language != "rust" else "{;", blocks)
            if stop in blocks.close:
                stop = blocks.close[stop] + 1
            elif text[stop : stop + 1] == "\n" and (text[at:stop].rstrip()[-1:] in ("", "|", "&", "=") or re.compile(r"\s*[|&]").match(text, stop + 1)):
                stop += 1
            else:
                break
        end = stop + (text[stop : stop + 1] == ";")
        return end, end
    stop = _stop(text, at, "{;", blocks)
    if stop in blocks.close:
        return stop, blocks.close[stop] + 1
    return (stop + 1, stop + 1) if rule.body == "optional" and stop < len(text) else None


def found(content: str, language: str) -> tuple[list[Found], list[tuple[int, int]]]:
    """Declarations in order of their start, and the spans of comments."""
    text, comments = masked(content, language)
    blocks = Blocks(text, language)
    out: list[Found] = []
    typed: dict[int, Rule] = {}
    for rule, pattern in sorted(_RULES[language], key=lambda x: x[0].where in ("class", "outside", "no protocol")):
        for m in pattern.finditer(text):
            start = m.start("start") if "start" in pattern.groupindex else m.start() + len(m[0]) - len(m[0].lstrip())
            around = blocks.around(m.start("name"))
            holder = typed.get(around) if around is not None else None
            if rule.where == "class" and (holder is None or m["name"] in ("if", "for", "while", "switch", "catch", "function")):
                continue
            if rule.where == "outside" and around is not None and holder is None and not re.search(r"(?:extern|namespace)\s*\Z", text[max(0, around - 40) : around]) and language != "rust":
                continue
            if rule.where == "no protocol" and holder is not None and holder.kind == "type":
                continue
            spans = _spans(text, rule, m, blocks, language)
            if spans is None:
                continue
            body, end = spans
            if rule.kind in ("class", "type") and language not in _WORDS:
                opened = _stop(text, m.end(), "{;", blocks)
                if opened in blocks.close:
                    typed[opened] = rule
            kind = "method" if language == "php" and rule.kind == "function" and holder is not None else rule.kind
            decorators = tuple(_DECORATOR.findall(content, m.start(), start))
            out.append(Found(m["name"].strip(), kind, rule.container, start, body, end, decorators))
    return sorted(set(out), key=lambda f: (f.start, -f.end)), comments


def docstring(content: str, start: int, comments: list[tuple[int, int]], begins: list[int]) -> str:
    """The comments directly before a place, without their marks."""
    at, got = start, []
    for i in range(bisect_right(begins, start) - 1, -1, -1):
        a, b = comments[i]
        if b > at or content[b:at].strip():
            break
        got.append(content[a:b].strip())
        at = a
    lines = (_MARK.sub("", x.strip()).removesuffix("*/").strip() for x in "\n".join(reversed(got)).split("\n"))
    return "\n".join(lines).strip()


def declared(content: str, language: str) -> Iterator[tuple]:
    """(name, qualified name, kind, line, end line, signature, docstring, decorators, parent, start, end), in document order.

    ``parent`` is the place of the enclosing declaration in this order, or -1; start and end are in characters."""
    if language not in RULES:
        return
    items, comments = found(content, language)
    begins = [a for a, _ in comments]
    breaks = [i for i, c in enumerate(content) if c == "\n"]
    open_items: list[tuple[int, Found, str]] = []
    for n, f in enumerate(items):
        while open_items and open_items[-1][1].end <= f.start:
            open_items.pop()
        name, kind, parent = f.name, f.kind, -1
        if open_items:
            parent, holder, above = open_items[-1]
            name = f"{above}.{f.name}"
            if kind == "function" and holder.container:
                kind = "method"
        open_items.append((n, f, name))
        signature = content[f.start : f.body].strip().rstrip("{: \n\t")
        doc = "" if f.decorators else docstring(content, f.start, comments, begins)
        yield f.name, name, kind, bisect_right(breaks, f.start - 1) + 1, bisect_right(breaks, max(f.start, f.end - 1) - 1) + 1, signature, doc, list(f.decorators), parent, f.start, f.end
