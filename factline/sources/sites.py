"""Sites of source files: imports and calls of JavaScript, Lua and Go, calls of resource scripts, framework calls."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from factline.functions.scalar import LANGUAGES

SITES = "path string, kind string, name string, target string, line int, dynamic boolean"
#: Calls of resource scripts with the kind of fact that they make.
SCRIPT_CALLS = {
    "RegisterNetEvent": "net_event_registration", "RegisterServerEvent": "net_event_registration",
    "AddEventHandler": "event_handler", "TriggerEvent": "event_trigger", "TriggerServerEvent": "server_event_trigger",
    "TriggerLatentServerEvent": "server_event_trigger", "TriggerLatentClientEvent": "client_event_trigger",
    "TriggerClientEvent": "client_event_trigger", "RegisterCommand": "command", "RegisterNUICallback": "nui_callback",
    "lib.callback.register": "callback_definition", "lib.callback.await": "callback_call", "lib.callback": "callback_call",
}
#: Operations of known frameworks by (framework, API).
OPERATIONS = {
    "qbx": {"GetCoreObject": "framework_object_acquire", "GetPlayer": "player_lookup", "SetJob": "player_job_set", "AddMoney": "player_money_add", "RemoveMoney": "player_money_remove", "SetMetaData": "player_metadata_set"},
    "esx": {"getSharedObject": "framework_object_acquire", "GetPlayerFromId": "player_lookup", "addMoney": "player_money_add", "addAccountMoney": "player_money_add", "removeMoney": "player_money_remove", "removeAccountMoney": "player_money_remove", "setJob": "player_job_set"},
    "ox_inventory": {"AddItem": "inventory_add_item", "RemoveItem": "inventory_remove_item", "Search": "inventory_query", "GetInventory": "inventory_query", "CanCarryItem": "inventory_capacity_check", "SetMetadata": "inventory_metadata_set", "RegisterStash": "inventory_stash_register"},
}
OPERATIONS["qbcore"] = OPERATIONS["qbx"]
RESOURCE_FRAMEWORK = {"qbx_core": "qbx", "qb-core": "qbcore", "es_extended": "esx", "ox_inventory": "ox_inventory"}
LUA_STRIP = re.compile(r"--\[\[.*?\]\]|--[^\n]*", re.S)
JS_STRIP = re.compile(r"/\*.*?\*/|(?<![:'\"])//[^\n]*", re.S)
LUA_CALL = re.compile(r"\b([A-Za-z_][\w.]*)\s*\(\s*(?:(['\"])([^'\"\n]*)\2|([^)\n]{0,80}))?")
LUA_EXPORT = re.compile(r"\bexports(?:\.([A-Za-z_]\w*)|\[\s*(['\"])([^'\"\n]+)\2\s*\])\s*:\s*([A-Za-z_]\w*)")
LUA_PROVIDE = re.compile(r"\bexports\s*\(\s*(['\"])([^'\"\n]+)\1")
LUA_REQUIRE = re.compile(r"(?:local\s+(\w+)\s*=\s*)?\brequire\s*\(?\s*(['\"])([^'\"\n]+)\2")
JS_IMPORT = re.compile(r"\bimport\s+(?:([\w*{}\s,$]+?)\s+from\s+)?(['\"])([^'\"\n]+)\2")
JS_EXPORT = re.compile(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+(\w+)")
CALL = re.compile(r"(?<![\w.])([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
GO_IMPORT = re.compile(r"(?:^\s*import\s+|^\s+)(?:([\w.]+)\s+)?\"([^\"\n]+)\"", re.M)
WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "func", "elseif", "and", "or", "not", "typeof", "new", "await", "make", "append", "len"}


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _blank(pattern: re.Pattern, text: str) -> str:
    """Comments out, line breaks kept."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


ASSIGNED = re.compile(r"(?:^|;|\bthen\b|\bdo\b|\belse\b)[ \t]*(?:local[ \t]+)?([A-Za-z_]\w*)[ \t]*=[ \t]*(?!=)([^\n]*)", re.M)
FUNCTION = re.compile(r"\bfunction\b[^(\n]*\(([^)]*)\)")
BLOCK = re.compile(r"\b(function|do|then|repeat|end|until|elseif)\b")
MEMBER_CALL = re.compile(r"\b([A-Za-z_]\w*)((?:[.:][A-Za-z_]\w*)+)\s*\(")


def _functions(text: str) -> list[tuple[int, int, set[str]]]:
    """Begin, end and parameters of every function body, by matching block words."""
    out, open_blocks = [], []
    for m in BLOCK.finditer(text):
        if m[1] == "function":
            f = FUNCTION.match(text, m.start())
            open_blocks.append((m.start(), {x.strip() for x in f[1].split(",")} if f else set()))
        elif m[1] in ("do", "then", "repeat"):
            open_blocks.append((m.start(), None))
        elif m[1] == "elseif" and open_blocks:
            open_blocks.pop()  # its ``then`` opens the next branch
        elif m[1] in ("end", "until") and open_blocks:
            begin, names = open_blocks.pop()
            if names is not None:
                out.append((begin, m.end(), names))
    return out


def object_calls(text: str) -> Iterator[tuple]:
    """Calls on an object that an export gave: ``local x = exports.res:Api()`` ... ``x.Functions.Name(``.

    All assignments of the name before the call, in functions that hold the call or outside any, must agree on their
    origin; a parameter of that name or a second origin leaves the call ambiguous."""
    functions = _functions(text)

    def holds(at: int, place: int) -> bool:
        return all(b <= place < e for b, e, _ in functions if b <= at < e)

    origins = [(m.start(), m[1], (x[1] or x[3], x[4]) if (x := LUA_EXPORT.match(m[2])) else None) for m in ASSIGNED.finditer(text)]
    known = {name for _, name, origin in origins if origin}
    for m in MEMBER_CALL.finditer(text):
        if m[1] not in known:
            continue
        earlier = [o for at, name, o in origins if name == m[1] and at < m.start() and holds(at, m.start())]
        shadowed = any(b <= m.start() < e and m[1] in names for b, e, names in functions)
        api, line = re.split("[.:]", m[2])[-1], _line(text, m.start())
        if earlier and earlier[-1] and len(set(earlier)) == 1 and not shadowed:
            resource = earlier[0][0]
            operation = OPERATIONS.get(RESOURCE_FRAMEWORK.get(resource, ""), {}).get(api)
            yield "framework_object_call", operation or api, resource, line, False
        elif earlier or shadowed:
            yield "framework_object_call", api, "", line, True


def lua_sites(content: str) -> Iterator[tuple]:
    text = _blank(LUA_STRIP, content)
    for m in LUA_REQUIRE.finditer(text):
        yield "import", m[1] or "", m[3], _line(text, m.start()), False
    for m in LUA_PROVIDE.finditer(text):
        yield "export_definition", m[2], "", _line(text, m.start()), False
    for m in LUA_EXPORT.finditer(text):
        resource = m[1] or m[3]
        yield "export_call", m[4], resource, _line(text, m.start()), False
        operation = OPERATIONS.get(RESOURCE_FRAMEWORK.get(resource, ""), {}).get(m[4])
        if operation:
            yield "framework_call", operation, resource, _line(text, m.start()), False
    yield from object_calls(text)
    for m in LUA_CALL.finditer(text):
        before = text[max(0, m.start() - 12) : m.start()]
        if m[1] in WORDS or m[1] == "exports" or m[1] == "require" or re.search(r"function\s+$", before):
            continue
        kind = SCRIPT_CALLS.get(m[1])
        if kind:
            yield kind, m[3] or "", "", _line(text, m.start()), m[3] is None
        else:
            yield "call", m[1], "", _line(text, m.start()), False


def js_sites(content: str) -> Iterator[tuple]:
    text = _blank(JS_STRIP, content)
    for m in JS_IMPORT.finditer(text):
        yield "import", (m[1] or "").strip(), m[3], _line(text, m.start()), False
    for m in JS_EXPORT.finditer(text):
        yield "export_definition", m[1], "", _line(text, m.start()), False
    yield from _calls(text, r"function\s*\*?\s+$")


def go_sites(content: str) -> Iterator[tuple]:
    text = _blank(JS_STRIP, content)
    for m in GO_IMPORT.finditer(text):
        yield "import", m[1] or "", m[2], _line(text, m.start()), False
    yield from _calls(text, r"func\s+(\([^)]*\)\s*)?$")


def _calls(text: str, declared: str) -> Iterator[tuple]:
    for m in CALL.finditer(text):
        if m[1] not in WORDS and not re.search(declared, text[max(0, m.start() - 60) : m.start()]):
            yield "call", m[1], "", _line(text, m.start()), False


READERS = {"lua": lua_sites, "javascript": js_sites, "typescript": js_sites, "tsx": js_sites, "go": go_sites}


def sites_of(files: DataFrame) -> DataFrame:
    """Sites of (path, content) files, language by extension, in order of lines."""
    names = [c.split()[0] for c in SITES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                m = re.search(r"\.[^./]*$", path)
                reader = READERS.get(LANGUAGES.get(m[0].lower() if m else "", ""))
                if reader:
                    rows += sorted(((path, *s) for s in reader(content or "")), key=lambda r: (r[4], r[1], r[2]))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, SITES)
