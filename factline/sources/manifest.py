"""Resource manifests and server configurations: literal directives, discovery of resources, start order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factline.functions.scalar import matches_glob

#: Manifest file names, directives with the kind and side of what they list, commands of a configuration.
MANIFESTS = ("fxmanifest.lua", "__resource.lua")
DIRECTIVES = {
    "fx_version": ("version", ""), "game": ("game", ""), "games": ("game", ""), "ui_page": ("ui_page", "client"),
    "client_script": ("script", "client"), "client_scripts": ("script", "client"),
    "server_script": ("script", "server"), "server_scripts": ("script", "server"),
    "shared_script": ("script", "shared"), "shared_scripts": ("script", "shared"),
    "dependency": ("dependency", ""), "dependencies": ("dependency", ""),
    "export": ("export", "client"), "exports": ("export", "client"),
    "server_export": ("export", "server"), "server_exports": ("export", "server"),
}
COMMANDS = ("ensure", "start", "stop", "restart")
CALL = re.compile(r"\b(" + "|".join(DIRECTIVES) + r")\s*\(?\s*(\{[^}]*\}|\"[^\"\n]*\"|'[^'\n]*')")
LITERAL = re.compile(r"\"([^\"\n]*)\"|'([^'\n]*)'")
COMMENT = re.compile(r"--\[\[.*?\]\]|--[^\n]*", re.S)


def directives(content: str | None) -> list[tuple[str, str, str]]:
    """(kind, side, value) of a manifest, literals only; a script of another resource (``@name/...``) is a dependency."""
    out = []
    for m in CALL.finditer(COMMENT.sub("", content or "")):
        kind, side = DIRECTIVES[m[1]]
        for a, b in LITERAL.findall(m[2]):
            value = a or b
            if kind == "script" and value.startswith("@"):
                out.append(("dependency", "", value[1:].split("/")[0]))
            elif value:
                out.append((kind, side, value))
    return list(dict.fromkeys(out))


def manifest_facts(files: DataFrame) -> DataFrame:
    """(resource_path, kind, side, value) of all manifests among (path, content) files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p.rpartition("/")[0], *d) for p, c in zip(b["path"], b["content"], strict=True) for d in directives(c)]
            yield pd.DataFrame(rows, columns=["resource_path", "kind", "side", "value"])

    found = files.filter(F.substring_index("path", "/", -1).isin(*MANIFESTS)).select("path", "content")
    return found.mapInPandas(run, "resource_path string, kind string, side string, value string")


def resources(files: DataFrame) -> DataFrame:
    """(resource_path, name, group, duplicate): directories with a manifest; ``[x]`` directories above them are groups."""
    dirs = files.filter(F.substring_index("path", "/", -1).isin(*MANIFESTS)).select(F.regexp_replace("path", "/?[^/]*$", "").alias("resource_path")).distinct()
    out = dirs.withColumn("name", F.substring_index("resource_path", "/", -1)).withColumn("group", F.regexp_extract("resource_path", r"\[([^\]/]+)\](?!.*\[)", 1))
    return out.withColumn("duplicate", F.count(F.lit(1)).over(Window.partitionBy("name")) > 1)


def config_commands(files: DataFrame, start: str, depth: int = 8) -> DataFrame:
    """(seq, command, target) of a configuration and those it executes, each file once, in order of execution.

    ``exec`` of a literal file is followed level by level; a file runs where it is first named."""
    lines = files.filter(F.col("path").endswith(".cfg")).select("path", F.posexplode(F.split("content", "\n", -1)).alias("n", "line"))
    clean = F.trim(F.regexp_replace("line", r"(^\s*#|\s//|^\s*//|\s#|;).*$", ""))
    parts = F.split(clean, r"\s+")
    words = lines.withColumn("command", F.lower(parts[0])).withColumn("target", F.regexp_replace(F.get(parts, F.lit(1)), "[\"']", ""))
    words = words.filter(F.col("command").isin(*COMMANDS, "exec") & F.col("target").isNotNull())
    at = files.sparkSession.range(1).select(F.lit(start).alias("path"), F.array().cast("array<int>").alias("order"))
    done, out = at.select("path"), None
    for _ in range(depth):
        here = words.join(at, "path").withColumn("order", F.concat("order", F.array("n")))
        out = here if out is None else out.unionByName(here)
        named = here.filter("command = 'exec'").groupBy(F.col("target").alias("path")).agg(F.min("order").alias("order"))
        at = named.join(done, "path", "left_anti")
        done = done.unionByName(at.select("path"))
    return out.filter("command <> 'exec'").select(F.row_number().over(Window.orderBy("order")).alias("seq"), "command", "target")


def states(commands: DataFrame, known: DataFrame) -> DataFrame:
    """(resource_path, name, state, start_order): the last command wins; names that several resources share stay unknown."""
    last = commands.groupBy(F.col("target").alias("name")).agg(F.max_by("command", "seq").alias("_c"), F.min(F.when(F.col("command") != "stop", F.col("seq"))).alias("start_order"))
    state = F.when(F.col("duplicate"), "unknown").when(F.col("_c") == "stop", "disabled").when(F.col("_c").isNotNull(), "enabled").otherwise("unknown")
    return known.join(last, "name", "left").select("resource_path", "name", state.alias("state"), F.when(~F.col("duplicate"), F.col("start_order")).alias("start_order"))


def classify(paths: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(path, side) by (side, glob) patterns of a manifest: client and server patterns together, or a shared one, are shared."""
    hit = {s: F.lit(False) for s in ("client", "server", "shared")}
    for s, p in patterns:
        hit[s] = hit[s] | matches_glob(F.col("path"), p)
    side = F.when(hit["shared"] | (hit["client"] & hit["server"]), "shared").when(hit["client"], "client").when(hit["server"], "server").otherwise("unknown")
    return paths.withColumn("side", side)
