"""From sites to edges: imports to files, calls to symbols, events and exports across resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.functions.scalar import dirname, stable_id
from factline.operators.joins import longest_prefix, only_match, sides_callback, sides_fit, sides_local

#: What an import may leave off, in order.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".lua", "/index.ts", "/index.tsx", "/index.js", "/init.lua")


def normalized(path: Column) -> Column:
    """A path without ``.``, with every ``x/..`` taken out; a ``..`` above the root stays."""

    def step(kept: Column, part: Column) -> Column:
        inside = (F.size(kept) > 0) & (F.get(kept, F.size(kept) - 1) != "..")
        up = F.when(inside, F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.concat(kept, F.array(part)))
        return F.when(part.isin("", "."), kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def import_files(sites: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, target, file): relative and dotted imports with the one file that the first fitting suffix names."""
    imports = sites.filter("kind = 'import'").select("path", "line", "target")
    relative = F.col("target").startswith(".")
    stem = F.when(relative, normalized(F.concat(dirname(F.col("path")), F.lit("/"), "target"))).otherwise(F.regexp_replace("target", r"\.(?=\w)", "/"))
    tries = F.array(*[F.struct(F.lit(i).alias("n"), F.concat(stem, F.lit(s)).alias("file")) for i, s in enumerate(SUFFIXES)])
    tried = imports.withColumn("t", F.explode(tries)).select("path", "line", "target", "t.n", "t.file")
    hits = tried.join(files.select(F.col("path").alias("file")).distinct(), "file")
    best = hits.groupBy("path", "line", "target").agg(F.min_by("file", "n").alias("file"))
    return imports.join(best, ["path", "line", "target"], "left")


def call_edges(sites: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, line, name, symbol_id, rule): calls with the one symbol that the first rule with a candidate names.

    Rules in order: a symbol of the same file, one of an imported file, one of the same directory.  A rule with several
    candidates leaves the call unresolved: an edge is drawn only for one."""
    calls = sites.filter("kind = 'call'").select("path", "line", F.substring_index("name", ".", -1).alias("name")).distinct()
    s = symbols.select(F.col("path").alias("file"), "name", "symbol_id")
    near = calls.select("*", F.col("path").alias("file"), F.lit(1).alias("rule"))
    imported = calls.join(imports.filter("file IS NOT NULL").select("path", "file").distinct(), "path").select("path", "line", "name", "file", F.lit(2).alias("rule"))
    direct = near.unionByName(imported).join(s, ["file", "name"])
    beside = calls.withColumn("dir", dirname(F.col("path"))).join(s.withColumn("dir", dirname(F.col("file"))), ["dir", "name"]).filter("file <> path")
    both = direct.select("path", "line", "name", "rule", "symbol_id").unionByName(beside.select("path", "line", "name", F.lit(3).alias("rule"), "symbol_id"))
    counted = both.groupBy("path", "line", "name", "rule").agg(F.count_distinct("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id"))
    first = counted.groupBy("path", "line", "name").agg(F.min_by(F.struct("rule", "n", "symbol_id"), "rule").alias("b"))
    found = first.filter("b.n = 1").select("path", "line", "name", "b.symbol_id", "b.rule")
    return calls.join(found, ["path", "line", "name"], "left")


#: Triggers with the side where their handlers are.
TRIGGER_SIDE = {"event_trigger": "", "server_event_trigger": "server", "client_event_trigger": "client"}


def event_edges(facts: DataFrame) -> DataFrame:
    """Edges from triggers to handlers of the same literal name: (edge_id, name, from_path, to_path, kind).

    Facts: (path, resource_path, side, kind, name, dynamic).  Across sides the name must be registered for the network by
    any code that fits the receiving side; within a side handlers must fit the trigger's.  Dynamic names never match."""
    fixed = facts.filter("NOT dynamic AND name <> ''")
    t = fixed.filter(F.col("kind").isin(*TRIGGER_SIDE)).select("name", F.col("path").alias("from_path"), F.col("side").alias("from_side"), "kind")
    h = fixed.filter("kind = 'event_handler'").select("name", F.col("path").alias("to_path"), F.col("side").alias("to_side"))
    on = lambda side: F.bool_or(F.col("side").isin(side, "shared")).alias(f"on_{side}")
    registered = fixed.filter("kind = 'net_event_registration'").groupBy("name").agg(on("server"), on("client"))
    pairs = t.join(h, "name").join(registered, "name", "left")
    local = (F.col("kind") == "event_trigger") & sides_local(F.col("from_side"), F.col("to_side"))
    remote = (F.col("kind") == "server_event_trigger") & F.col("to_side").isin("server", "shared") & F.col("on_server")
    remote |= (F.col("kind") == "client_event_trigger") & F.col("to_side").isin("client", "shared") & F.col("on_client")
    out = pairs.filter(local | remote).select("name", "from_path", "to_path", "kind").distinct()
    return out.withColumn("edge_id", stable_id("edge", F.col("kind"), F.col("name"), F.col("from_path"), F.col("to_path")))


def callback_edges(facts: DataFrame) -> DataFrame:
    """Edges from callback calls to the definitions of the same literal name on the other side: (name, from_path, to_path)."""
    fixed = facts.filter("NOT dynamic AND name <> ''")
    calls = fixed.filter("kind = 'callback_call'").select("name", F.col("path").alias("from_path"), F.col("side").alias("from_side"))
    made = fixed.filter("kind = 'callback_definition'").select("name", F.col("path").alias("to_path"), F.col("side").alias("to_side"))
    return calls.join(made, "name").filter(sides_callback(F.col("from_side"), F.col("to_side"))).select("name", "from_path", "to_path").distinct()


def export_edges(facts: DataFrame, resources: DataFrame) -> DataFrame:
    """Export calls with their resource and providers: (path, line, name, target, resource_path, providers, status).

    The target's name must be one resource's; then definitions of that name in it with a fitting side count."""
    calls = facts.filter("kind = 'export_call'").select("path", "line", "name", "target", F.col("side").alias("caller"))
    named = only_match(calls.withColumnRenamed("target", "resource"), resources.select(F.col("name").alias("resource"), "resource_path"), ["resource"], "path", "resource_path")
    defined = facts.filter("kind = 'export_definition'").select(F.col("resource_path"), "name", F.col("side").alias("provider"))
    sides = defined.withColumn("caller", F.explode(F.array(*map(F.lit, ("client", "server", "shared"))))).filter(sides_fit(F.col("caller"), F.col("provider")))
    fitting = sides.groupBy("resource_path", "name", "caller").agg(F.count(F.lit(1)).alias("providers"))
    out = named.join(fitting, ["resource_path", "name", "caller"], "left").withColumn("providers", F.coalesce("providers", F.lit(0)))
    status = (
        F.when(F.col("candidates") > 1, "local_ambiguous")
        .when(F.col("candidates") == 0, "external_unverified")
        .when(F.col("providers") == 1, "local_verified")
        .when(F.col("providers") > 1, "local_ambiguous")
        .otherwise("local_api_missing")
    )
    return out.select("path", "line", "name", F.col("resource").alias("target"), "resource_path", "providers", status.alias("status"))


def owned(facts: DataFrame, resources: DataFrame) -> DataFrame:
    """Facts with the resource that holds their file, the longest path winning."""
    owner = longest_prefix(facts.select("path").distinct(), resources, "path", "resource_path", "name").select("path", "resource_path")
    return facts.join(owner, "path", "left")
