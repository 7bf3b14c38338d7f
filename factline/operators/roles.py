"""Rules around a plan: roles of entities, task classes after lookup, focus, health, required supports, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.operators.ranking import CRITICAL, has_any, lookup, relevant

#: Roles of kinds, by analyzer; all other kinds are topology.
ROLES = {
    "generic": {"code_symbol": "declaration", "call_site": "usage", "reference_site": "usage"},
    "scripts": dict.fromkeys(
        ("event_trigger", "event_handler", "event_registration", "callback_call", "callback_definition", "export_call", "export_definition", "nui_callback", "command"), "flow_endpoint"
    ),
    "framework": {"framework_operation": "operation", "framework_api_provider": "declaration", "framework_api_call": "usage", "framework_status": "status"},
}
#: Usual and largest numbers of results.
CLAMPS = {"symbols": (10, 200), "text": (20, 200), "semantics": (20, 200), "trace": (50, 200), "tree": (1000, 10_000), "outline": (200, 2000), "directories": (500, 10_000), "resources": (50, 200)}
MOST_DEGRADED = 32
TRACED = ("relationship_trace", "cross_resource")


def role(analyzer: Column, kind: Column) -> Column:
    return lookup(F.concat_ws(":", analyzer, kind), {f"{a}:{k}": r for a, kinds in ROLES.items() for k, r in kinds.items()}, "topology")


def clamped(what: Column, asked: Column) -> Column:
    usual, most = (lookup(what, {k: v[i] for k, v in CLAMPS.items()}, 0) for i in (0, 1))
    return F.least(F.when(asked <= 0, usual).otherwise(asked), most).cast("int")


def adjusted_class(task: Column, confidence: Column, broad: Column, anchors: Column, symbol: Column, strong: Column) -> dict[str, Column]:
    """Class and confidence once it is known how many exact anchors there are, whether one is a symbol, and a strong one."""
    traced, unknown, one = task.isin(*TRACED), task == "broad_unknown", anchors == 1
    found = (
        F.when(broad, "broad_unknown")
        .when(anchors == 0, F.when(traced, task).otherwise("broad_unknown"))
        .when(one & unknown & strong, F.when(symbol, "exact_symbol").otherwise("exact_semantic"))
        .when((anchors > 1) & ~traced, "broad_unknown")
        .otherwise(task)
    )
    sure = (
        F.when(broad, F.when(anchors > 0, "medium").otherwise(confidence))
        .when(anchors == 0, F.when(traced, confidence).otherwise("low"))
        .when(one & unknown, F.when(strong, "high").otherwise("low"))
        .when(one & (task == "exact_symbol") & strong, "high")
        .when((anchors > 1) & ~traced, "low")
        .when((anchors > 1) & (confidence == "high"), "medium")
        .otherwise(confidence)
    )
    return {"class": found, "confidence": sure}


def resolved_focus(asked: DataFrame, resources: DataFrame) -> DataFrame:
    """(focus, state, resource): the one resource whose name or path a focus is; several are ambiguous."""
    names = resources.select("name", F.explode(F.array("name", "resource_path")).alias("focus"), "resource_path").distinct()
    found = names.groupBy("focus").agg(F.count_distinct("resource_path").alias("_n"), F.min("name").alias("_name"))
    out = asked.join(found, "focus", "left")
    state = F.when(F.col("_n") > 1, "ambiguous").when(F.col("_n") == 1, "found").otherwise("not_found")
    return out.select("focus", state.alias("state"), F.when(F.col("_n") == 1, F.col("_name")).alias("resource"))


def sharing(entities: DataFrame) -> DataFrame:
    """Entities with their place among those of their symbol, by analyzer and id."""
    return entities.withColumn("place", F.row_number().over(Window.partitionBy("symbol_id").orderBy("analyzer", "id")))


def required(candidates: DataFrame, direction: Column, anchor: Column) -> DataFrame:
    """Candidates that a package must hold: critical supports that fit the direction, each once, but for the anchor."""
    r = F.col("reasons")
    rows = candidates.dropDuplicates(["candidate"]).filter((F.col("candidate") != anchor) & relevant(r, direction) & has_any(r, CRITICAL))
    return rows.withColumns({"provider": has_any(r, ("framework_provider", "export_provider")), "flow": has_any(r, ("event_peer", "callback_peer"))})


def health(workspaces: DataFrame, statuses: DataFrame) -> DataFrame:
    """(repo, state, degraded, n_degraded) from workspaces (repo, n_files, discovered, indexed, truncated) and the status of
    resources: unknown without files, incomplete before degraded; the first names of failed resources are told."""
    failed = statuses.filter("status = 'failed'").groupBy("repo").agg(F.slice(F.array_sort(F.collect_set("resource")), 1, MOST_DEGRADED).alias("degraded"), F.count_distinct("resource").alias("n_degraded"))
    incomplete = F.col("truncated") | (F.col("discovered") != F.col("indexed"))
    state = F.when(incomplete, "incomplete").when(F.col("n_files") == 0, "unknown").when(F.col("n_degraded") > 0, "degraded").otherwise("complete")
    return workspaces.join(failed, "repo", "left").select("repo", state.alias("state"), "degraded", F.coalesce("n_degraded", F.lit(0)).alias("n_degraded"))
