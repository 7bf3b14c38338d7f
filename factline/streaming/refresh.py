"""Incremental refresh of facts: by file, by resource, of what is derived from them; and the watches that drive it.

Each step is a function of the facts at hand and the new ones, so that a micro-batch which comes twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.sinks.facts import replaced_resource
from factline.sinks.tables import checked, without_file

Derive = Callable[[DataFrame], DataFrame]


def refreshed_file(entities: DataFrame, edges: DataFrame, file_path: str, new: DataFrame, derive: Derive, analyzer: str) -> tuple[DataFrame, DataFrame]:
    """One file's entities replaced, then the analyzer's edges derived anew from all its entities; others' edges lose
    those that lost an endpoint."""
    left, kept = without_file(entities, edges, file_path)
    now = left.unionByName(checked(new, analyzer).select(entities.columns))
    own = derive(now.filter(F.col("analyzer") == analyzer)).withColumn("analyzer", F.lit(analyzer))
    return now, kept.filter(F.col("analyzer") != analyzer).select(edges.columns).unionByName(own.select(edges.columns))


def refreshed_resource(entities: DataFrame, edges: DataFrame, health: DataFrame, analyzer: str, resource: str, new: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One resource's entities replaced; without new ones, as its analysis failed, its facts go and it is degraded.

    ``health`` is (resource, degraded)."""
    found = entities.limit(0) if new is None else new
    now, left = replaced_resource(entities, edges, analyzer, resource, found, edges.limit(0))
    state = health.filter(F.col("resource") != resource).unionByName(health.sparkSession.createDataFrame([(resource, new is None)], "resource string, degraded boolean"))
    return now, left, state


def derived_edges(compact: DataFrame) -> DataFrame:
    """Workspace edges from compact facts alone (id, kind, name, side, resource): triggers to handlers of the same name in
    other resources, where the sides fit; a function of the facts, so that a refresh of configurations needs no source."""
    t = compact.filter("kind = 'trigger'").select("name", F.col("id").alias("from_id"), F.col("side").alias("from_side"), F.col("resource").alias("from_resource"))
    h = compact.filter("kind = 'handler'").select("name", F.col("id").alias("to_id"), F.col("side").alias("to_side"), F.col("resource").alias("to_resource"))
    pairs = t.join(h, "name").filter((F.col("from_resource") != F.col("to_resource")) & workspace_side(F.col("from_side"), F.col("to_side")))
    return pairs.select(F.concat_ws(":", F.lit("cross_resource_event"), "from_id", "to_id").alias("edge_id"), "from_id", "to_id", F.lit("cross_resource_event").alias("kind")).distinct()


def workspace_side(wanted: Column, got: Column) -> Column:
    """Across a workspace a target's side must be the one wanted, or shared; an unknown one never fits."""
    return (got == wanted) & (got != "unknown") | (got == "shared")


def workspace_callback(call: Column, made: Column) -> Column:
    """Callbacks are answered on the other side, or by shared code."""
    return ((call == "client") & made.isin("server", "shared")) | ((call == "server") & made.isin("client", "shared"))


def transition(before: Column, now: Column, workspace: str = "workspace") -> Column:
    """What a change of a repository's mode means for its workspace facts."""
    was, will = F.coalesce(before == workspace, F.lit(False)), F.coalesce(now == workspace, F.lit(False))
    return F.when(will & ~was, "entered").when(was & ~will, "exited").when(was & will, "active").otherwise("none")


def saved_watches(saved: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, repo, restored): saved watches (path, repo), restored where the folder still is that repository's."""
    return saved.join(existing.select("path", F.col("repo").alias("_now")), "path", "left").select("path", "repo", F.coalesce(F.col("_now") == F.col("repo"), F.lit(False)).alias("restored"))


def existing_folders(spark, paths: list[str], identify: Callable[[str], str]) -> DataFrame:
    """(path, repo) of those paths that are folders, by the name that each has now."""
    return spark.createDataFrame([(p, identify(p)) for p in paths if Path(p).is_dir()], "path string, repo string")
