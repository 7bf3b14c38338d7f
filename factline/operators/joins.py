"""Joins with the facts model's semantics: intervals, prefixes, unique matches, as-of, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, item: str, points_id: list[str], cell: int = 64) -> DataFrame:
    """For each point the smallest span that holds it; ties go to the first in (start, item) order.

    Spans are dealt to cells of ``cell`` lines and points look in theirs, so the range becomes an equi-join on (keys,
    cell); a span costs as many rows as it has cells.
    """
    in_cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    asked = points.withColumn("_cell", F.floor(F.col(point) / cell))
    hits = asked.join(in_cells, [*keys, "_cell"]).filter(F.col(point).between(F.col(start), F.col(end)))
    best = F.min_by(F.col(item), F.struct(F.col(end) - F.col(start), F.col(start), F.col(item)))
    return hits.groupBy(*keys, *points_id).agg(best.alias(item))


def longest_prefix(paths: DataFrame, owners: DataFrame, path: str, prefix: str, item: str) -> DataFrame:
    """For each path the owner with the longest path at or above it.  Each path is exploded to its parents: an equi-join."""
    parts = F.split(F.col(path), "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hits = paths.withColumn(prefix, F.explode(parents)).join(owners.select(prefix, item), prefix)
    best = F.max_by(F.struct(F.col(prefix), F.col(item)), F.struct(F.length(prefix), F.col(item)))
    return hits.groupBy(path).agg(best.alias("_b")).select(path, F.col(f"_b.{prefix}").alias(prefix), F.col(f"_b.{item}").alias(item))


def only_match(sites: DataFrame, targets: DataFrame, on: list[str], site: str, target: str) -> DataFrame:
    """Every site with its target if there is exactly one, else null, and the number of candidates.

    Targets are counted by key before the join, so a name with many targets doesn't multiply rows."""
    counted = targets.groupBy(*on).agg(F.count(F.lit(1)).alias("candidates"), F.min(target).alias("_one"))
    out = sites.join(counted, on, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return out.withColumn(target, F.when(F.col("candidates") == 1, F.col("_one"))).drop("_one")


def changes(before: DataFrame, after: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(key, status): added, deleted or changed between two snapshots."""
    a, b = before.select(key, F.col(value).alias("_a")), after.select(key, F.col(value).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).filter("status IS NOT NULL")


def only_earlier(later: DataFrame, earlier: DataFrame, keys: list[str], order: str, row: str, item: str) -> DataFrame:
    """Backward match: the single earlier row of a group, unresolved if there is none or more than one.

    A running count and a running minimum over the union of both sides, so no pair is made."""
    from pyspark.sql import Window

    a = earlier.select(*keys, F.col(order), F.lit(0).alias("_side"), F.lit(None).cast("string").alias(row), F.col(item).alias(item))
    b = later.select(*keys, F.col(order), F.lit(1).alias("_side"), F.col(row).cast("string").alias(row), F.lit(None).cast("string").alias(item))
    w = Window.partitionBy(*keys).orderBy(order, "_side", F.coalesce(row, item)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("earlier", F.count(item).over(w)).withColumn("_one", F.min(item).over(w))
    return both.filter("_side = 1").select(*keys, row, "earlier", F.when(F.col("earlier") == 1, F.col("_one")).alias(item))


def sides_fit(caller: Column, provider: Column) -> Column:
    """Exports: client code reaches client and shared, server code server and shared, shared only shared, unknown none."""
    return F.when(caller == "client", provider.isin("client", "shared")).when(caller == "server", provider.isin("server", "shared")).when(caller == "shared", provider == "shared").otherwise(False)


def sides_local(expected: Column, actual: Column) -> Column:
    """Within a resource: equal, or either is shared; unknown fits only unknown."""
    return F.when((expected == "unknown") | (actual == "unknown"), expected == actual).otherwise((expected == actual) | (expected == "shared") | (actual == "shared"))


def sides_callback(call: Column, registration: Column) -> Column:
    """Callbacks cross from client to server or back; shared code registers for both."""
    return F.when(call == "client", registration.isin("server", "shared")).when(call == "server", registration.isin("client", "shared")).otherwise(False)


def authority(registered: Column, fitting: Column, has_registry: Column) -> Column:
    """What stands behind a call, by the entries of its target's name and the providers with a fitting side."""
    known = F.when(registered > 1, "local_ambiguous").when(registered == 1, F.when(fitting == 1, "local_verified").when(fitting > 1, "local_ambiguous").otherwise("local_api_missing"))
    bare = F.when(fitting == 1, "local_verified").when(fitting > 1, "local_ambiguous").otherwise("external_unverified")
    return F.when(has_registry, F.coalesce(known, F.lit("external_unverified"))).otherwise(bare)
