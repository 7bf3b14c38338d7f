"""Filters, lookups, bounded lists, outlines and histograms over facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.functions.scalar import dirname


def bounded(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows in a total order, with ``truncated``: whether there were more; k + 1 rows are fetched."""
    first = df.orderBy(*order).limit(k + 1)
    place = Window.orderBy(*order)
    counted = first.withColumn("_n", F.row_number().over(place)).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > k)
    return counted.filter(F.col("_n") <= k).drop("_n")


def search_entities(entities: DataFrame, text: str = "", kind: str = "", analyzer: str = "", path: str = "", value: str = "", hidden: tuple[str, ...] = ()) -> DataFrame:
    """Optional filters, all literal: name contains, kind, analyzer (else all but hidden ones), a JSON path's value."""
    out = entities
    if text:
        out = out.filter(F.lower("name").contains(text.lower()))
    if kind:
        out = out.filter(F.col("kind") == kind)
    if analyzer:
        out = out.filter(F.col("analyzer") == analyzer)
    elif hidden:
        out = out.filter(~F.col("analyzer").isin(*hidden))
    if path:
        out = out.filter(F.get_json_object("metadata", path) == value)
    return out


def exact_symbols(symbols: DataFrame, wanted: str, file_path: str = "") -> DataFrame:
    out = symbols.filter((F.col("name") == wanted) | (F.col("qualified_name") == wanted))
    return out.filter(F.col("file_path") == file_path) if file_path else out


def unique_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key no other row has: anything ambiguous stays unresolved."""
    alone = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    return df.join(alone, list(keys), "left_semi")


def resolve_suffix(names: DataFrame, wanted: str, column: str = "repo") -> DataFrame:
    """The exact name; else names that end in it after "/" or "-", if there is just one."""
    c = F.col(column)
    hits = names.filter((c == wanted) | c.endswith("/" + wanted) | c.endswith("-" + wanted)).withColumn("_exact", (c == wanted).cast("int"))
    w = Window.partitionBy()
    return hits.withColumn("_best", F.max("_exact").over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).filter("_exact = 1 OR (_best = 0 AND _n = 1)").drop("_exact", "_best", "_n")


def per_group(df: DataFrame, keys: list[str], most: int, *order: Column | str) -> DataFrame:
    """At most ``most`` rows a group in order, with ``group_truncated``."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("group_truncated", F.count(F.lit(1)).over(w) > most).filter(F.col("_n") <= most).drop("_n")


def fair_share(df: DataFrame, key: str, per_file: int, total: int, *order: Column | str) -> DataFrame:
    """As ``per_group``, where the cap is also the total divided by the number of groups."""
    groups = df.select(key).distinct().agg(F.greatest(F.lit(1), F.least(F.lit(per_file), F.floor(F.lit(total) / F.greatest(F.count(F.lit(1)), F.lit(1))))).alias("_cap"))
    w = Window.partitionBy(key)
    out = df.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.count(F.lit(1)).over(w))
    out = out.crossJoin(F.broadcast(groups))  # one row
    return out.filter("_n <= _cap").withColumn("group_truncated", F.col("_all") > F.col("_cap")).drop("_n", "_all", "_cap")


def ordinals(df: DataFrame, key: str, *order: Column | str, into: str = "unique_id") -> DataFrame:
    """Repeated ids get ``~1``, ``~2``, ... in order; single ones stay."""
    w = Window.partitionBy(key)
    n = F.row_number().over(w.orderBy(*order)).cast("string")
    return df.withColumn(into, F.when(F.count(F.lit(1)).over(w) > 1, F.concat(F.col(key), F.lit("~"), n)).otherwise(F.col(key)))


def directories(files: DataFrame, path: str = "path") -> DataFrame:
    return files.groupBy(dirname(F.col(path)).alias("directory")).agg(F.count(F.lit(1)).alias("n_files"))


def tree(files: DataFrame, counts: DataFrame, prefix: str = "", depth: int = 3, path: str = "path") -> DataFrame:
    """Nodes of a file tree down to ``depth``: every directory and file with numbers of files and symbols below."""
    rows = files.select(F.col(path).alias("path"))
    if prefix:
        rows = rows.filter((F.col("path") == prefix) | F.col("path").startswith(prefix.rstrip("/") + "/"))
    rows = rows.join(counts, "path", "left").withColumn("n", F.coalesce("n_symbols", F.lit(0)))
    parts = F.split("path", "/")
    levels = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("node"), (i < F.size(parts)).alias("directory")))
    return rows.select("n", F.explode(levels).alias("l")).groupBy("l.node", "l.depth", "l.directory").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_symbols"))
