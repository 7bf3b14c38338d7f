"""Replacing parts of the facts model: what is left of the old rows, and the new ones, as data frames to be swapped in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.sinks.tables import checked

#: Tokens of the full-text index: runs of letters and digits.
TOKEN = r"[^0-9A-Za-z]+"


def without_repo(rows: DataFrame, repo: str, column: str = "repo") -> DataFrame:
    """Rows of all other repositories."""
    return rows.filter(~F.col(column).eqNullSafe(F.lit(repo)))


def checked_edges(edges: DataFrame, owner: str) -> DataFrame:
    """Fail on edges without id, kind or source, or of another analyzer than the owner."""
    return checked(edges.withColumn("id", F.when(F.col("from_id") != "", F.col("edge_id"))), owner).withColumn("edge_id", F.col("id")).drop("id")


def replaced_edges(edges: DataFrame, analyzer: str, new: DataFrame) -> DataFrame:
    """Edges with those of one analyzer replaced."""
    return edges.filter(F.col("analyzer") != analyzer).unionByName(checked_edges(new, analyzer).select(edges.columns))


def replaced_analyzer(entities: DataFrame, edges: DataFrame, analyzer: str, new_entities: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges with all of one analyzer's replaced; other analyzers' stay."""
    left = entities.filter(F.col("analyzer") != analyzer)
    return left.unionByName(checked(new_entities, analyzer).select(entities.columns)), replaced_edges(edges, analyzer, new_edges)


def of_resource(analyzer: str, resource: str) -> Column:
    path = F.get_json_object("metadata", "$.source_resource_path")
    return (F.col("analyzer") == analyzer) & F.coalesce(path == resource, F.lit(False))


def replaced_resource(entities: DataFrame, edges: DataFrame, analyzer: str, resource: str, new_entities: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with those of one resource (named in the metadata) replaced; edges of the analyzer go with either endpoint."""
    held = of_resource(analyzer, resource)
    gone = entities.filter(held).select("id")
    own = edges.filter(F.col("analyzer") == analyzer)
    for end in ("from_id", "to_id"):
        own = own.join(gone.withColumnRenamed("id", end), end, "left_anti")
    left = edges.filter(F.col("analyzer") != analyzer).unionByName(own.select(edges.columns))
    return entities.filter(~held).unionByName(checked(new_entities, analyzer).select(entities.columns)), left.unionByName(checked_edges(new_edges, analyzer).select(edges.columns))


def proofs_written(entities: DataFrame, proofs: DataFrame) -> DataFrame:
    """Entities with the metadata that proofs (id, metadata) give; a proof that doesn't hit exactly one row fails the job."""
    hits = proofs.join(entities.groupBy("id").agg(F.count(F.lit(1)).alias("_n")), "id", "left").groupBy("id").agg(F.count(F.lit(1)).alias("_p"), F.first("_n").alias("_n"), F.first("metadata").alias("_metadata"))
    sure = F.when((F.col("_p") == 1) & F.col("_n").eqNullSafe(F.lit(1)), F.col("_metadata")).otherwise(F.raise_error(F.lit("a proof must update exactly one entity")).cast("string"))
    out = entities.join(hits.select("id", sure.alias("_metadata")), "id", "full")
    return out.withColumn("metadata", F.coalesce("_metadata", "metadata")).select(entities.columns)


def replaced_state(tables: dict[str, DataFrame], repo: str, new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Workspace tables with all rows of one repository replaced; a table without new rows loses the old ones."""
    return {name: without_repo(df, repo).unionByName(new[name]) if name in new else without_repo(df, repo) for name, df in tables.items()}


def completeness(workspaces: DataFrame, repo: str, discovered: int, indexed: int, truncated: bool) -> DataFrame:
    """Workspaces with one repository's completeness updated."""
    own = F.col("repo") == repo
    values = {"discovered": F.lit(discovered).cast("long"), "indexed": F.lit(indexed).cast("long"), "truncated": F.lit(truncated), "incomplete": F.lit(truncated or discovered != indexed)}
    return workspaces.withColumns({k: F.when(own, v).otherwise(F.col(k)) for k, v in values.items()})


def savings_added(totals: DataFrame, new: DataFrame) -> DataFrame:
    """(tool, calls, saved): counters with new savings (tool, saved) added."""
    more = new.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("saved").alias("saved"))
    return totals.select("tool", "calls", "saved").unionByName(more).groupBy("tool").agg(F.sum("calls").alias("calls"), F.sum("saved").alias("saved"))


def postings(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(token, path): the full-text index of files, each token of a file once."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), TOKEN), lambda x: x != ""))
    return files.select(F.explode(words).alias("token"), F.col(path).alias("path"))


def postings_updated(index: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index after changed files (path, content) and deleted paths: their rows go, those of the new contents come."""
    gone = changed.select("path").unionByName(deleted.select("path")).distinct()
    return index.join(gone, "path", "left_anti").select("token", "path").unionByName(postings(changed))


def shortlist(files: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """Files that hold any token of the query, if the query has no punctuation and any file does; else all files."""
    tokens = query.lower().split()
    if not tokens or not all(t.isalnum() for t in tokens):
        return files
    hits = index.filter(F.col("token").isin(*tokens)).select("path").distinct()
    return files.join(hits, "path", "left_semi") if hits.limit(1).count() else files


def combined(*parts: DataFrame) -> DataFrame:
    """Facts of several analyzers as one table; of equal ids the first analyzer's by name stays."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.min_by(F.struct(*[c for c in out.columns if c != "id"]), "analyzer").alias("_x")).select("id", "_x.*")
