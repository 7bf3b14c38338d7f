"""Folders of source files as DataFrames: scan, bounded reads, modes, a facts corpus from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.functions.scalar import language
from factline.sources import predicates


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, most_files: int = 10_000, most_bytes: int = predicates.MOST_BYTES) -> DataFrame:
    """(path, language, content, hash, size_bytes) of the supported files below ``root``, read in parallel.

    Left out are skipped directories, ignored, secret, oversized and binary files; beyond ``most_files`` directories of
    code come first.  Names and sizes filter before contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    path = F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), base, -1)
    files = raw.filter(F.col("length") <= most_bytes).select(path.alias("path"), F.col("length").alias("size_bytes"), "content")
    p = F.col("path")
    files = files.withColumn("language", language(p)).filter((F.col("language") != "") & ~predicates.skipped_dir(p) & ~predicates.skipped_file(p) & ~predicates.secret(p) & ~predicates.ignored(p, ignore or []))
    files = files.filter(~F.contains(F.substring("content", 1, 8192), F.lit(bytearray(b"\0"))))
    files = files.select("path", "language", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("hash"), "size_bytes")
    return predicates.prioritize(files, most_files).drop("rank")


def _text(raw: Column) -> Column:
    """Bytes as text, with marks for what is not UTF-8."""
    return F.make_valid_utf8(raw.cast("string"))


def bounded(content: Column, most: int) -> Column:
    """A text within ``most`` bytes: whole, else its first 60 and last 40 per cent around a note, cut at whole characters."""
    raw = F.encode(content, "utf-8")
    head, tail = most * 6 // 10, most - most * 6 // 10
    # a cut inside a character leaves replacement marks at the edge, which go
    first = F.regexp_replace(_text(F.substring(raw, 1, head)), "�+$", "")
    last = F.regexp_replace(_text(F.substring(raw, -tail, tail)), "^�+", "")
    omitted = (F.octet_length(content) - most).cast("string")
    return F.when(F.octet_length(content) <= most, content).otherwise(F.concat(first, F.lit("\n... ["), omitted, F.lit(" bytes omitted] ...\n"), last))


def byte_range(content: Column, offset: Column, length: Column) -> Column:
    """The text at a byte range, offsets from 0."""
    return _text(F.substring(F.encode(content, "utf-8"), offset.cast("int") + 1, length.cast("int")))


def mode(files: DataFrame, path: str = "path") -> DataFrame:
    """One row: resource if a manifest lies at the root, workspace if manifests lie below it, else generic."""
    name = F.substring_index(path, "/", -1)
    manifest = name.isin("fxmanifest.lua", "__resource.lua")
    at_root = F.bool_or(manifest & ~F.contains(F.col(path), F.lit("/")))
    return files.agg(F.when(at_root, "resource").when(F.bool_or(manifest), "workspace").otherwise("generic").alias("mode"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a JSON corpus, one row a required item."""
    tasks = spark.read.option("multiLine", "true").json(path).select(F.explode("tasks").alias("t")).select("t.*")
    return tasks.select("id", "repo", "category", F.explode_outer("required").alias("item"))
