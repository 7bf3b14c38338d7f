"""Replacing, upserting and deleting facts kept as partitioned Parquet: new rows are computed, a directory is swapped."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All new rows, and the old ones whose key has no new row."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def without_prefix(files: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    p = prefix.rstrip("/")
    return files.filter((F.col(path) != p) & ~F.col(path).startswith(p + "/"))


def without_file(entities: DataFrame, edges: DataFrame, file_path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and edges without one file: edges go with their file or with either endpoint."""
    gone = entities.filter(F.col("file_path") == file_path).select("id")
    left = edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return entities.filter(F.col("file_path") != file_path), left


def checked(entities: DataFrame, owner: Column | str) -> DataFrame:
    """Fail on rows without id or kind, or of another analyzer than the owner."""
    own = F.lit(owner) if isinstance(owner, str) else owner
    bad = F.coalesce(F.col("id"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("kind"), F.lit("")).eqNullSafe("") | ~F.col("analyzer").eqNullSafe(own)
    return entities.withColumn("id", F.when(~bad, F.col("id")).otherwise(F.raise_error(F.lit("entity without id or kind, or of another analyzer")).cast("string")))


def replace_partition(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrite just the partitions that ``df`` has rows of; readers of others see no change."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def swap(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside the old table and swap directories: a failed write or swap leaves the old one."""
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    jvm = spark._jvm
    new, old, spare = (jvm.org.apache.hadoop.fs.Path(x) for x in (fresh, path, fresh + ".old"))
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(fresh)
        if fs.exists(old) and not fs.rename(old, spare):
            raise OSError(f"can't set aside {path}")
        if not fs.rename(new, old):
            raise OSError(f"can't put the new table at {path}")
    except Exception:
        if fs.exists(spare) and not fs.exists(old):
            fs.rename(spare, old)
        fs.delete(new, True)
        raise
    fs.delete(spare, True)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report as a Markdown table; a last line tells if there are more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    more = [f"\nMore than {most} rows; these are the first."] if len(rows) > most else []
    return "\n".join([head, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:most]), *more]) + "\n"


def write_report(df: DataFrame, folder: str, most: int = 1000) -> None:
    """All rows as JSON files below ``folder``/json, and the Markdown table beside them."""
    df.write.mode("overwrite").json(f"{folder}/json")
    text = df.sparkSession.createDataFrame([(markdown(df, most),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")
