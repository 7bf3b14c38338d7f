"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"
#: Folders made for local sessions that name none, as in tests, by application.
_OWN: dict[str, str] = {}
#: Where tables that ``cut`` made lie, and those made within each open ``scope``.
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SCOPES: list[list[tuple[SparkSession, str]]] = []
#: Narrow rows in a file, where their number is known beforehand.
FILE_ROWS = 1 << 17
#: Where the shared folder is a local or mounted one, tables are written without checksum files: without its native
#: library Hadoop launches ``chmod`` for each of those too, and a launch counts as large as its executor until it runs.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session may name none and gets one of its own."""
    found = spark.conf.get(SHARED, None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SHARED} must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="factline-")
    return _OWN[app]


def cut(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs a reread.

    Where ``df`` is known to have ``most`` rows or fewer, all narrow, they go to as few files as keep every core busy."""
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-most // FILE_ROWS)))
    path = f"{shared_dir(spark).rstrip('/')}/factline/{name}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN).option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    for made in _SCOPES[-1:]:
        made.append((spark, path))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``cut`` made and that nothing reads any more."""
    path = _PLACES.pop(df, None)
    if path is not None:
        _delete(df.sparkSession, path)


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Delete the tables cut within it, but for those of the data frames put in the list that it yields."""
    keep: list[DataFrame] = []
    _SCOPES.append([])
    try:
        yield keep
    finally:
        kept = {_PLACES.get(df) for df in keep}
        for spark, path in _SCOPES.pop():
            if path not in kept:
                _delete(spark, path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session while the tables within are written; those before come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
