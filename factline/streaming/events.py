"""Debounce, rate limits and incremental refresh: the same functions on batches and on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Calls in a window that are served in full, and served in part under hard limits.
NORMAL, REDUCED = 3, 8


def level(n, hard: bool):
    if hard:
        return F.when(n <= NORMAL, "normal").when(n <= REDUCED, "reduced").otherwise("blocked")
    return F.when(n <= NORMAL, "normal").otherwise("warned")


def throttled(calls: DataFrame, key: str, ts: str, seconds: int = 60, hard: bool = False) -> DataFrame:
    """Calls in the window that ends with each call; one exactly ``seconds`` old is out.  A batch twin of ``throttle_stream``.

    Windows are found within time cells and the cell before, so a busy key is many tasks: each call counts those of its
    cell up to it, and those of the cell before that are young enough."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    rows = calls.withColumn("_t", micros).withColumn("_cell", F.floor(F.col("_t") / span))
    # a call is also a witness in the next cell, where it counts but isn't counted for
    both = rows.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_at", F.col("_cell") + F.when(F.col("_own"), 0).otherwise(1))
    w = Window.partitionBy(key, "_at").orderBy("_t").rangeBetween(-(span - 1), 0)
    out = both.withColumn("n", F.count(F.lit(1)).over(w)).filter("_own")
    return out.withColumn("level", level(F.col("n"), hard)).drop("_t", "_cell", "_own", "_at")


def debounced(changes: DataFrame, keys: list[str], ts: str, gap: str = "500 milliseconds", path: str = "path") -> DataFrame:
    """Batches that close when no event came for ``gap``: session windows, on a batch or (with a watermark) a stream."""
    micros = f"{gap} 1 microsecond" if " " in gap and gap.split()[-1] != "microsecond" else gap
    g = changes.groupBy(*keys, F.session_window(ts, micros))
    paths = F.size(F.collect_set(path)).cast("long") if changes.isStreaming else F.count_distinct(path)
    return g.agg(F.count(F.lit(1)).alias("n"), paths.alias("n_paths")).withColumn("started", F.col("session_window.start"))


def last_actions(events: DataFrame, path: str, action: str, order: str) -> DataFrame:
    return events.groupBy(path).agg(F.max_by(action, order).alias(action))


def throttle_stream(calls: DataFrame, key: str, ts: str, seconds: int = 60, hard: bool = False) -> DataFrame:
    """(key, ts, n, level) of a stream of calls: each key keeps the times of its window alone."""
    kind = dict(calls.dtypes)[key]

    def run(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for t in sorted(x for b in batches for x in b[ts]):
            now = t.value // 1000
            held = [x for x in held if x > now - seconds * 1_000_000] + [now]
            n = len(held)
            word = "normal" if n <= NORMAL else "warned" if not hard else "reduced" if n <= REDUCED else "blocked"
            out.append((name[0], t, n, word))
        state.update((held,))
        yield pd.DataFrame(out, columns=[key, ts, "n", "level"])

    return calls.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} timestamp, n long, level string", "held array<long>", "append", "NoTimeout")


def refresh(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, name: str = "refresh") -> StreamingQuery:
    """Run ``apply`` on each micro-batch of all events at hand; it must be idempotent, as a batch can come twice."""
    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def watches(spark) -> list[tuple[str, bool]]:
    return [(q.name, q.isActive) for q in spark.streams.active]


def unwatch(spark, name: str) -> bool:
    found = [q for q in spark.streams.active if q.name == name]
    for q in found:
        q.stop()
    return bool(found)
