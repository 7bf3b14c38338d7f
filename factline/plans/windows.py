"""Window, top-k and streaming-twin queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factline import corpus
from factline.catalog import query
from factline.operators import relational as rel
from factline.streaming import events


@query("throttle_levels", """SELECT event_id, n::BIGINT AS n, CASE WHEN n <= 3 THEN 'normal' WHEN n <= 8 THEN 'reduced' ELSE 'blocked' END AS level FROM (
    SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999' SECOND PRECEDING AND CURRENT ROW) AS n FROM events)""")
def throttle_levels(spark, d):
    e = corpus.table(spark, d, "events")
    return events.throttled(e, "event_type", "ts", 3600, hard=True).select("event_id", "n", "level")


@query("debounced_batches", """SELECT user_id, min(ts) AS started, count(*)::BIGINT AS n, count(DISTINCT event_type)::BIGINT AS n_paths FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g""")
def debounced_batches(spark, d):
    return events.debounced(corpus.table(spark, d, "events"), ["user_id"], "ts", "2 hours", "event_type").select("user_id", "started", "n", "n_paths")


@query("start_order", "SELECT event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS start_order FROM events")
def start_order(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return corpus.table(spark, d, "events").select("event_id", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(w).alias("start_order"))


@query("truncated_top", "SELECT symbol_id, true AS truncated FROM symbols ORDER BY file_path, line, symbol_id LIMIT 20", "symbols")
def truncated_top(spark, d):
    return rel.bounded(corpus.symbols(spark, d).select("symbol_id", "file_path", "line"), 20, "file_path", "line", "symbol_id").select("symbol_id", "truncated")


@query("ranked_symbols", "SELECT symbol_id FROM symbols ORDER BY CASE WHEN name = 'red widget' THEN 0 WHEN name LIKE 'red%' THEN 1 ELSE 2 END, file_path, line, symbol_id LIMIT 50", "symbols")
def ranked_symbols(spark, d):
    n = F.col("name")
    rank = F.when(n == "red widget", 0).when(n.startswith("red"), 1).otherwise(2)
    return corpus.symbols(spark, d).orderBy(rank, "file_path", "line", "symbol_id").limit(50).select("symbol_id")


@query("adjusted_limits", "SELECT n, greatest(1, n // 2) AS reduced FROM (SELECT unnest([1, 2, 10, 200]) AS n)")
def adjusted_limits(spark, d):
    n = spark.range(1).select(F.explode(F.array(*map(F.lit, (1, 2, 10, 200)))).alias("n"))
    return n.select("n", F.greatest(F.lit(1), F.floor(F.col("n") / 2)).cast("int").alias("reduced"))


@query("event_changes", """SELECT user_id, count(*) FILTER (WHERE k < pk)::BIGINT AS drops FROM (SELECT user_id, json_extract_string(props, '$.k')::INT AS k, lag(json_extract_string(props, '$.k')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS pk FROM events) GROUP BY user_id""")
def event_changes(spark, d):
    e = corpus.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.withColumn("pk", F.lag("k").over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.groupBy("user_id").agg(F.count_if(F.col("k") < F.col("pk")).alias("drops"))


@query("refresh_batches", """SELECT path, arg_max(action, event_id) AS action FROM (SELECT event_id, 'user/' || user_id || '/' || event_type AS path, CASE WHEN value < 20 THEN 'remove' ELSE 'write' END AS action FROM events) GROUP BY path""")
def refresh_batches(spark, d):
    e = corpus.table(spark, d, "events")
    path = F.concat_ws("/", F.lit("user"), F.col("user_id").cast("string"), F.col("event_type"))
    e = e.select("event_id", path.alias("path"), F.when(F.col("value") < 20, "remove").otherwise("write").alias("action"))
    return events.last_actions(e, "path", "action", "event_id")
