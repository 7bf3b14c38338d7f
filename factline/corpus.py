"""The driver's tables seen as a facts model: files, lines, symbols, entities, edges, resources, snapshots, calls.

Every projection exists twice, as a DataFrame and as the SQL of a common table expression, so that each query has a twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", F.col("source").alias("repo"), path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    file_path = F.concat_ws("/", "p_brand", "p_type")
    return p.select(
        F.concat(file_path, F.lit("::"), F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")).alias("symbol_id"),
        file_path.alias("file_path"),
        F.col("p_name").alias("name"),
        F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"),
        F.lower("p_type").alias("kind"),
        F.col("p_brand").alias("language"),
        F.col("p_partkey").alias("line"),
        (F.col("p_partkey") + F.col("p_size")).alias("end_line"),
        F.concat(F.col("p_name"), F.lit(" of size "), F.col("p_size").cast("string")).alias("signature"),
        F.concat(F.lower("p_type"), F.lit(" "), F.col("p_name")).alias("summary"),
        F.split("p_name", " ").alias("keywords"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Made of "), "p_name")).alias("docstring"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    e = table(spark, sf_dir, "events")
    text = lambda x: F.col(x).cast("string")
    of_customers = c.select(
        F.concat(F.lit("c"), text("c_custkey")).alias("id"),
        F.lit("customer").alias("analyzer"),
        F.lower("c_mktsegment").alias("kind"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("nation/"), text("c_nationkey")).alias("file_path"),
        F.col("c_custkey").alias("line"),
        F.lit("{}").alias("metadata"),
    )
    of_events = e.select(
        F.concat(F.lit("e"), text("event_id")).alias("id"),
        F.lit("event").alias("analyzer"),
        F.col("event_type").alias("kind"),
        F.concat(F.col("event_type"), F.lit("_"), text("user_id")).alias("name"),
        F.concat(F.lit("user/"), text("user_id")).alias("file_path"),
        F.col("event_id").alias("line"),
        F.col("props").alias("metadata"),
    )
    return of_customers.unionByName(of_events)


#: Edge tables: name, prefix and key of both ends, kind, whether lines tell of doubt.
EDGE_TABLES = (
    ("nation", "r", "n_regionkey", "n", "n_nationkey", "defines", False),
    ("customer", "n", "c_nationkey", "c", "c_custkey", "registers", False),
    ("orders", "c", "o_custkey", "o", "o_orderkey", "calls", False),
    ("lineitem", "o", "l_orderkey", "p", "l_partkey", "references", True),
    ("lineitem", "p", "l_partkey", "s", "l_suppkey", "imports", True),
)
NODE_TABLES = {"r": ("region", "r_regionkey"), "n": ("nation", "n_nationkey"), "c": ("customer", "c_custkey"), "o": ("orders", "o_orderkey"), "p": ("part", "p_partkey"), "s": ("supplier", "s_suppkey")}


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge per id: the surest, a static one first."""
    return merged(edge_rows(spark, sf_dir))


def merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("edge_id", "from_id", "to_id", "kind").agg(F.bool_and("dynamic").alias("dynamic"), F.max("confidence").alias("confidence"))


def edge_rows(spark: SparkSession, sf_dir: str, ids: list[str] | None = None, direction: str = "both") -> DataFrame:
    """Edges as they are found, an id perhaps several times; with ``ids`` those at these nodes, by their keys in the scan."""
    out = None
    for name, a, from_key, b, to_key, kind, doubt in EDGE_TABLES:
        df = table(spark, sf_dir, name)
        if ids is not None:
            keys = {p: [int(i[1:]) for i in ids if i[0] == p] for p in (a, b)}
            near = F.lit(False)
            if direction != "incoming" and keys[a]:
                near = near | F.col(from_key).isin(*keys[a])
            if direction != "outgoing" and keys[b]:
                near = near | F.col(to_key).isin(*keys[b])
            df = df.filter(near)
        key = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
        dynamic, confidence = (F.col("l_returnflag") == "R", F.round(1 - F.col("l_discount"), 2)) if doubt else (F.lit(False), F.lit(1.0))
        df = df.select(key(a, from_key).alias("from_id"), key(b, to_key).alias("to_id"), F.lit(kind).alias("kind"), dynamic.alias("dynamic"), confidence.alias("confidence"))
        df = df.withColumn("edge_id", F.concat_ws(":", "kind", "from_id", "to_id"))
        out = df if out is None else out.unionByName(df)
    return out


def edges_at(spark: SparkSession, sf_dir: str):
    """A function of (ids, direction) to the merged edges at these nodes that have both endpoints."""

    def run(ids: list[str], direction: str) -> DataFrame:
        found = merged(edge_rows(spark, sf_dir, ids, direction))
        nodes = None
        for prefix, (name, key) in NODE_TABLES.items():
            n = table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"))
            nodes = n if nodes is None else nodes.unionByName(n)
        return found.join(nodes.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(nodes.withColumnRenamed("id", "to_id"), "to_id", "left_semi")

    return run


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    return joined.select(F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")).alias("resource_path"), F.col("n_name").alias("name"), (F.col("s_suppkey") % 3 == 0).alias("enabled"), F.col("s_acctbal").alias("weight"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = files(spark, sf_dir)
    v1 = f.filter("doc_id % 10 <> 0").select("path", F.sha2("content", 256).alias("hash"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("content"), F.lit("!"))).otherwise(F.col("content"))
    v2 = f.filter("doc_id % 10 <> 1").select("path", F.sha2(changed, 256).alias("hash"))
    return v1, v2


SQL = {
    "files": "files AS (SELECT doc_id, source AS repo, lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, lang AS language, text AS content FROM documents)",
    "symbols": """symbols AS (SELECT p_brand || '/' || p_type || '::' || p_name || '#' || p_partkey AS symbol_id, p_brand || '/' || p_type AS file_path,
        p_name AS name, p_brand || '.' || p_name AS qualified_name, lower(p_type) AS kind, p_brand AS language, p_partkey AS line,
        p_partkey + p_size AS end_line, p_name || ' of size ' || p_size AS signature, lower(p_type) || ' ' || p_name AS summary,
        string_split(p_name, ' ') AS keywords, CASE WHEN p_size % 2 = 0 THEN 'Made of ' || p_name END AS docstring FROM part)""",
    "entities": """entities AS (SELECT 'c' || c_custkey AS id, 'customer' AS analyzer, lower(c_mktsegment) AS kind, c_name AS name,
        'nation/' || c_nationkey AS file_path, c_custkey AS line, '{}' AS metadata FROM customer
        UNION ALL SELECT 'e' || event_id, 'event', event_type, event_type || '_' || user_id, 'user/' || user_id, event_id, props FROM events)""",
    "edges": """raw_edges AS (SELECT 'r' || n_regionkey AS from_id, 'n' || n_nationkey AS to_id, 'defines' AS kind, false AS dynamic, 1.0::DOUBLE AS confidence FROM nation
        UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'registers', false, 1.0 FROM customer
        UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'calls', false, 1.0 FROM orders
        UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'references', l_returnflag = 'R', round(1 - l_discount, 2) FROM lineitem
        UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'imports', l_returnflag = 'R', round(1 - l_discount, 2) FROM lineitem),
        edges AS (SELECT kind || ':' || from_id || ':' || to_id AS edge_id, from_id, to_id, kind, bool_and(dynamic) AS dynamic, max(confidence) AS confidence
        FROM raw_edges GROUP BY ALL)""",
    "resources": "resources AS (SELECT 's/' || s_suppkey AS resource_path, n_name AS name, s_suppkey % 3 = 0 AS enabled, s_acctbal AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "snapshots": """v1 AS (SELECT path, sha256(content) AS hash FROM files WHERE doc_id % 10 <> 0),
        v2 AS (SELECT path, sha256(CASE WHEN doc_id % 7 = 0 THEN content || '!' ELSE content END) AS hash FROM files WHERE doc_id % 10 <> 1)""",
}
