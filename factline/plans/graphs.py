"""Traversal queries over the edge table."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline import corpus
from factline.catalog import query
from factline.operators import graph

CLASS = """CASE WHEN kind = 'calls' THEN 0 WHEN kind IN ('triggers', 'handles', 'registers', 'uses_export', 'defines') THEN 1 WHEN kind = 'references' THEN 2 WHEN kind = 'imports' THEN 3 ELSE 4 END"""
ENDS = {"outgoing": [("from_id", "to_id")], "incoming": [("to_id", "from_id")], "both": [("from_id", "to_id"), ("to_id", "from_id")]}


def walk_sql(start: str, depth: int, direction: str, k: int, kinds: str = "", ranked: bool = False) -> str:
    """A bounded walk level by level: nodes in the order they are met, k + 1 edges in all, the first k shown."""
    order = f"{CLASS}, dynamic::INT, confidence DESC, edge_id" if ranked else "edge_id"
    where = f" WHERE kind IN ({kinds})" if kinds else ""
    ways = " UNION ALL ".join(f"SELECT *, {near} AS near, {far} AS far FROM edges{where}" for near, far in ENDS[direction])
    parts, done = [f"ways AS ({ways})", f"f0 AS (SELECT '{start}' AS node, 1 AS pos)"], "SELECT node FROM f0"
    for n in range(1, depth + 1):
        parts.append(f"s{n} AS (SELECT w.*, {n} AS depth, row_number() OVER (ORDER BY f.pos, {order}) AS n FROM ways w JOIN f{n - 1} f ON w.near = f.node QUALIFY n <= {k + 1})")
        parts.append(f"f{n} AS (SELECT far AS node, min(n) AS pos FROM s{n} WHERE far NOT IN ({done}) GROUP BY far)")
        done += f" UNION ALL SELECT node FROM f{n}"
    union = " UNION ALL ".join(f"SELECT * FROM s{n}" for n in range(1, depth + 1))
    parts.append(f"met AS (SELECT *, row_number() OVER (ORDER BY depth, n) AS place, count(*) OVER () > {k} AS truncated FROM ({union}))")
    return f"WITH {', '.join(parts)}, found AS (SELECT edge_id, from_id, to_id, kind, depth::INT AS depth, place::INT AS place, truncated FROM met WHERE place <= {k}) "


SHOWN = ["edge_id", "kind", "depth", "place", "truncated"]


@query("trace_outgoing", walk_sql("o5", 2, "outgoing", 50) + "SELECT edge_id, kind, depth, place, truncated FROM found", "edges")
def trace_outgoing(spark, d):
    return graph.walk(corpus.edges_at(spark, d), ["o5"], 2).select(*SHOWN)


@query("trace_incoming", walk_sql("p7", 3, "incoming", 200) + "SELECT edge_id, kind, depth, place, truncated FROM found", "edges")
def trace_incoming(spark, d):
    return graph.walk(corpus.edges_at(spark, d), ["p7"], 3, "incoming", (), 200).select(*SHOWN)


@query("trace_both", walk_sql("c3", 2, "both", 50, "'calls', 'registers'") + "SELECT edge_id, kind, depth, place, truncated FROM found", "edges")
def trace_both(spark, d):
    """A customer's nation is a hub: the walk is cut at 50 edges and says so."""
    return graph.walk(corpus.edges_at(spark, d), ["c3"], 2, "both", ("calls", "registers"), 50).select(*SHOWN)


@query("ranked_trace", walk_sql("c9", 3, "outgoing", 25, ranked=True) + "SELECT edge_id, kind, depth, place, truncated FROM found", "edges")
def ranked_trace(spark, d):
    return graph.walk(corpus.edges_at(spark, d), ["c9"], 3, "outgoing", (), 25, True).select(*SHOWN)


@query("impact_analysis", walk_sql("p11", 2, "incoming", 200, "'calls', 'references'", True) + """SELECT count(*) FILTER (WHERE depth = 1)::BIGINT AS n_direct, count(*) FILTER (WHERE depth > 1)::BIGINT AS n_transitive,
    count(DISTINCT from_id)::BIGINT AS n_sources, coalesce(bool_or(truncated), false) AS truncated FROM found""", "edges")
def impact_analysis(spark, d):
    """Calls and references into a node, direct and transitive."""
    e = graph.walk(corpus.edges_at(spark, d), ["p11"], 2, "incoming", ("calls", "references"), 200, True)
    return e.agg(F.count_if(F.col("depth") == 1).alias("n_direct"), F.count_if(F.col("depth") > 1).alias("n_transitive"), F.count_distinct("from_id").alias("n_sources"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"))


@query("hydrated_edges", "SELECT e.edge_id, c.c_name AS to_name, n.n_name AS from_name FROM edges e JOIN customer c ON e.to_id = 'c' || c.c_custkey JOIN nation n ON e.from_id = 'n' || n.n_nationkey", "edges")
def hydrated_edges(spark, d):
    e = corpus.edges(spark, d).filter("kind = 'registers'")
    c = corpus.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("to_id"), F.col("c_name").alias("to_name"))
    n = corpus.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("from_id"), F.col("n_name").alias("from_name"))
    return e.join(c, "to_id").join(n, "from_id").select("edge_id", "to_name", "from_name")


@query("multi_seed_expansion", f"""WITH ways AS (SELECT *, from_id AS near, to_id AS far FROM edges UNION ALL SELECT *, to_id, from_id FROM edges),
    f0 AS (SELECT 'c' || c_custkey AS node, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS seed, 1 AS pos FROM customer QUALIFY seed < 32),
    s1 AS (SELECT w.*, seed, 1 AS depth, row_number() OVER (PARTITION BY seed ORDER BY {CLASS}, dynamic::INT, confidence DESC, edge_id) AS n FROM ways w JOIN f0 ON near = node QUALIFY n <= 101),
    f1 AS (SELECT seed, far AS node, min(n) AS pos FROM s1 WHERE far NOT IN (SELECT node FROM f0 WHERE f0.seed = s1.seed) GROUP BY seed, far),
    s2 AS (SELECT w.*, seed, 2 AS depth, row_number() OVER (PARTITION BY seed ORDER BY pos, {CLASS}, dynamic::INT, confidence DESC, edge_id) AS n FROM ways w JOIN f1 ON near = node QUALIFY n <= 101),
    a AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, n) AS place FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) QUALIFY place <= 100)
    SELECT seed::INT AS seed, place::INT AS place, edge_id, depth::INT AS depth FROM a ORDER BY seed, place LIMIT 256""", "edges")
def multi_seed_expansion(spark, d):
    """From the 32 customers of most credit, two steps both ways, until 256 edges are met."""
    best = corpus.table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(graph.MOST_SEEDS).select("c_custkey").collect()
    return graph.expanded(corpus.edges_at(spark, d), [f"c{r[0]}" for r in best], 2, "both").select("seed", "place", "edge_id", "depth")


@query("symbol_forest", """SELECT n_name AS node, 1 AS depth, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 0, r_name FROM region
    UNION ALL SELECT c_name, 2, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def symbol_forest(spark, d):
    """A forest flattened with depths, level by level."""
    t = lambda n: corpus.table(spark, d, n)
    roots = t("region").select(F.col("r_name").alias("node"), F.lit(0).alias("depth"), F.col("r_name").alias("path"), F.col("r_regionkey").alias("key"))
    n = t("nation").join(roots.select("path", "key"), F.col("n_regionkey") == F.col("key"))
    inner = n.select(F.col("n_name").alias("node"), F.lit(1).alias("depth"), F.concat_ws("/", "path", "n_name").alias("path"), F.col("n_nationkey").alias("key"))
    leaves = t("customer").join(inner.select("path", "key"), F.col("c_nationkey") == F.col("key"))
    leaves = leaves.select(F.col("c_name").alias("node"), F.lit(2).alias("depth"), F.concat_ws("/", "path", "c_name").alias("path"))
    return roots.drop("key").unionByName(inner.drop("key")).unionByName(leaves)
