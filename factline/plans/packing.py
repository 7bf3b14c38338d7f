"""Packing and sufficiency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline import corpus
from factline.catalog import query
from factline.operators import packing
from factline.plans.planning import EVIDENCE_SQL, SCORED_SQL, TIER_SQL, candidates


def requests(spark, d):
    """Orders as requests; their lines as candidates with a stage, a score and an estimate of tokens."""
    l = corpus.table(spark, d, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("request"),
        (F.col("l_orderkey") % 7 * 1000 + 512).cast("long").alias("budget"),
        F.concat_ws("-", F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("candidate"),
        (F.col("l_partkey") % 4).cast("int").alias("stage"),
        (F.col("l_partkey") % 3).cast("int").alias("support"),
        F.floor(F.col("l_quantity") * 100).cast("long").alias("score"),
        packing.estimate((F.col("l_suppkey") % 5 * 700).cast("long"), F.col("l_linenumber").cast("long")).alias("tokens"),
    )


@query("token_estimates", """SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_suppkey % 5 * 700 > 0 THEN ceil(l_suppkey % 5 * 700 / 4.0)::BIGINT + 24 WHEN l_linenumber > 0 THEN l_linenumber * 5 + 24 ELSE 128 END::BIGINT AS tokens FROM lineitem""")
def token_estimates(spark, d):
    l = corpus.table(spark, d, "lineitem")
    return l.select("l_orderkey", "l_linenumber", "l_suppkey", packing.estimate((F.col("l_suppkey") % 5 * 700).cast("long"), F.col("l_linenumber").cast("long")).alias("tokens"))


@query("metadata_reserves", "SELECT DISTINCT l_orderkey % 7 * 1000 + 512 AS budget, least(greatest((l_orderkey % 7 * 1000 + 512) // 20, 256), 1024)::BIGINT AS reserve FROM lineitem")
def metadata_reserves(spark, d):
    return requests(spark, d).select("budget", packing.metadata_reserve(F.col("budget")).alias("reserve")).distinct()


PACK_SQL = """WITH RECURSIVE q AS (SELECT l_orderkey AS request, l_orderkey % 7 * 1000 + 512 AS budget, lpad(l_linenumber::VARCHAR, 2, '0') || '-' || lpad(l_partkey::VARCHAR, 8, '0') || '-' || lpad(l_suppkey::VARCHAR, 6, '0') AS candidate, (l_partkey % 4)::INT AS stage, (l_partkey % 3)::INT AS support,
    floor(l_quantity * 100)::BIGINT AS score, CASE WHEN l_suppkey % 5 * 700 > 0 THEN ceil(l_suppkey % 5 * 700 / 4.0)::BIGINT + 24 WHEN l_linenumber > 0 THEN l_linenumber * 5 + 24 ELSE 128 END::BIGINT AS tokens FROM lineitem),
  o AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY stage, CASE stage WHEN 1 THEN support ELSE 0 END, CASE WHEN stage > 0 THEN score / tokens::DOUBLE ELSE 0 END DESC, score DESC, tokens, candidate) AS place, budget - least(greatest(budget // 20, 256), 1024) AS room FROM q),
  p AS (SELECT request, place, candidate, stage, room - 0 >= 24 AND tokens <= room AS taken, CASE WHEN room >= 24 AND tokens <= room THEN tokens ELSE 0 END AS used FROM o WHERE place = 1
    UNION ALL SELECT o.request, o.place, o.candidate, o.stage, room - p.used >= 24 AND tokens <= room - p.used, p.used + CASE WHEN room - p.used >= 24 AND tokens <= room - p.used THEN tokens ELSE 0 END FROM p JOIN o ON o.request = p.request AND o.place = p.place + 1)
  SELECT request, place::INT AS place, candidate, stage, taken, used::BIGINT AS used FROM p"""


@query("assemble_context", PACK_SQL)
def assemble_context(spark, d):
    return packing.pack(requests(spark, d))


@query("batch_under_ceiling", """WITH RECURSIVE o AS (SELECT l_orderkey AS request, l_linenumber AS n, l_suppkey AS s, (l_suppkey % 9 * 100)::BIGINT AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_suppkey % 9 * 100) AS r FROM lineitem),
  p AS (SELECT request, n, s, size, r, CASE WHEN size <= 1000 THEN size ELSE 0 END AS used, size <= 1000 AS taken FROM o WHERE r = 1 UNION ALL
    SELECT o.request, o.n, o.s, o.size, o.r, p.used + CASE WHEN p.used + o.size <= 1000 THEN o.size ELSE 0 END, p.used + o.size <= 1000 FROM p JOIN o ON o.request = p.request AND o.r = p.r + 1)
  SELECT request, n, s, size FROM p WHERE taken""")
def batch_under_ceiling(spark, d):
    l = corpus.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), (F.col("l_suppkey") % 9 * 100).cast("long").alias("size"))
    return packing.fits_skipping(l, "request", ["n", "s"], "size", 1000).select("request", "n", "s", "size")


@query("outline_text", "SELECT file_path, string_agg(line || '-' || end_line || ' ' || kind || ' ' || qualified_name || ': ' || signature, chr(10) ORDER BY line, symbol_id) AS outline FROM symbols GROUP BY file_path", "symbols")
def outline_text(spark, d):
    row = F.concat(F.col("line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(" "), "kind", F.lit(" "), "qualified_name", F.lit(": "), "signature")
    g = corpus.symbols(spark, d).groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("line", "symbol_id", row.alias("t")))).alias("x"))
    return g.select("file_path", F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("outline"))


SUFF = {
    "task_class": "CASE o_orderpriority WHEN '1-URGENT' THEN 'exact_symbol' WHEN '2-HIGH' THEN 'cross_resource' WHEN '3-MEDIUM' THEN 'localized_change' WHEN '4-NOT SPECIFIED' THEN 'broad_unknown' ELSE 'relationship_trace' END",
    "index_incomplete": "o_orderkey % 31 = 0", "planner_truncated": "o_orderkey % 37 = 0", "ambiguous": "o_orderkey % 29 = 0", "unresolved_hint": "o_orderkey % 23 = 0", "degraded": "o_orderkey % 41 = 0",
    "weak_anchor": "o_orderkey % 7 = 0", "low_confidence": "o_orderkey % 2 = 0", "anchor_present": "o_orderkey % 5 <> 0", "anchor_complete": "o_orderkey % 11 <> 0", "provider_blocked": "o_orderkey % 13 = 0",
    "critical_complete": "o_orderkey % 3 <> 0", "later_stage_holds": "o_orderkey % 4 = 0", "impact_wanted": "o_orderkey % 6 = 1", "impact_found": "o_orderkey % 17 <> 0", "peers_complete": "o_orderkey % 19 <> 0",
}


@query("sufficiency", f"""WITH i AS (SELECT o_orderkey, {", ".join(f"{v} AS {k}" for k, v in SUFF.items())} FROM orders) SELECT o_orderkey, CASE WHEN index_incomplete OR planner_truncated OR ambiguous OR unresolved_hint OR degraded THEN 'blocked'
    WHEN NOT anchor_present THEN CASE WHEN task_class = 'broad_unknown' OR weak_anchor OR low_confidence THEN 'indeterminate' ELSE 'incomplete' END WHEN NOT anchor_complete THEN 'incomplete' WHEN task_class = 'broad_unknown' OR weak_anchor THEN 'indeterminate'
    WHEN task_class IN ('exact_symbol', 'exact_semantic') THEN CASE WHEN provider_blocked THEN 'blocked' ELSE 'sufficient' END WHEN NOT critical_complete THEN CASE WHEN later_stage_holds THEN 'needs_more_context' ELSE 'incomplete' END
    WHEN impact_wanted AND NOT impact_found THEN 'blocked' WHEN task_class = 'cross_resource' AND NOT peers_complete THEN 'incomplete' WHEN provider_blocked THEN 'blocked' ELSE 'sufficient' END AS decision FROM i""")
def sufficiency(spark, d):
    o = corpus.table(spark, d, "orders")
    flags = {k: F.expr(v) for k, v in SUFF.items()}
    return o.withColumns(flags).select("o_orderkey", packing.sufficiency({k: F.col(k) for k in SUFF}).alias("decision"))


@query("cross_resource_coverage", "SELECT l_orderkey, bool_and(s_acctbal > 0) AS covered, count(DISTINCT l_suppkey)::BIGINT AS peers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey")
def cross_resource_coverage(spark, d):
    l, s = corpus.table(spark, d, "lineitem"), corpus.table(spark, d, "supplier")
    return l.join(s, l["l_suppkey"] == s["s_suppkey"]).groupBy("l_orderkey").agg(F.bool_and(F.col("s_acctbal") > 0).alias("covered"), F.count_distinct("l_suppkey").alias("peers"))


@query("assembled_packages")
def assembled_packages(spark, d):
    """One JSON package a source, of its documents by size: rows only (sequential, with serialised ceilings)."""
    from pyspark.sql import Window

    ranked = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    f = corpus.table(spark, d, "documents").withColumn("_n", F.row_number().over(ranked)).filter("_n <= 100")  # a plan's most
    rows = f.select(
        F.col("source").alias("request"),
        F.lit(4000).cast("long").alias("budget"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("candidate"),
        (F.col("doc_id") % 4).cast("int").alias("stage"),
        (F.col("doc_id") % 3).cast("int").alias("support"),
        (F.col("n_chars") % 1000).alias("score"),
        packing.estimate(F.octet_length("text").cast("long"), F.lit(0)).alias("tokens"),
        "text",
    )
    return packing.assemble(rows)


@query("pack_stages", f"WITH {EVIDENCE_SQL}, {SCORED_SQL}, {TIER_SQL} " """SELECT candidate, CASE WHEN tier = 'primary' THEN 0 WHEN list_has_any(reasons, ['direct_callee', 'direct_caller', 'framework_provider', 'export_provider', 'event_peer', 'callback_peer', 'direct_reference', 'direct_import', 'impact_direct']) THEN 1 WHEN tier = 'supporting' THEN 2 ELSE 3 END AS stage,
    CASE WHEN list_has_any(reasons, ['direct_callee', 'direct_caller', 'framework_provider', 'export_provider', 'event_peer', 'callback_peer', 'impact_direct']) THEN 1 WHEN list_has_any(reasons, ['direct_reference', 'direct_import']) THEN 2 ELSE 0 END AS support FROM tr""")
def pack_stages(spark, d):
    reasons = F.col("reasons")
    return candidates(spark, d).select("candidate", packing.stage(F.col("tier"), reasons).alias("stage"), packing.support_class(reasons).alias("support"))


@query("support_reserves", """WITH q AS (SELECT l_orderkey AS request, l_orderkey % 7 * 1000 + 512 AS budget, lpad(l_linenumber::VARCHAR, 2, '0') || '-' || lpad(l_partkey::VARCHAR, 8, '0') || '-' || lpad(l_suppkey::VARCHAR, 6, '0') AS candidate, floor(l_quantity * 100)::BIGINT AS score,
    CASE WHEN l_suppkey % 5 * 700 > 0 THEN ceil(l_suppkey % 5 * 700 / 4.0)::BIGINT + 24 WHEN l_linenumber > 0 THEN l_linenumber * 5 + 24 ELSE 128 END::BIGINT AS tokens FROM lineitem WHERE l_partkey % 4 = 1 AND l_partkey % 3 = 1),
    r AS (SELECT *, (budget - least(greatest(budget // 20, 256), 1024)) // 3 AS third FROM q QUALIFY row_number() OVER (PARTITION BY request ORDER BY score / tokens::DOUBLE DESC, score DESC, tokens, candidate) <= 3),
    a AS (SELECT *, least(tokens, greatest(1, third // count(*) OVER (PARTITION BY request)))::BIGINT AS allocation FROM r)
    SELECT request, candidate, allocation, least(sum(allocation) OVER (PARTITION BY request), third)::BIGINT AS reserve FROM a""")
def support_reserves(spark, d):
    return packing.reserves(requests(spark, d))


@query("limited_anchors", "SELECT name, symbol_id FROM (SELECT name, symbol_id, row_number() OVER (PARTITION BY name ORDER BY file_path, line, symbol_id) AS n FROM symbols) WHERE n <= 3", "symbols")
def limited_anchors(spark, d):
    """At most three anchors of an ambiguous name."""
    from factline.operators import relational

    return relational.per_group(corpus.symbols(spark, d), ["name"], 3, "file_path", "line", "symbol_id").select("name", "symbol_id")
