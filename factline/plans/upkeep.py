"""Queries of the operators that keep facts up to date, and of rules around plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline import corpus
from factline.catalog import query
from factline.functions import scalar
from factline.operators import ranking, roles
from factline.plans.planning import EVIDENCE_SQL, SCORED_SQL, TIER_SQL, candidates
from factline.plans.search import holding
from factline.sinks import facts
from factline.streaming import refresh


def owned(spark, d) -> tuple[DataFrame, DataFrame]:
    """Entities, and edges from orders' customers to their nations, with the analyzer that made each."""
    c = corpus.entities(spark, d).withColumn("metadata", F.when(F.col("analyzer") == "customer", F.concat(F.lit('{"source_resource_path":"'), "kind", F.lit('"}'))).otherwise(F.col("metadata")))
    e = corpus.edges(spark, d).filter("kind IN ('registers', 'calls')")
    return c, e.select("edge_id", "from_id", "to_id", "kind", F.when(F.col("kind") == "registers", "customer").otherwise("order").alias("analyzer"))


OWNED = """owned AS (SELECT id, analyzer, kind, name, file_path, line, CASE analyzer WHEN 'customer' THEN '{"source_resource_path":"' || kind || '"}' ELSE metadata END AS metadata FROM entities),
    links AS (SELECT edge_id, from_id, to_id, kind, CASE kind WHEN 'registers' THEN 'customer' ELSE 'order' END AS analyzer FROM edges WHERE kind IN ('registers', 'calls'))"""


@query("deleted_repo", "SELECT repo, count(*)::BIGINT AS n FROM files WHERE repo <> 'src1' GROUP BY repo", "files")
def deleted_repo(spark, d):
    return facts.without_repo(corpus.files(spark, d), "src1").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@query("replaced_analyzer", f"""WITH {OWNED} SELECT 'entity' AS part, id, kind FROM owned WHERE analyzer <> 'customer' UNION ALL SELECT 'entity', 'n' || n_nationkey, 'nation' FROM nation
    UNION ALL SELECT 'edge', edge_id, kind FROM links WHERE analyzer <> 'customer' UNION ALL SELECT 'edge', 'in:' || n_nationkey, 'in' FROM nation""", "entities edges")
def replaced_analyzer(spark, d):
    entities, edges = owned(spark, d)
    key = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    n = corpus.table(spark, d, "nation")
    new = n.select(key.alias("id"), F.lit("customer").alias("analyzer"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"), F.lit("").alias("file_path"), F.lit(0).cast("long").alias("line"), F.lit("{}").alias("metadata"))
    ties = n.select(F.concat(F.lit("in:"), F.col("n_nationkey").cast("string")).alias("edge_id"), key.alias("from_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("to_id"), F.lit("in").alias("kind"), F.lit("customer").alias("analyzer"))
    e, r = facts.replaced_analyzer(entities, edges, "customer", new, ties)
    return e.select(F.lit("entity").alias("part"), "id", "kind").unionByName(r.select(F.lit("edge").alias("part"), F.col("edge_id").alias("id"), "kind"))


@query("replaced_edges", f"WITH {OWNED} SELECT edge_id, kind FROM links WHERE analyzer <> 'order' UNION ALL SELECT 'again:' || edge_id, kind FROM links WHERE analyzer = 'order'", "entities edges")
def replaced_edges(spark, d):
    _, edges = owned(spark, d)
    new = edges.filter("analyzer = 'order'").withColumn("edge_id", F.concat(F.lit("again:"), "edge_id"))
    return facts.replaced_edges(edges, "order", new).select("edge_id", "kind")


@query("replaced_resource", f"""WITH {OWNED}, gone AS (SELECT id FROM owned WHERE analyzer = 'customer' AND kind = 'building')
    SELECT 'entity' AS part, id FROM owned WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'edge', edge_id FROM links WHERE analyzer <> 'customer' OR (from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone))""", "entities edges")
def replaced_resource(spark, d):
    entities, edges = owned(spark, d)
    e, r = facts.replaced_resource(entities, edges, "customer", "building", entities.limit(0), edges.limit(0))
    return e.select(F.lit("entity").alias("part"), "id").unionByName(r.select(F.lit("edge").alias("part"), F.col("edge_id").alias("id")))


@query("proof_write_back", """SELECT id, CASE WHEN value > 50 THEN '{"status":"verified"}' ELSE metadata END AS metadata FROM entities LEFT JOIN (SELECT 'e' || event_id AS id, value FROM events) USING (id)""", "entities")
def proof_write_back(spark, d):
    proofs = corpus.table(spark, d, "events").filter("value > 50").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.lit('{"status":"verified"}').alias("metadata"))
    return facts.proofs_written(corpus.entities(spark, d), proofs).select("id", "metadata")


@query("owner_guard", "SELECT id, kind FROM entities WHERE analyzer = 'event'", "entities")
def owner_guard(spark, d):
    """Entities of one analyzer through the guard, which fails on rows without id or kind or of another analyzer."""
    from factline.sinks.tables import checked

    return checked(corpus.entities(spark, d).filter("analyzer = 'event'"), "event").select("id", "kind")


@query("edge_guard", f"WITH {OWNED} SELECT edge_id, kind FROM links WHERE analyzer = 'order'", "entities edges")
def edge_guard(spark, d):
    return facts.checked_edges(owned(spark, d)[1].filter("analyzer = 'order'"), "order").select("edge_id", "kind")


def workspaces(spark, d) -> DataFrame:
    n = corpus.table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("repo"))
    return n.agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("c_acctbal") > -500).alias("indexed"), F.lit(False).alias("truncated"), F.lit(True).alias("incomplete"))


WORKSPACES = "ws AS (SELECT c_nationkey::VARCHAR AS repo, count(*)::BIGINT AS discovered, count(*) FILTER (WHERE c_acctbal > -500)::BIGINT AS indexed FROM customer GROUP BY c_nationkey)"


@query("workspace_state", f"WITH {WORKSPACES} SELECT repo, 'workspace' AS part FROM ws WHERE repo <> '3' UNION ALL SELECT '3', 'workspace' UNION ALL SELECT s_nationkey::VARCHAR, 'resource' FROM supplier WHERE s_nationkey <> 3")
def workspace_state(spark, d):
    tables = {"workspace": workspaces(spark, d).select("repo"), "resource": corpus.table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("repo"))}
    out = facts.replaced_state(tables, "3", {"workspace": spark.createDataFrame([("3",)], "repo string")})
    return out["workspace"].withColumn("part", F.lit("workspace")).unionByName(out["resource"].withColumn("part", F.lit("resource")))


@query("completeness", f"WITH {WORKSPACES} SELECT repo, CASE repo WHEN '5' THEN 9 ELSE discovered END::BIGINT AS discovered, CASE repo WHEN '5' THEN 9 ELSE indexed END::BIGINT AS indexed, repo <> '5' AS incomplete FROM ws")
def completeness(spark, d):
    return facts.completeness(workspaces(spark, d), "5", 9, 9, False).select("repo", "discovered", "indexed", "incomplete")


@query("savings_totals", "SELECT event_type AS tool, count(*)::BIGINT + 1 AS calls, sum(floor(value))::BIGINT + 100 AS saved FROM events GROUP BY event_type")
def savings_totals(spark, d):
    e = corpus.table(spark, d, "events").select(F.col("event_type").alias("tool"), F.floor("value").alias("saved"))
    before = e.select("tool", F.lit(1).cast("long").alias("calls"), F.lit(100).cast("long").alias("saved")).distinct()
    return facts.savings_added(before, e)


@query("postings_update", """WITH d AS (SELECT path, doc_id, content FROM files), t AS (SELECT DISTINCT path, doc_id, unnest(list_filter(string_split_regex(lower(CASE WHEN doc_id % 7 = 0 THEN 'changed ' || content ELSE content END), '[^0-9A-Za-z]+'), lambda x: x <> '')) AS token FROM d)
    SELECT token, count(*)::BIGINT AS n FROM t WHERE doc_id % 10 <> 1 GROUP BY token""", "files")
def postings_update(spark, d):
    """The full-text index after a seventh of the files changed and a tenth went."""
    f = corpus.files(spark, d)
    changed = f.filter("doc_id % 7 = 0 AND doc_id % 10 <> 1").select("path", F.concat(F.lit("changed "), "content").alias("content"))
    return facts.postings_updated(facts.postings(f), changed, f.filter("doc_id % 10 = 1").select("path")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("text_shortlist", """SELECT path FROM files WHERE len(list_filter(string_split_regex(lower(content), '[^0-9A-Za-z]+'), lambda x: x IN ('licensed', 'under'))) > 0""", "files")
def text_shortlist(spark, d):
    f = corpus.files(spark, d)
    return facts.shortlist(f, facts.postings(f), "licensed under").select("path")


@query("combined_facts", """SELECT id, min(analyzer) AS analyzer FROM (SELECT id, analyzer FROM entities UNION ALL SELECT 'c' || s_suppkey, 'aaa' FROM supplier) GROUP BY id""", "entities")
def combined_facts(spark, d):
    other = corpus.table(spark, d, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("aaa").alias("analyzer"))
    return facts.combined(corpus.entities(spark, d).select("id", "analyzer"), other)


# refresh


@query("refreshed_file", """WITH left_ AS (SELECT id, kind, file_path, line FROM entities WHERE analyzer = 'customer' AND file_path <> 'nation/4' UNION ALL SELECT 'new', 'x', 'nation/4', 1)
    SELECT 'entity' AS part, id FROM left_ UNION ALL SELECT 'edge', 'in:' || id FROM left_""", "entities")
def refreshed_file(spark, d):
    """A file's customers replaced by one, and the edges to files derived anew."""
    e = corpus.entities(spark, d).filter("analyzer = 'customer'")
    new = spark.createDataFrame([("new", "customer", "x", "n", "nation/4", 1, "{}")], "id string, analyzer string, kind string, name string, file_path string, line long, metadata string")
    derive = lambda x: x.select(F.concat(F.lit("in:"), "id").alias("edge_id"), F.col("id").alias("from_id"), F.col("file_path").alias("to_id"), F.lit("in").alias("kind"))
    now, edges = refresh.refreshed_file(e, derive(e).withColumn("analyzer", F.lit("customer")), "nation/4", new, derive, "customer")
    return now.select(F.lit("entity").alias("part"), "id").unionByName(edges.select(F.lit("edge").alias("part"), F.col("edge_id").alias("id")))


@query("failed_resource", f"""WITH {OWNED} SELECT 'entity' AS part, id FROM owned WHERE NOT (analyzer = 'customer' AND kind = 'machinery') UNION ALL SELECT 'degraded', 'machinery'""", "entities edges")
def failed_resource(spark, d):
    """A resource whose analysis failed: its facts go, and it is marked."""
    entities, edges = owned(spark, d)
    now, _, health = refresh.refreshed_resource(entities, edges, spark.createDataFrame([("machinery", False), ("building", False)], "resource string, degraded boolean"), "customer", "machinery", None)
    return now.select(F.lit("entity").alias("part"), "id").unionByName(health.filter("degraded").select(F.lit("degraded").alias("part"), F.col("resource").alias("id")))


@query("derived_edges", """WITH c AS (SELECT 'e' || event_id AS id, CASE event_type WHEN 'click' THEN 'trigger' WHEN 'signup' THEN 'handler' ELSE '' END AS kind, user_id AS name, ['client', 'server', 'shared', 'unknown'][event_id % 4 + 1] AS side, 'r' || event_id % 5 AS resource FROM events)
    SELECT 'cross_resource_event:' || t.id || ':' || h.id AS edge_id FROM c t JOIN c h ON t.name = h.name AND t.kind = 'trigger' AND h.kind = 'handler' AND t.resource <> h.resource WHERE h.side = 'shared' OR (h.side = t.side AND h.side <> 'unknown')""")
def derived_edges(spark, d):
    kind = F.when(F.col("event_type") == "click", "trigger").when(F.col("event_type") == "signup", "handler").otherwise("")
    side = F.element_at(F.array(*map(F.lit, ("client", "server", "shared", "unknown"))), (F.col("event_id") % 4 + 1).cast("int"))
    compact = corpus.table(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), kind.alias("kind"), F.col("user_id").alias("name"), side.alias("side"), F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("resource"))
    return refresh.derived_edges(compact).select("edge_id")


@query("workspace_sides", """SELECT c.s AS wanted, p.s AS got, p.s = 'shared' OR (p.s = c.s AND p.s <> 'unknown') AS fits, (c.s = 'client' AND p.s IN ('server', 'shared')) OR (c.s = 'server' AND p.s IN ('client', 'shared')) AS callback
    FROM (SELECT unnest(['client', 'server', 'shared', 'unknown']) AS s) c, (SELECT unnest(['client', 'server', 'shared', 'unknown']) AS s) p""")
def workspace_sides(spark, d):
    sides = F.array(*map(F.lit, ("client", "server", "shared", "unknown")))
    both = spark.range(1).select(F.explode(sides).alias("wanted")).select("wanted", F.explode(sides).alias("got"))
    w, g = F.col("wanted"), F.col("got")
    return both.select("wanted", "got", refresh.workspace_side(w, g).alias("fits"), refresh.workspace_callback(w, g).alias("callback"))


@query("transitions", """SELECT user_id, event_id, CASE WHEN now AND NOT was THEN 'entered' WHEN was AND NOT now THEN 'exited' WHEN was THEN 'active' ELSE 'none' END AS change
    FROM (SELECT user_id, event_id, event_type = 'signup' AS now, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = 'signup', false) AS was FROM events)""")
def transitions(spark, d):
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = corpus.table(spark, d, "events").withColumn("before", before)
    return e.select("user_id", "event_id", refresh.transition(F.col("before"), F.col("event_type"), "signup").alias("change"))


@query("restored_watches", "SELECT c_name AS path, c_nationkey::VARCHAR AS repo, c_acctbal > 0 AND c_custkey % 5 <> 0 AS restored FROM customer")
def restored_watches(spark, d):
    """Saved watches: a folder that is gone (no credit) or another repository's now isn't restored."""
    c = corpus.table(spark, d, "customer")
    saved = c.select(F.col("c_name").alias("path"), F.col("c_nationkey").cast("string").alias("repo"))
    now = F.when(F.col("c_custkey") % 5 == 0, "other").otherwise(F.col("c_nationkey").cast("string"))
    return refresh.saved_watches(saved, c.filter("c_acctbal > 0").select(F.col("c_name").alias("path"), now.alias("repo")))


# rules around plans

ADJUST = {
    "broad": "o_orderkey % 17 = 0", "anchors": "(o_orderkey % 4)::INT", "symbol": "o_orderkey % 3 = 0", "strong": "o_orderkey % 5 <> 0",
    "class": "CASE o_orderpriority WHEN '1-URGENT' THEN 'exact_symbol' WHEN '2-HIGH' THEN 'cross_resource' WHEN '3-MEDIUM' THEN 'localized_change' WHEN '4-NOT SPECIFIED' THEN 'broad_unknown' ELSE 'relationship_trace' END",
}


@query("adjusted_classes", f"""WITH i AS (SELECT o_orderkey, {", ".join(f"{v} AS {k}" for k, v in ADJUST.items())} FROM orders), j AS (SELECT *, class IN ('relationship_trace', 'cross_resource') AS kept FROM i)
    SELECT o_orderkey, CASE WHEN broad THEN 'broad_unknown' WHEN anchors = 0 THEN CASE WHEN kept THEN class ELSE 'broad_unknown' END WHEN anchors = 1 AND class = 'broad_unknown' AND strong THEN CASE WHEN symbol THEN 'exact_symbol' ELSE 'exact_semantic' END
      WHEN anchors > 1 AND NOT kept THEN 'broad_unknown' ELSE class END AS class,
    CASE WHEN broad THEN CASE WHEN anchors > 0 THEN 'medium' ELSE 'low' END WHEN anchors = 0 THEN CASE WHEN kept THEN 'low' ELSE 'low' END WHEN anchors = 1 AND class = 'broad_unknown' THEN CASE WHEN strong THEN 'high' ELSE 'low' END WHEN anchors = 1 AND class = 'exact_symbol' AND strong THEN 'high' ELSE 'low' END AS confidence FROM j""")
def adjusted_classes(spark, d):
    """Task classes after anchors are looked up, from a low confidence on."""
    o = corpus.table(spark, d, "orders").withColumns({k: F.expr(v.replace("::INT", "")) for k, v in ADJUST.items()})
    found = roles.adjusted_class(F.col("class"), F.lit("low"), F.col("broad"), F.col("anchors"), F.col("symbol"), F.col("strong"))
    return o.select("o_orderkey", found["class"].alias("class"), found["confidence"].alias("confidence"))


@query("focus_resources", """WITH r AS (SELECT n_name AS focus, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT 's/' || s_suppkey, 1 FROM supplier)
    SELECT focus, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'found' ELSE 'not_found' END AS state FROM (SELECT f.focus, coalesce(n, 0) AS n FROM (SELECT n_name AS focus FROM nation UNION ALL SELECT 's/' || s_suppkey FROM supplier UNION ALL SELECT r_name FROM region) f LEFT JOIN r ON f.focus = r.focus)""")
def focus_resources(spark, d):
    t = lambda n: corpus.table(spark, d, n)
    asked = t("nation").select(F.col("n_name").alias("focus")).unionByName(t("supplier").select(F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")).alias("focus"))).unionByName(t("region").select(F.col("r_name").alias("focus")))
    return roles.resolved_focus(asked, corpus.resources(spark, d)).select("focus", "state")


@query("entities_of_symbols", "SELECT symbol_id, id, analyzer, row_number() OVER (PARTITION BY symbol_id ORDER BY analyzer, id)::INT AS place FROM (SELECT file_path AS symbol_id, id, analyzer FROM entities)", "entities")
def entities_of_symbols(spark, d):
    """All entities that share a symbol, in order of analyzer and id."""
    return roles.sharing(corpus.entities(spark, d).withColumn("symbol_id", F.col("file_path"))).select("symbol_id", "id", "analyzer", "place")


@query("semantic_roles", "SELECT analyzer, kind, role FROM (VALUES " + ", ".join(f"('{a}', '{k}', '{r}')" for a, k, r in (
    ("generic", "code_symbol", "declaration"), ("generic", "call_site", "usage"), ("generic", "import_site", "topology"), ("generic", "other", "topology"), ("scripts", "event_trigger", "flow_endpoint"), ("scripts", "command", "flow_endpoint"), ("scripts", "manifest", "topology"),
    ("framework", "framework_operation", "operation"), ("framework", "framework_api_provider", "declaration"), ("framework", "framework_api_call", "usage"), ("framework", "framework_status", "status"), ("framework", "framework_candidate", "topology"))) + ") t(analyzer, kind, role)")
def semantic_roles(spark, d):
    pairs = [("generic", "code_symbol"), ("generic", "call_site"), ("generic", "import_site"), ("generic", "other"), ("scripts", "event_trigger"), ("scripts", "command"), ("scripts", "manifest")]
    pairs += [("framework", f"framework_{k}") for k in ("operation", "api_provider", "api_call", "status", "candidate")]
    rows = spark.createDataFrame(pairs, "analyzer string, kind string")
    return rows.select("analyzer", "kind", roles.role(F.col("analyzer"), F.col("kind")).alias("role"))


@query("result_clamps", "SELECT what, asked, least(CASE WHEN asked <= 0 THEN usual ELSE asked END, most)::INT AS clamped FROM (VALUES ('symbols', 10, 200), ('text', 20, 200), ('semantics', 20, 200), ('trace', 50, 200), ('tree', 1000, 10000), ('outline', 200, 2000), ('directories', 500, 10000), ('resources', 50, 200)) t(what, usual, most), (SELECT unnest([-1, 0, 7, 150, 99999]) AS asked)")
def result_clamps(spark, d):
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, (-1, 0, 7, 150, 99999)))).alias("asked"))
    rows = asked.withColumn("what", F.explode(F.array(*map(F.lit, roles.CLAMPS))))
    return rows.select("what", "asked", roles.clamped(F.col("what"), F.col("asked")).alias("clamped"))


@query("required_candidates", f"""WITH {EVIDENCE_SQL}, {SCORED_SQL}, {TIER_SQL} SELECT candidate, list_has_any(reasons, ['framework_provider', 'export_provider']) AS provider, list_has_any(reasons, ['event_peer', 'callback_peer']) AS flow FROM tr
    WHERE list_has_any(reasons, ['direct_caller', 'impact_direct', 'event_peer', 'callback_peer']) AND candidate <> 1""")
def required_candidates(spark, d):
    """Critical supports in the direction asked for, but for the anchor."""
    return roles.required(candidates(spark, d), F.lit("incoming"), F.lit(1)).select("candidate", "provider", "flow")


@query("safety_flags", "SELECT source AS repo, count(DISTINCT d.doc_id)::BIGINT AS n_marked FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY source")
def safety_flags(spark, d):
    """Sources whose documents hold a text that must not leak (a benchmark item)."""
    docs, items = corpus.table(spark, d, "documents"), corpus.table(spark, d, "benchmark").select("item_id", F.col("text").alias("wanted"))
    hits = holding(docs.select("doc_id", "text"), items).select("doc_id").distinct()
    return docs.select("doc_id", F.col("source").alias("repo")).join(hits, "doc_id", "left_semi").groupBy("repo").agg(F.count_distinct("doc_id").alias("n_marked"))


@query("index_health", f"""WITH {WORKSPACES} SELECT w.repo, CASE WHEN w.discovered <> w.indexed THEN 'incomplete' WHEN f.n > 0 THEN 'degraded' ELSE 'complete' END AS state, coalesce(f.n, 0)::BIGINT AS n_degraded
    FROM ws w LEFT JOIN (SELECT s_nationkey::VARCHAR AS repo, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY 1) f ON w.repo = f.repo UNION ALL SELECT 'empty', 'unknown', 0""")
def index_health(spark, d):
    w = workspaces(spark, d).select("repo", F.col("discovered").alias("n_files"), "discovered", "indexed", "truncated")
    w = w.unionByName(spark.createDataFrame([("empty", 0, 0, 0, False)], "repo string, n_files long, discovered long, indexed long, truncated boolean"))
    s = corpus.table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("repo"), F.col("s_name").alias("resource"), F.when(F.col("s_acctbal") < 0, "failed").otherwise("ok").alias("status"))
    return roles.health(w, s).select("repo", "state", "n_degraded")


@query("drift_check", "SELECT path, v1.hash = v2.hash AS verified FROM v1 JOIN v2 USING (path)", "files snapshots")
def drift_check(spark, d):
    """Whether the stored hash of a file is still that of what it holds."""
    stored, now = corpus.snapshots(spark, d)
    return stored.join(now.withColumnRenamed("hash", "_now"), "path").select("path", (F.col("hash") == F.col("_now")).alias("verified"))


@query("symbol_context", """WITH l AS (SELECT doc_id, path, string_split(content, chr(10)) AS ls FROM files), s AS (SELECT *, doc_id % len(ls) + 1 AS first FROM l), t AS (SELECT *, least(first + 1, len(ls)) AS last FROM s)
    SELECT path, first::BIGINT AS first, array_to_string(ls[greatest(1, first - 2):least(len(ls), last + 2)], chr(10)) AS source FROM t""", "files")
def symbol_context(spark, d):
    """A symbol of two lines in every file, with two lines before and after."""
    n = F.size(F.split("content", "\n", -1))
    s = corpus.files(spark, d).withColumn("first", F.col("doc_id") % n + 1).withColumn("last", F.least(F.col("first") + 1, n))
    return s.select("path", "first", scalar.with_context(F.col("content"), F.col("first"), F.col("last"), 2).alias("source"))


@query("numbered_lines", """SELECT p_partkey, left(p_name, 120) AS first, '' AS second, left(p_type, 120) AS third FROM part""")
def numbered_lines(spark, d):
    """Summaries out of a reply of numbered lines; a line without a number is passed over."""
    text = F.concat(F.lit("Here they are:\n1. "), "p_name", F.lit("\n\n 3.  "), "p_type", F.lit("\n9. beyond\n"))
    x = scalar.numbered_lines(text, 3)
    return corpus.table(spark, d, "part").select("p_partkey", x[0].alias("first"), x[1].alias("second"), x[2].alias("third"))


@query("module_paths", "SELECT n_nationkey, 'example.org/' || n_name AS module FROM nation")
def module_paths(spark, d):
    text = F.concat(F.lit("// a comment\nmodule example.org/"), "n_name", F.lit(" // its path\n\ngo 1.22\n"))
    return corpus.table(spark, d, "nation").select("n_nationkey", scalar.module_path(text).alias("module"))


@query("evidence_identities", f"""WITH {EVIDENCE_SQL}, u AS (SELECT candidate, reason, authority, distance, dynamic, min(evidence_id) AS evidence_id FROM ev GROUP BY ALL)
    SELECT candidate, evidence_id FROM u QUALIFY row_number() OVER (ORDER BY evidence_id, candidate, reason) <= 256""")
def evidence_identities(spark, d):
    """Evidence of one identity once, the first 256 that a plan keeps."""
    from factline.plans.planning import evidence

    return ranking.distinct_evidence(evidence(spark, d), 256).select("candidate", "evidence_id")
