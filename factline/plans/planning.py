"""From a task's words to ranked candidates: intent, seeds, evidence, scores, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline import corpus
from factline.catalog import query
from factline.operators import ranking

#: Keywords of task classes, in order, with trace direction and depth; the first that occurs decides.
CLASSES = (
    ("relationship_trace", "incoming", 1, ("caller", "who calls")),
    ("relationship_trace", "outgoing", 1, ("what does", "callees", "calls")),
    ("relationship_trace", "both", 2, ("trace", "flow", "relationship")),
    ("cross_resource", "both", 1, ("cross-resource", "cross resource", "between")),
    ("localized_change", "both", 1, ("fix", "change", "modify", "implement", "refactor", "perbaiki", "ubah")),
    ("exact_symbol", "", 1, ("find", "locate", "where is", "cari")),
)
#: Words that no search term is made of, and words that mark a broad task.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "buat", "because", "by", "di", "dengan", "find", "fix", "for", "from", "in", "into", "is",
    "ke", "of", "on", "review", "the", "this", "locate", "to", "ubah", "untuk", "where", "who", "yang", "dan",
)
BROAD = (
    "architecture", "system", "subsystem", "whole", "overall", "review", "audit", "redesign", "migration", "arsitektur", "sistem",
    "keseluruhan", "redesain", "migrasi",
)
TERM = r"[A-Za-z_][A-Za-z0-9_:./\[\]-]*"
QUOTES = r""""([^"]+)"|'([^']+)'|`([^`]+)`"""
MOST_TERMS = 32


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def _decided(text: Column, pick, broad, other) -> Column:
    low = F.lower(text)
    out = F.when(F.exists(_words(low), lambda x: x.isin(*BROAD)), broad)
    for rule in CLASSES:
        out = out.when(low.rlike("|".join(rule[3])), pick(rule))
    return out.otherwise(other)


def task_class(text: Column) -> Column:
    return _decided(text, lambda r: r[0], "broad_unknown", "broad_unknown")


def trace_direction(text: Column) -> Column:
    return _decided(text, lambda r: r[1], "", "")


def expansion_depth(text: Column) -> Column:
    return _decided(text, lambda r: r[2], 1, 1)


def confidence(text: Column) -> Column:
    return _decided(text, lambda r: "medium", "medium", "low")


def task_terms(text: Column, most: int = MOST_TERMS) -> Column:
    """Distinct terms, the first ``most``: what is quoted, then identifiers of three characters or more that are no
    stopwords; an identifier may hold path and index punctuation."""
    kept = F.filter(_words(text), lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(*STOPWORDS))
    return F.slice(F.array_distinct(F.concat(quoted(text), kept)), 1, most)


def quoted(text: Column) -> Column:
    """What stands between two equal quotes or backticks."""
    spans = F.regexp_extract_all(text, F.lit(QUOTES), F.lit(0))
    return F.array_distinct(F.transform(spans, lambda x: F.substring(x, F.lit(2), F.length(x) - 2)))


def strong_terms(text: Column) -> Column:
    """Terms that look like code: punctuation, capitals inside or digits."""
    return F.filter(task_terms(text), lambda x: x.rlike(r"[.:/\[\]_-]|[a-z][A-Z]|[0-9]"))


def evidence(spark, d) -> DataFrame:
    """Evidence rows from order lines: a candidate (part) with reason, authority, distance, dynamic."""
    l = corpus.table(spark, d, "lineitem")
    reasons = F.array(*map(F.lit, ranking.REASONS))
    q = F.col("l_quantity").cast("int")
    return l.select(
        F.col("l_partkey").alias("candidate"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("evidence_id"),
        F.element_at(reasons, q % len(ranking.REASONS) + 1).alias("reason"),
        F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "R", "ambiguous").when(F.col("l_linestatus") == "O", "external").otherwise("").alias("authority"),
        (F.col("l_linenumber") % 4).cast("int").alias("distance"),
        (q > 45).alias("dynamic"),
    )


_names = ", ".join(f"'{r}'" for r in ranking.REASONS)
_cases = lambda k: " ".join(f"WHEN '{r}' THEN {k(v)}" for r, v in ranking.REASONS.items())
_profile = dict(zip(ranking.PROFILE_COLUMNS, ranking.PROFILES["localized_change"], strict=True))
FALLBACK_SQL = "reason IN ('lexical_fallback', 'broad_entry_point')"
EVIDENCE_SQL = f"""ev AS (SELECT l_partkey AS candidate, l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_extendedprice::DECIMAL(18,2) AS evidence_id, [{_names}][l_quantity::INT % {len(ranking.REASONS)} + 1] AS reason,
    CASE WHEN l_returnflag = 'A' THEN 'verified' WHEN l_returnflag = 'R' THEN 'ambiguous' WHEN l_linestatus = 'O' THEN 'external' ELSE '' END AS authority, l_linenumber % 4 AS distance, l_quantity::INT > 45 AS dynamic FROM lineitem),
  pt AS (SELECT *, CASE reason {_cases(lambda v: v[0])} END AS anchor, CASE reason {_cases(lambda v: v[1])} END AS relation,
    CASE WHEN {FALLBACK_SQL} THEN 80 WHEN reason = 'direct_callee' THEN {_profile["impact"]} ELSE CASE reason {_cases(lambda v: _profile.get(v[2], 0))} END END AS task,
    CASE authority WHEN 'verified' THEN 380 WHEN 'external' THEN -220 WHEN 'ambiguous' THEN -420 ELSE 0 END AS trust,
    CASE WHEN distance <= 0 THEN 0 WHEN distance = 1 THEN 220 ELSE 220 + 300 * (distance - 1) END AS away,
    CASE WHEN dynamic THEN 520 ELSE 0 END + CASE WHEN authority = 'ambiguous' THEN 420 ELSE 0 END AS doubt, CASE WHEN {FALLBACK_SQL} THEN 180 ELSE 0 END AS fallback,
    CASE WHEN reason IN ('explicit_focus', 'exact_symbol_match', 'weak_exact_match', 'exact_semantic_match', 'framework_operation_match') THEN 'anchor' WHEN reason IN ('direct_callee', 'direct_caller', 'direct_reference', 'direct_import') THEN 'relationship'
      WHEN reason IN ('impact_direct', 'impact_transitive') THEN 'impact' WHEN {FALLBACK_SQL} THEN 'fallback' ELSE reason END AS category FROM ev),
  sc AS (SELECT *, greatest(1, anchor + relation + task + trust - away - doubt - fallback) AS value FROM pt)"""
FOCUS_FILE, FOCUS_RESOURCE = "Brand#8/PROMO", "Brand#3"
_sum = lambda c: f"sum(CASE WHEN n <= 12 THEN trunc({c} / den) ELSE 0 END)"
SCORED_SQL = f"""rk AS (SELECT *, CASE WHEN n = 1 THEN 1.0 WHEN again = 1 THEN 5.0 ELSE 50.0 END AS den FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY value DESC, reason, evidence_id) AS n,
    row_number() OVER (PARTITION BY candidate, category ORDER BY value DESC, reason, evidence_id) AS again FROM sc)),
  gr AS (SELECT candidate, list_distinct(list(reason)) AS reasons, min(distance) AS distance, count(*)::BIGINT AS n_evidence, {_sum("anchor")} + {_sum("relation")} + {_sum("task")} + {_sum("trust")} AS good,
    least(sum(CASE WHEN n BETWEEN 2 AND 12 THEN least(trunc(value / den), 300) ELSE 0 END), 900) AS more, {_sum("away")} AS away, {_sum("doubt")} AS doubt, {_sum("fallback")} AS fallback FROM rk GROUP BY candidate),
  cs AS (SELECT candidate, reasons, distance, n_evidence, p_brand || '/' || p_type AS file, greatest(0, least(10000, good + more + CASE WHEN list_contains(reasons, 'explicit_focus') THEN 2200 ELSE 0 END + CASE WHEN p_brand || '/' || p_type = '{FOCUS_FILE}' THEN 280 ELSE 0 END
    + CASE WHEN p_brand = '{FOCUS_RESOURCE}' THEN 260 WHEN 'Brand#' || p_size % 9 = '{FOCUS_RESOURCE}' THEN 180 ELSE 0 END
    - least(1800, away + CASE distance WHEN 2 THEN 300 WHEN 3 THEN 600 ELSE 0 END) - least(1800, doubt + CASE WHEN p_size % 9 = 0 THEN 260 ELSE 0 END) - least(900, fallback)))::BIGINT AS score
    FROM gr JOIN part ON candidate = p_partkey)"""


@query("evidence_scores", f"WITH {EVIDENCE_SQL} SELECT evidence_id, candidate, value::INT AS value FROM sc")
def evidence_scores(spark, d):
    return scored(spark, d).select("evidence_id", "candidate", F.col("value").cast("int").alias("value"))


@query("candidate_scores", f"WITH {EVIDENCE_SQL}, {SCORED_SQL} SELECT candidate, score, n_evidence FROM cs")
def candidate_scores(spark, d):
    return candidates(spark, d).select("candidate", "score", "n_evidence")


def scored(spark, d) -> DataFrame:
    """Evidence of a change whose trace leads into its target."""
    return ranking.scored_evidence(evidence(spark, d), "localized_change", "incoming")


def candidates(spark, d) -> DataFrame:
    file = F.concat_ws("/", "p_brand", "p_type").alias("file")
    targets = F.array(F.concat(F.lit("Brand#"), (F.col("p_size") % 9).cast("string"))).alias("targets")
    facts = corpus.table(spark, d, "part").select(F.col("p_partkey").alias("candidate"), (F.col("p_size") % 9 != 0).alias("has_symbol"), file, F.array("p_brand").alias("resources"), targets)
    out = ranking.candidate_scores(scored(spark, d), facts, FOCUS_FILE, FOCUS_RESOURCE).join(facts.select("candidate", "file"), "candidate")
    return out.withColumn("tier", ranking.tier(F.col("reasons"), F.col("distance"), F.col("n_evidence"), broad=False))


TIER_SQL = """tr AS (SELECT *, CASE WHEN list_has_any(reasons, ['explicit_focus', 'exact_symbol_match', 'exact_semantic_match', 'framework_operation_match', 'weak_exact_match']) THEN 'primary'
    WHEN list_has_any(reasons, ['lexical_fallback', 'broad_entry_point']) AND n_evidence <= 2 THEN 'peripheral'
    WHEN distance <= 1 OR list_has_any(reasons, ['direct_callee', 'direct_caller', 'framework_provider', 'export_provider', 'event_peer', 'callback_peer']) THEN 'supporting' ELSE 'peripheral' END AS tier,
    list_contains(reasons, 'explicit_focus') AS focus FROM cs)"""


@query("candidate_tiers", f"WITH {EVIDENCE_SQL}, {SCORED_SQL}, {TIER_SQL} SELECT candidate, score, tier FROM tr")
def candidate_tiers(spark, d):
    return candidates(spark, d).select("candidate", "score", "tier")


RANK_SQL = "CASE tier WHEN 'primary' THEN 0 WHEN 'supporting' THEN 1 ELSE 2 END"


@query("plan_context", f"WITH {EVIDENCE_SQL}, {SCORED_SQL}, {TIER_SQL} SELECT candidate, score, tier, row_number() OVER (ORDER BY focus DESC, {RANK_SQL}, score DESC, file, candidate)::INT AS place, true AS truncated FROM tr QUALIFY place <= 100")
def plan_context(spark, d):
    """The first hundred candidates: explicit focus, tier, score, file, line (a part's number is its line and id)."""
    rank = F.when(F.col("tier") == "primary", 0).when(F.col("tier") == "supporting", 1).otherwise(2)
    order = [F.array_contains("reasons", "explicit_focus").desc(), rank, F.desc("score"), "file", "candidate"]
    best = candidates(spark, d).orderBy(*order).limit(101)
    best = best.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > 100)
    return best.filter("place <= 100").select("candidate", "score", "tier", "place", "truncated")


@query("seed_collection", """SELECT l_partkey AS anchor, min(l_linenumber)::INT AS priority, arg_max(l_orderkey, (l_quantity, -l_orderkey, -l_linenumber)) AS best, count(DISTINCT l_suppkey)::BIGINT AS alternates FROM lineitem GROUP BY l_partkey""")
def seed_collection(spark, d):
    g = corpus.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("anchor"))
    best = F.max_by("l_orderkey", F.struct(F.col("l_quantity"), -F.col("l_orderkey"), -F.col("l_linenumber")))
    return g.agg(F.min("l_linenumber").cast("int").alias("priority"), best.alias("best"), F.count_distinct("l_suppkey").alias("alternates"))


@query("ambiguous_hints", "SELECT name AS hint, count(DISTINCT file_path)::BIGINT AS anchors, count(DISTINCT file_path) > 1 AS ambiguous FROM symbols GROUP BY name", "symbols")
def ambiguous_hints(spark, d):
    n = F.count_distinct("file_path")
    return corpus.symbols(spark, d).groupBy(F.col("name").alias("hint")).agg(n.alias("anchors"), (n > 1).alias("ambiguous"))


@query("distance_penalties", "SELECT l_linenumber AS hops, CASE WHEN l_linenumber <= 0 THEN 0 WHEN l_linenumber = 1 THEN 220 ELSE 220 + 300 * (l_linenumber - 1) END AS penalty FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def distance_penalties(spark, d):
    n = corpus.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("hops")).distinct()
    return n.select("hops", ranking.distance_penalty(F.col("hops")).cast("int").alias("penalty"))


@query("task_profiles", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in ranking.PROFILES.items()) + f") t(task_class, {', '.join(ranking.PROFILE_COLUMNS)})")
def task_profiles(spark, d):
    rows = F.array(*[F.struct(F.lit(k).alias("task_class"), *[F.lit(x).alias(c) for c, x in zip(ranking.PROFILE_COLUMNS, v, strict=True)]) for k, v in ranking.PROFILES.items()])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


@query("edge_reasons", """SELECT edge_id, CASE kind WHEN 'calls' THEN 'direct_callee' WHEN 'references' THEN 'direct_reference' WHEN 'imports' THEN 'direct_import' ELSE 'direct_semantic' END AS out_reason,
    CASE kind WHEN 'calls' THEN 'direct_caller' WHEN 'references' THEN 'direct_reference' WHEN 'imports' THEN 'direct_import' ELSE 'direct_semantic' END AS in_reason FROM edges""", "edges")
def edge_reasons(spark, d):
    k = F.col("kind")
    return corpus.edges(spark, d).select("edge_id", ranking.edge_reason(k, F.lit(True)).alias("out_reason"), ranking.edge_reason(k, F.lit(False)).alias("in_reason"))


@query("relevant_candidates", f"""WITH {EVIDENCE_SQL}, r AS (SELECT candidate, list_distinct(list(reason)) AS reasons FROM ev GROUP BY candidate)
    SELECT candidate, list_has_any(reasons, ['direct_caller', 'impact_direct', 'event_peer', 'callback_peer']) AS incoming, list_has_any(reasons, ['direct_callee', 'export_provider', 'framework_provider', 'event_peer', 'callback_peer']) AS outgoing FROM r""")
def relevant_candidates(spark, d):
    r = evidence(spark, d).groupBy("candidate").agg(F.collect_set("reason").alias("reasons"))
    return r.select("candidate", ranking.relevant(F.col("reasons"), F.lit("incoming")).alias("incoming"), ranking.relevant(F.col("reasons"), F.lit("outgoing")).alias("outgoing"))


@query("limited_evidence", f"WITH {EVIDENCE_SQL} SELECT candidate, evidence_id FROM (SELECT candidate, evidence_id, row_number() OVER (PARTITION BY candidate ORDER BY value DESC, reason, evidence_id) AS n FROM sc) WHERE n <= 5")
def limited_evidence(spark, d):
    w = Window.partitionBy("candidate").orderBy(F.desc("value"), "reason", "evidence_id")
    e = scored(spark, d).withColumn("n", F.row_number().over(w))
    return e.filter("n <= 5").select("candidate", "evidence_id")


@query("seed_ranking", """SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_quantity DESC, l_linenumber, l_partkey, l_suppkey)::INT AS place FROM lineitem""")
def seed_ranking(spark, d):
    role = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    w = Window.partitionBy("l_orderkey").orderBy(role, F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey")
    return corpus.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.row_number().over(w).alias("place"))
