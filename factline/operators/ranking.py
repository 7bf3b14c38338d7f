"""Evidence weights, candidate scores with rank-dependent discounts, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reason codes with their anchor and relation weights and the part of the task profile they draw on.
REASONS = {
    "explicit_focus": (5200, 0, "target"),
    "exact_symbol_match": (4500, 0, "target"),
    "framework_operation_match": (4400, 0, "operation"),
    "exact_semantic_match": (4300, 0, "target"),
    "weak_exact_match": (2750, 0, "target"),
    "exact_file_match": (950, 0, ""),
    "direct_callee": (0, 2700, "callee"),
    "direct_caller": (0, 2700, "caller"),
    "export_provider": (0, 2650, "provider"),
    "framework_provider": (0, 2650, "provider"),
    "event_peer": (0, 2500, "flow"),
    "callback_peer": (0, 2500, "flow"),
    "direct_semantic": (0, 2050, ""),
    "direct_reference": (0, 1450, "reference"),
    "direct_import": (0, 1200, "imported"),
    "usage_match": (0, 520, ""),
    "impact_direct": (0, 1050, "impact"),
    "impact_transitive": (0, 450, "impact"),
    "lexical_fallback": (0, 0, ""),
    "broad_entry_point": (0, 0, ""),
}
PROFILE_COLUMNS = ("target", "callee", "caller", "reference", "imported", "provider", "flow", "operation", "impact")
PROFILES = {
    "default": (1000, 700, 700, 280, 220, 650, 700, 850, 360),
    "exact_symbol": (1100, 40, 40, 0, 0, 0, 30, 850, 360),
    "exact_semantic": (1100, 140, 140, 40, 30, 700, 900, 1150, 360),
    "localized_change": (1150, 760, 760, 300, 240, 720, 650, 850, 420),
    "relationship_trace": (950, 760, 760, 260, 200, 700, 900, 850, 400),
    "cross_resource": (900, 520, 520, 120, 100, 850, 1150, 850, 360),
    "broad_unknown": (800, 340, 340, 160, 180, 500, 520, 650, 360),
}
AUTHORITY = {"verified": 380, "external": -220, "ambiguous": -420, "missing": -380}
FALLBACK = ("lexical_fallback", "broad_entry_point")
FALLBACK_TASK, FALLBACK_PENALTY = 80, 180
STRONG = ("explicit_focus", "exact_symbol_match", "exact_semantic_match", "framework_operation_match")
CRITICAL = ("direct_callee", "direct_caller", "framework_provider", "export_provider", "event_peer", "callback_peer", "impact_direct")
SECONDARY = ("direct_reference", "direct_import")
WEAK = ("lexical_fallback", "broad_entry_point", "weak_exact_match", "direct_reference", "direct_import", "usage_match")
#: Reasons of one category; every other reason is a category of its own.
CATEGORIES = {
    "anchor": ("explicit_focus", "exact_symbol_match", "weak_exact_match", "exact_semantic_match", "framework_operation_match"),
    "generic_relationship": ("direct_callee", "direct_caller", "direct_reference", "direct_import"),
    "event_flow": ("event_peer",),
    "callback_flow": ("callback_peer",),
    "export_flow": ("export_provider",),
    "framework_flow": ("framework_provider",),
    "impact": ("impact_direct", "impact_transitive"),
    "fallback": ("lexical_fallback", "broad_entry_point"),
}
#: Items that count, bounds of a score and of its parts, what focus, a missing symbol and a place are worth.
MOST_ITEMS, MOST_SCORE, MOST_MORE, MOST_MORE_EACH = 12, 10_000, 900, 300
MOST_AWAY, MOST_DOUBT, MOST_FALLBACK = 1800, 1800, 900
FOCUS_FILE, FOCUS_RESOURCE, FOCUS_TARGET, FOCUS_EXPLICIT, NO_SYMBOL, PLACED = 280, 260, 180, 2200, 260, 20
#: Reasons that make a candidate a support at any distance.
SUPPORT = ("direct_callee", "direct_caller", "framework_provider", "export_provider", "event_peer", "callback_peer")


def lookup(key: Column, table: dict, default=0) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def distance_penalty(d: Column) -> Column:
    return F.when(d <= 0, 0).when(d == 1, 220).otherwise(220 + 300 * (d - 1))


def has_any(reasons: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(reasons, F.array(*map(F.lit, names)))


def scored_evidence(evidence: DataFrame, task_class: str = "default", direction: str = "", included: bool = False) -> DataFrame:
    """Add components, ``category`` and ``value`` to rows of (candidate, reason, authority, distance, dynamic).

    A trace into its target makes callees mere impact; one out of it callers, unless the task asks to include them."""
    weights = dict(zip(PROFILE_COLUMNS, PROFILES[task_class], strict=True))
    task = {k: weights.get(v[2], 0) for k, v in REASONS.items()} | dict.fromkeys(FALLBACK, FALLBACK_TASK)
    if direction == "incoming":
        task["direct_callee"] = weights["impact"]
    if direction == "outgoing" and not included:
        task["direct_caller"] = weights["impact"]
    reason = F.col("reason")
    out = evidence.withColumns(
        {
            "category": F.coalesce(lookup(reason, {r: c for c, rs in CATEGORIES.items() for r in rs}, None), reason),
            "anchor": lookup(reason, {k: v[0] for k, v in REASONS.items()}),
            "relation": lookup(reason, {k: v[1] for k, v in REASONS.items()}),
            "task": lookup(reason, task),
            "trust": lookup(F.col("authority"), AUTHORITY),
            "away": distance_penalty(F.col("distance")),
            "doubt": F.when(F.col("dynamic"), 520).otherwise(0) + F.when(F.col("authority").isin("ambiguous", "missing"), 420).otherwise(0),
            "fallback": F.when(reason.isin(*FALLBACK), FALLBACK_PENALTY).otherwise(0),
        }
    )
    total = F.col("anchor") + F.col("relation") + F.col("task") + F.col("trust") - F.col("away") - F.col("doubt") - F.col("fallback")
    return out.withColumn("value", F.greatest(total, F.lit(1)))


def distinct_evidence(evidence: DataFrame, most: int = 256) -> DataFrame:
    """Evidence of one identity (candidate, reason, authority, distance, dynamic) once, the first ``most`` in order."""
    one = evidence.groupBy("candidate", "reason", "authority", "distance", "dynamic").agg(F.min("evidence_id").alias("evidence_id"))
    return one.orderBy("evidence_id", "candidate", "reason").limit(most)


def candidate_scores(scored: DataFrame, facts: DataFrame | None = None, focus_file: str = "", focus_resource: str = "", diverse: bool = False) -> DataFrame:
    """(candidate, score, n_evidence, reasons, distance) from scored evidence.

    Items count in order of value, twelve at most: the first in full, the first of another category a fifth, others a
    fiftieth, each part cut to a whole number towards zero; later items also corroborate, within bounds.  ``facts``
    (candidate, has_symbol, file, resources, targets) adds focus, the lack of a symbol and, for ``diverse`` (broad) tasks,
    a little for weak candidates with a file; penalties are bounded."""
    w = Window.partitionBy("candidate").orderBy(F.desc("value"), "reason", "evidence_id")
    c = Window.partitionBy("candidate", "category").orderBy(F.desc("value"), "reason", "evidence_id")
    rows = scored.withColumn("_n", F.row_number().over(w)).withColumn("_again", F.row_number().over(c))
    share = F.when(F.col("_n") == 1, 1).when(F.col("_again") == 1, 5).otherwise(50)
    counts = F.col("_n") <= MOST_ITEMS
    part = lambda name: F.sum(F.when(counts, (F.col(name) / share).cast("long")).otherwise(0)).alias(f"_{name}")
    more = F.when(counts & (F.col("_n") > 1), F.least((F.col("value") / share).cast("long"), F.lit(MOST_MORE_EACH))).otherwise(0)
    parts = ("anchor", "relation", "task", "trust", "away", "doubt", "fallback")
    g = rows.groupBy("candidate").agg(
        *[part(x) for x in parts], F.sum(more).alias("_more"), F.count(F.lit(1)).alias("n_evidence"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.min("distance").alias("distance")
    )
    focus, doubt, placed = F.when(F.array_contains("reasons", "explicit_focus"), FOCUS_EXPLICIT).otherwise(0), F.col("_doubt"), F.lit(0)
    if facts is not None:
        g = g.join(facts, "candidate", "left")
        if focus_file:
            focus = focus + F.when(F.col("file") == focus_file, FOCUS_FILE).otherwise(0)
        if focus_resource:
            focus = focus + F.when(F.array_contains("resources", focus_resource), FOCUS_RESOURCE).when(F.array_contains("targets", focus_resource), FOCUS_TARGET).otherwise(0)
        doubt = doubt + F.when(F.col("has_symbol"), 0).otherwise(NO_SYMBOL)
        if diverse:
            weak = has_any(F.col("reasons"), WEAK) & ~has_any(F.col("reasons"), (*STRONG, *SUPPORT))
            placed = F.when(weak & (F.col("file") != ""), PLACED).otherwise(0)
    away = F.col("_away") + F.when(F.col("distance") > 1, distance_penalty(F.col("distance")) - distance_penalty(F.lit(1))).otherwise(0)
    within = lambda x, most: F.greatest(F.least(x, F.lit(most)), F.lit(0))
    total = F.col("_anchor") + F.col("_relation") + F.col("_task") + F.col("_trust") + focus + within(F.col("_more"), MOST_MORE) + placed
    total = total - within(away, MOST_AWAY) - within(doubt, MOST_DOUBT) - within(F.col("_fallback"), MOST_FALLBACK)
    return g.select("candidate", within(total, MOST_SCORE).cast("long").alias("score"), "n_evidence", "reasons", "distance")


def tier(reasons: Column, distance: Column, n_evidence: Column, broad: bool) -> Column:
    return (
        F.when(has_any(reasons, STRONG), "primary")
        .when(F.array_contains(reasons, "weak_exact_match"), "peripheral" if broad else "primary")
        .when(has_any(reasons, FALLBACK) & (n_evidence <= 2), "peripheral")
        .when((distance <= 1) | has_any(reasons, SUPPORT), "supporting")
        .otherwise("peripheral")
    )


def diversity_order(candidates: list[dict], most: int) -> list[dict]:
    """Strong candidates first, then greedily those with a file or resource not seen yet; ties in the given order."""
    first = [c for c in candidates if c["tier"] == "primary"]
    rest = [c for c in candidates if c["tier"] != "primary"]
    files, resources = {c["file"] for c in first}, {c["resource"] for c in first}
    while rest and len(first) < most:
        best = max(range(len(rest)), key=lambda i: ((rest[i]["resource"] not in resources) + (rest[i]["file"] not in files), -i))
        c = rest.pop(best)
        files.add(c["file"])
        resources.add(c["resource"])
        first.append(c)
    return first[:most]


#: Reasons that an edge gives, by its kind; a call met from the other end is a caller's.
EDGE_REASONS = {
    "calls": "direct_callee",
    "references": "direct_reference",
    "imports": "direct_import",
    "cross_resource_event": "event_peer",
    "cross_resource_callback": "callback_peer",
    "cross_resource_export": "export_provider",
    "framework_calls": "framework_provider",
    "framework_object_call": "framework_provider",
    "provided_by": "framework_provider",
    "derived_from": "same_symbol",
}


def edge_reason(kind: Column, outgoing: Column) -> Column:
    return F.when((kind == "calls") & ~outgoing, "direct_caller").otherwise(lookup(kind, EDGE_REASONS, "direct_semantic"))


def relevant(reasons: Column, direction: Column) -> Column:
    """Whether a candidate's reasons fit the direction asked for."""
    has = lambda *names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    flow = has("event_peer", "callback_peer")
    incoming = has("direct_caller", "impact_direct") | flow
    outgoing = has("direct_callee", "export_provider", "framework_provider") | flow
    return F.when(direction == "incoming", incoming).when(direction == "outgoing", outgoing).otherwise(True)
