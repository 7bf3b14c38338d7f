"""Context packing under a token budget, and the decision whether a package suffices."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a budget, of what is read for it, and the least room worth filling.
MIN_BUDGET, MAX_BUDGET, LEAST_ROOM, MOST_READS, MOST_BYTES = 512, 64_000, 24, 64, 4 << 20
STAGES = ("anchor", "direct_support", "domain_support", "peripheral")


def estimate(n_bytes: Column, lines: Column) -> Column:
    """Tokens of a candidate: by bytes, else by lines, else a constant."""
    return F.when(n_bytes > 0, F.ceil(n_bytes / 4) + 24).when(lines > 0, lines * 5 + 24).otherwise(128).cast("long")


def metadata_reserve(budget: Column) -> Column:
    return F.least(F.greatest(F.floor(budget / 20), F.lit(256)), F.lit(1024)).cast("long")


#: Reasons of direct supports, and those of them that are critical (class 1) or secondary (class 2).
DIRECT = ("direct_callee", "direct_caller", "framework_provider", "export_provider", "event_peer", "callback_peer", "direct_reference", "direct_import", "impact_direct")
CRITICAL = ("direct_callee", "direct_caller", "framework_provider", "export_provider", "event_peer", "callback_peer", "impact_direct")
SECONDARY = ("direct_reference", "direct_import")
MOST_CRITICAL, MOST_CANDIDATES = 3, 100


def _any(reasons: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(reasons, F.array(*map(F.lit, names)))


def stage(tier: Column, reasons: Column) -> Column:
    return F.when(tier == "primary", 0).when(_any(reasons, DIRECT), 1).when(tier == "supporting", 2).otherwise(3)


def support_class(reasons: Column) -> Column:
    """0 for none, 1 for critical, 2 for secondary support."""
    return F.when(_any(reasons, CRITICAL), 1).when(_any(reasons, SECONDARY), 2).otherwise(0)


def pack_order() -> list[Column]:
    """Stage; class within direct supports; score a token but for anchors; score; size; id."""
    utility = F.when(F.col("stage") > 0, -(F.col("score") / F.greatest("tokens", F.lit(1)))).otherwise(F.lit(0.0))
    support = F.when(F.col("stage") == 1, F.col("support")).otherwise(0)
    return [F.col("stage").alias("stage"), support.alias("class"), utility.alias("ratio"), (-F.col("score")).alias("worse"), F.col("tokens").alias("tokens"), F.col("candidate").alias("candidate")]


def reserves(candidates: DataFrame, request: str = "request") -> DataFrame:
    """(request, candidate, allocation, reserve): room for the first critical supports in pack order, three at most, each
    given its estimate or an equal share of a third of what is usable; ``reserve`` is their sum, within that third."""
    order = Window.partitionBy(request).orderBy(*pack_order())
    rows = candidates.filter((F.col("stage") == 1) & (F.col("support") == 1)).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= MOST_CRITICAL)
    most = F.floor((F.col("budget") - metadata_reserve(F.col("budget"))) / 3)
    all_of = Window.partitionBy(request)
    rows = rows.withColumn("allocation", F.least("tokens", F.greatest(F.floor(most / F.count(F.lit(1)).over(all_of)), F.lit(1))))
    return rows.select(request, "candidate", "allocation", F.least(F.sum("allocation").over(all_of), most).alias("reserve"))


def pack(candidates: DataFrame, request: str = "request") -> DataFrame:
    """Greedy packing per request in ``pack_order``; what doesn't fit is passed over.

    Rows: (request, budget, candidate, stage, support, score, tokens); gives place, taken and used (tokens so far).  A
    request's first hundred candidates, a plan's most, are ranked before they are gathered; the fold over them is one
    expression: no Python, and one shuffle by request."""
    row = F.struct(*pack_order())
    first = Window.partitionBy(request).orderBy(*pack_order())
    candidates = candidates.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= MOST_CANDIDATES).drop("_place")
    groups = candidates.groupBy(request).agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.max("budget").alias("_budget"))
    groups = groups.withColumn("_room", F.col("_budget") - metadata_reserve(F.col("_budget")))
    kinds = dict(candidates.dtypes)
    shown = f"array<struct<candidate:{kinds['candidate']},stage:{kinds['stage']},taken:boolean,used:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("reads"), F.array().cast(shown).alias("out"))

    def step(a: Column, x: Column) -> Column:
        free = F.col("_room") - a["used"]
        fits = (free >= LEAST_ROOM) & (x["tokens"] <= free) & (a["reads"] < MOST_READS)
        used = (a["used"] + F.when(fits, x["tokens"]).otherwise(0)).cast("long")
        shown = F.struct(x["candidate"].alias("candidate"), x["stage"].alias("stage"), fits.alias("taken"), used.alias("used"))
        return F.struct(used.alias("used"), (a["reads"] + fits.cast("int")).alias("reads"), F.concat(a["out"], F.array(shown)).alias("out"))

    out = groups.select(request, F.posexplode(F.aggregate("_rows", start, step, lambda a: a["out"])).alias("_n", "_x"))
    return out.select(request, (F.col("_n") + 1).alias("place"), "_x.*")


def fits_skipping(items: DataFrame, request: str, order: list[str], size: str, ceiling: int) -> DataFrame:
    """In order, take what still fits under a ceiling and pass over what doesn't (an aggregate over each small group)."""
    rows = items.groupBy(request).agg(F.array_sort(F.collect_list(F.struct(*order, size))).alias("_items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<{', '.join(f'{n}:{t}' for n, t in items.select(*order, size).dtypes)}>>").alias("kept"))
    step = lambda a, x: F.when(a["used"] + x[size] <= ceiling, F.struct((a["used"] + x[size]).cast("long").alias("used"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    out = rows.select(request, F.aggregate("_items", start, step).alias("_a"))
    return out.select(request, F.col("_a.used").alias("used"), F.explode("_a.kept").alias("_x")).select(request, "used", "_x.*")


def slice_to_tokens(text: str, most: int, count) -> str:
    """The longest head-and-tail (60 to 40 by lines) of a text within ``most`` tokens, by bisection; one line is cut."""
    if count(text) <= most:
        return text
    lines = text.split("\n")

    def shown(n: int) -> str:
        head = n * 6 // 10 or 1
        return "\n".join([*lines[:head], "...", *lines[len(lines) - (n - head) :]]) if n < len(lines) else text

    low, high = 0, len(lines)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if count(shown(mid)) <= most else (low, mid - 1)
    if low:
        return shown(low)
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if count(text[:mid]) <= most else (low, mid - 1)
    return text[:low]


def count_tokens(text: str) -> int:
    """Tokens by bytes, where no vocabulary is at hand: an estimate, and reported as one."""
    return -(-len(text.encode()) // 4)


def enforce_ceiling(package: dict, most: int, count=count_tokens, attempts: int = 128) -> dict:
    """A package whose serialised form is within ``most`` tokens: the last section gives way first, by half its text, then
    goes whole; what is left out is named."""
    for _ in range(attempts):
        size = count(json.dumps(package, ensure_ascii=False))
        if size <= most:
            break
        sections = package["sections"]
        if not sections:
            package["omitted"] = package["omitted"][: len(package["omitted"]) // 2]
            continue
        last = sections[-1]
        room = count(last["text"]) - max(size - most, 1) - 8
        if room >= LEAST_ROOM:
            last["text"], last["complete"] = slice_to_tokens(last["text"], room, count), False
        else:
            package["omitted"].append(sections.pop()["candidate"])
    return package


def assemble(candidates: DataFrame, request: str = "request") -> DataFrame:
    """(request, tokens, complete, package): one JSON package a request, within its budget as serialised.

    Rows: (request, budget, candidate, stage, support, score, tokens, text).  Critical supports hold a reserve of at most
    a third of the room, for three of them; it is given back to later stages when they need less."""
    kind = dict(candidates.dtypes)[request]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        budget = int(rows["budget"].iloc[0])
        room = budget - min(max(budget // 20, 256), 1024)
        order = sorted(rows.itertuples(index=False), key=lambda r: (r.stage, r.support if r.stage == 1 else 0, -(r.score / max(r.tokens, 1)) if r.stage else 0, -r.score, r.tokens, r.candidate))
        critical = [r for r in order if r.stage == 1 and r.support == 1][:MOST_CRITICAL]
        share = max(room // 3 // max(len(critical), 1), 1)
        reserve = min(room // 3, sum(min(r.tokens, share) for r in critical))
        sections, omitted, used, read = [], [], 0, 0
        for r in order:
            free = room - used - (reserve if r.stage == 0 else 0)
            raw = len(r.text.encode())
            if free < LEAST_ROOM or len(sections) >= MOST_READS or read + raw > MOST_BYTES:
                omitted.append(r.candidate)
                continue
            text = slice_to_tokens(r.text, free, count_tokens)
            sections.append({"candidate": r.candidate, "stage": STAGES[r.stage], "complete": text == r.text, "text": text})
            used, read = used + count_tokens(text), read + raw
        package = enforce_ceiling({"sections": sections, "omitted": omitted, "budget": budget, "exact": False}, budget)
        shown = json.dumps(package, ensure_ascii=False)
        complete = bool(package["sections"]) and all(x["complete"] for x in package["sections"]) and not package["omitted"]
        return pd.DataFrame([(key[0], count_tokens(shown), complete, shown)], columns=[request, "tokens", "complete", "package"])

    return candidates.groupBy(request).applyInPandas(run, f"{request} {kind}, tokens long, complete boolean, package string")


def sufficiency(i: dict[str, Column]) -> Column:
    """Decision of a package from flags, first rule that holds."""
    exact = i["task_class"].isin("exact_symbol", "exact_semantic")
    weak = i["task_class"].isin("broad_unknown") | i["weak_anchor"]
    return (
        F.when(i["index_incomplete"] | i["planner_truncated"] | i["ambiguous"] | i["unresolved_hint"] | i["degraded"], "blocked")
        .when(~i["anchor_present"], F.when(weak | i["low_confidence"], "indeterminate").otherwise("incomplete"))
        .when(~i["anchor_complete"], "incomplete")
        .when(weak, "indeterminate")
        .when(exact, F.when(i["provider_blocked"], "blocked").otherwise("sufficient"))
        .when(~i["critical_complete"], F.when(i["later_stage_holds"], "needs_more_context").otherwise("incomplete"))
        .when(i["impact_wanted"] & ~i["impact_found"], "blocked")
        .when((i["task_class"] == "cross_resource") & ~i["peers_complete"], "incomplete")
        .when(i["provider_blocked"], "blocked")
        .otherwise("sufficient")
    )
