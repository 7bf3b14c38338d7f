"""Evaluation of retrieval runs: derived fields, one report row, gates, summaries, early stops, acceptance.

A run is a row (task, category, class, tier, mode, budget, repeat, required_total, required_found, tokens, baseline,
scoped_baseline, reads, rounds, ms, status, precision, top5, top10, fabricated, leaked, varies, error); no error is ''.
Medians and percentiles interpolate on n - 1 and are exact, by rounds of counting.  A mean or median of nothing is 0.  Reports,
summaries and gates run at once and come back as a table of their few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.operators.quantiles import kept, summarised

#: The mode under test, the one that goes on after a sufficient package, and the two baselines.
MAIN, CONTINUED, PANORAMIC, SCOPED = "phase7", "phase7_no_early_stop", "panoramic", "scoped_panoramic"
SUPPORTED, DIAGNOSTIC, ADVERSARIAL = "supported_deterministic", "diagnostic_open_ended", "adversarial_safety"
NOT_EVALUATED, OVER_BUDGET = "not_evaluated", "serialized budget exceeded"


def share(found: Column, total: Column) -> Column:
    """Recall: the share found of what is required, 1 where nothing is."""
    return F.when(total == 0, 1.0).otherwise(F.try_divide(found.cast("double"), total))


def saved(tokens: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, 1 - tokens / baseline).otherwise(0.0)


def scored(runs: DataFrame) -> DataFrame:
    """Runs with recall (0 where nothing is required), savings, false sufficiency and insufficiency.

    A run without a baseline is its own; one with a package (that is, a status) beyond its budget is in error."""
    c = F.col
    runs = runs.withColumns({k: F.when(c(k) > 0, c(k)).otherwise(c("tokens")) for k in ("baseline", "scoped_baseline")})
    missing, sufficient, evaluated = c("required_found") < c("required_total"), c("status") == "sufficient", c("status") != NOT_EVALUATED
    return runs.withColumns(
        {
            "recall": F.when(c("required_total") == 0, 0.0).otherwise(share(c("required_found"), c("required_total"))),
            "saving": saved(c("tokens"), c("baseline")),
            "scoped_saving": saved(c("tokens"), c("scoped_baseline")),
            "false_sufficiency": sufficient & missing,
            "false_insufficiency": ~sufficient & ~missing & evaluated,
            "error": F.when(evaluated & (c("tokens") > c("budget")), OVER_BUDGET).otherwise(c("error")),
        }
    )


def at_most(runs: DataFrame) -> DataFrame:
    """Runs with ``top``: whether a run without error that requires something is at its task and repeat's largest budget; ties
    all are."""
    valid = (F.col("required_total") > 0) & (F.col("error") == "")
    most = F.max(F.when(valid, F.col("budget"))).over(Window.partitionBy("task", "repeat"))
    return runs.withColumn("_most", most).withColumn("top", valid & (F.col("budget") == F.col("_most"))).drop("_most")


def rounded(name: str) -> Column:
    """A mean or percentile, 0 of nothing."""
    return F.round(F.coalesce(F.col(name), F.lit(0.0)), 6).alias(name)


#: What a report reads of scored runs with ``top``.
REPORTED = """task mode category class budget repeat required_total required_found tokens reads rounds ms status precision top5 top10 fabricated leaked varies error recall saving scoped_saving
    false_sufficiency false_insufficiency top""".split()


@contextmanager
def main_phase(runs: DataFrame, columns: list[str]) -> Iterator[DataFrame]:
    """Scored runs with ``top`` of the mode under test, or of all where there are none, kept meanwhile."""
    with kept(at_most(scored(runs.filter(F.col("mode") == MAIN))).select(*columns)) as main:
        if not main.isEmpty():
            yield main
            return
    with kept(at_most(scored(runs)).select(*columns)) as every:
        yield every


def report_counts() -> dict[str, Column]:
    """What a report counts, by name."""
    c = F.col
    return {
        "passed_retrieval": (c("required_found") == c("required_total")) & (c("error") == ""),
        **{s: c("status") == s for s in ("sufficient", "blocked", "indeterminate")},
        "false_sufficiency": c("false_sufficiency"),
        "false_insufficiency": c("false_insufficiency"),
        "empty_retrieval": c("precision").isNull(),
        "provider_fabrication": c("fabricated"),
        "cross_repo_leaks": c("leaked"),
        "nondeterministic": c("varies"),
        "runtime_errors": c("error") != "",
        "budget_violations": c("tokens") > c("budget"),
        "false_sufficiency_max_budget": c("false_sufficiency") & c("top"),
        **{f"false_sufficiency_{k.split('_')[0]}": c("false_sufficiency") & c("top") & (c("class") == k) for k in (SUPPORTED, DIAGNOSTIC, ADVERSARIAL)},
    }


def report(runs: DataFrame) -> DataFrame:
    """One row over the runs of the mode under test, with what early stops save against the mode that goes on."""
    c = F.col
    eligible = c("top") & (c("class") == SUPPORTED)
    counts = report_counts()
    values = {"recall": c("recall"), "top5_recall": c("top5"), "top10_recall": c("top10"), "precision": c("precision"), "tokens": c("tokens"), "saving": c("saving"), "scoped_saving": c("scoped_saving"), "reads": c("reads"), "rounds": c("rounds"), "ms": c("ms")}
    values |= {"supported_saving": F.when(eligible, c("saving")), "supported_scoped_saving": F.when(eligible, c("scoped_saving"))}
    points = {f"median_{k}": (k, 0.5) for k in values} | {f"p{p}_saving": ("saving", p / 100) for p in (25, 75, 90)} | {"p95_ms": ("ms", 0.95)}
    means = {"mean_recall": F.avg("recall"), "mean_saving": F.avg("saving")}
    with main_phase(runs, REPORTED) as main:
        row = summarised(main, [], {"results": F.count(F.lit(1)), **{k: F.count_if(v) for k, v in counts.items()}, **means}, values, points, {"tasks": "task"})
        what = ["tokens", "reads", "rounds"]
        stops = stopped(main.filter(c("mode") == MAIN), runs.filter(c("mode") == CONTINUED)).agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in what]).first()
    medians = [k for k in points if k.startswith("median_")]
    return row.select(
        "results",
        "tasks",
        *counts,
        *[rounded(k) for k in [*medians, *means, *[k for k in points if k not in medians]]],
        *[F.lit(stops[k]).cast("long").alias(f"early_stop_{k}") for k in what],
    )


def early_stops(runs: DataFrame) -> DataFrame:
    """(category, task, budget, repeat, tokens, reads, rounds): what a run saves against the one that goes on, never below 0.

    Of repeated runs of one key the largest counts."""
    return stopped(*[runs.filter(F.col("mode") == mode) for mode in (MAIN, CONTINUED)])


def stopped(main: DataFrame, continued: DataFrame) -> DataFrame:
    keys, what = ["task", "budget", "repeat"], ["tokens", "reads", "rounds"]
    a, b = (df.groupBy(*keys).agg(F.max(F.struct(*what, "category")).alias(name)) for df, name in ((main, "a"), (continued, "b")))
    return a.join(b, keys).select("a.category", *keys, *[F.greatest(F.col(f"b.{k}") - F.col(f"a.{k}"), F.lit(0)).alias(k) for k in what])


def summaries(runs: DataFrame) -> DataFrame:
    """(kind, name, results, tasks, ...): all modes; categories and tiers of the mode under test."""
    c = F.col
    values = ("recall", "saving", "scoped_saving")
    counts = {"results": F.count(F.lit(1)), "false_sufficiency": F.count_if("false_sufficiency"), "provider_errors": F.count_if("fabricated")}
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), c(k).alias("name")) for k in ("mode", "category", "tier")])
    with kept(scored(runs).select("mode", "category", "tier", "task", "fabricated", "false_sufficiency", *values)) as s:
        rows = s.withColumn("g", F.explode(parts)).filter((c("g.kind") == "mode") | (c("mode") == MAIN)).select("g.kind", "g.name", "task", "fabricated", "false_sufficiency", *values)
        found = summarised(rows, ["kind", "name"], counts, {k: c(k) for k in values}, {f"median_{k}": (k, 0.5) for k in values}, {"tasks": "task"})
    return found.select("kind", "name", "results", "tasks", "false_sufficiency", "provider_errors", *[rounded(f"median_{k}") for k in values])


#: What gates read of scored runs with ``top``.
GATED = "mode class budget tokens error fabricated leaked varies recall saving false_sufficiency top".split()


def gates(runs: DataFrame) -> DataFrame:
    """One row of checks that a report must pass; without supported tasks the share of false sufficiency doesn't pass."""
    c = F.col
    panoramic = (c("mode") == PANORAMIC) & ((c("tokens") != c("baseline")) | (c("saving") != 0))
    scoped = (c("mode") == SCOPED) & ((c("tokens") != c("scoped_baseline")) | (c("scoped_saving") != 0))
    of_baselines = scored(runs.filter(c("mode").isin(PANORAMIC, SCOPED)))
    differ = of_baselines.agg(F.count_if(panoramic).alias("panoramic"), F.count_if(scoped).alias("scoped")).first()
    eligible = c("top") & (c("class") == SUPPORTED)
    supported = eligible & (c("mode") == MAIN)
    zero = {"provider_fabrication_zero": "provider_fabrication", "cross_repo_leakage_zero": "cross_repo_leaks", "budget_violations_zero": "budget_violations", "false_sufficiency_zero": "false_sufficiency", "runtime_errors_zero": "runtime_errors"}
    counts = report_counts()
    aggregates = {k: F.count_if(counts[k]) for k in (*zero.values(), "nondeterministic")}
    aggregates |= {"n": F.count_if(supported), "wrong": F.count_if(supported & c("false_sufficiency")), "recall_of_supported": F.avg(F.when(supported, c("recall")))}
    with main_phase(runs, GATED) as main:
        row = summarised(main, [], aggregates, {"saving": F.when(eligible, c("saving"))}, {"median_supported_saving": ("saving", 0.5)})
    return row.select(
        *[(c(v) == 0).alias(k) for k, v in zero.items()],
        *[F.lit(differ[k] == 0).alias(f"{k}_baseline_zero") for k in ("panoramic", "scoped")],
        c("nondeterministic").alias("determinism_failures"),
        (F.coalesce("recall_of_supported", F.lit(0.0)) >= 0.95).alias("supported_recall_at_least_95"),
        F.when(c("n") == 0, False).otherwise(c("wrong") / c("n") < 0.05).alias("false_sufficiency_below_5"),
        (rounded("median_supported_saving") >= 0.5).alias("token_reduction_at_least_50"),
    )


def acceptance(runs: DataFrame) -> DataFrame:
    """(class, tasks, passed): tasks at their largest budgets; a supported one passes if all its repeats find all that is
    required, others are excluded."""
    top = at_most(scored(runs).filter(F.col("mode") == MAIN)).filter("top")
    tasks = top.groupBy("task").agg(F.max("class").alias("class"), F.bool_and(F.col("required_found") == F.col("required_total")).alias("ok"))
    passed = F.count_if(F.col("ok") & (F.col("class") == SUPPORTED))
    return tasks.groupBy("class").agg(F.count(F.lit(1)).alias("tasks"), passed.alias("passed"))


def kind_recall(required: DataFrame, found: DataFrame, tasks: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(task, kind, recall) for every task and kind: required (task, kind, item) found (task, item); 1 where none is required."""
    hit = found.select("task", "item").distinct().withColumn("_hit", F.lit(1))
    counted = required.join(hit, ["task", "item"], "left").groupBy("task", "kind").agg(share(F.count("_hit"), F.count(F.lit(1))).alias("_recall"))
    every = tasks.select("task", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    return every.join(counted, ["task", "kind"], "left").select("task", "kind", F.coalesce("_recall", F.lit(1.0)).alias("recall"))
