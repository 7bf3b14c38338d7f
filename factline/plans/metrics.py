"""Retrieval-quality metrics over ground truth and results, on projections of orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factline import corpus
from factline.catalog import query
from factline.operators import evaluation

#: A result row: task (customer), mode (priority), budget (quantity), repeat (line), recall (tax and discount), tokens.
RESULTS = """results AS (SELECT o_custkey AS task, o_orderpriority AS mode, l_quantity::INT AS budget, l_linenumber AS repeat, (l_discount * 100)::INT AS recall_pct, l_extendedprice::BIGINT AS tokens,
  (l_extendedprice * (1 + l_tax))::BIGINT AS baseline, l_returnflag AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def results(spark, d) -> DataFrame:
    l, o = corpus.table(spark, d, "lineitem"), corpus.table(spark, d, "orders")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("task"),
        F.col("o_orderpriority").alias("mode"),
        F.col("l_quantity").cast("int").alias("budget"),
        F.col("l_linenumber").alias("repeat"),
        F.round(F.col("l_discount") * 100).cast("int").alias("recall_pct"),
        F.bround("l_extendedprice").cast("long").alias("tokens"),
        F.bround(F.col("l_extendedprice") * (1 + F.col("l_tax"))).cast("long").alias("baseline"),
        F.col("l_returnflag").alias("flag"),
    )


@query("mean_recall", f"WITH {RESULTS} SELECT mode, sum(recall_pct)::BIGINT AS total, count(*)::BIGINT AS n, round(sum(recall_pct)::DOUBLE / count(*), 6) AS mean FROM results GROUP BY mode")
def mean_recall(spark, d):
    g = results(spark, d).groupBy("mode").agg(F.sum("recall_pct").alias("total"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("mean", F.round(F.col("total").cast("double") / F.col("n"), 6))


@query("percentiles", f"WITH {RESULTS} SELECT mode, quantile_cont(recall_pct::DOUBLE, 0.5) AS median, round(quantile_cont(budget::DOUBLE, 0.95), 6) AS p95 FROM results GROUP BY mode")
def percentiles(spark, d):
    return results(spark, d).groupBy("mode").agg(F.percentile("recall_pct", 0.5).alias("median"), F.round(F.percentile("budget", 0.95), 6).alias("p95"))


#: Runs as the evaluation takes them, from line items: a customer is a task, an order's priority the mode.
RUN = {
    "task": "o_custkey", "category": "c_mktsegment", "tier": "'tier' || (o_custkey % 3)::VARCHAR", "class": "CASE o_custkey % 13 WHEN 0 THEN 'adversarial_safety' WHEN 1 THEN 'diagnostic_open_ended' ELSE 'supported_deterministic' END",
    "mode": "CASE o_orderpriority WHEN '1-URGENT' THEN 'phase7' WHEN '2-HIGH' THEN 'phase7_no_early_stop' WHEN '3-MEDIUM' THEN 'panoramic' WHEN '4-NOT SPECIFIED' THEN 'scoped_panoramic' ELSE 'primitive' END",
    "budget": "l_partkey % 3 * 20000 + 20000", "repeat": "l_linenumber % 2", "required_total": "l_partkey % 5", "required_found": "least(l_suppkey % 7, l_partkey % 5)", "tokens": "l_partkey * 37 % 42000 + 500",
    "baseline": "l_suppkey * 91 % 60000", "scoped_baseline": "l_suppkey * 53 % 40000", "reads": "l_partkey % 9", "rounds": "l_suppkey % 4", "ms": "l_partkey * 11 % 900", "status": "CASE WHEN o_orderpriority > '2' THEN 'not_evaluated' WHEN l_suppkey % 3 > 0 THEN 'sufficient' WHEN l_partkey % 2 = 0 THEN 'blocked' ELSE 'indeterminate' END",
    "precision": "CASE WHEN l_partkey % 6 > 0 THEN (l_suppkey % 4) / 4.0 END", "top5": "(l_suppkey % 5) / 4.0", "top10": "(l_partkey % 5) / 4.0", "fabricated": "l_partkey % 97 = 5", "leaked": "l_partkey % 89 = 7", "varies": "l_suppkey % 83 = 9",
    "error": "CASE WHEN l_partkey % 43 = 1 THEN 'timeout' ELSE '' END",
}


def runs(spark, d) -> DataFrame:
    l, o, c = (corpus.table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    # the smaller two first, so that line items move once
    joined = l.join(o.join(c, o["o_custkey"] == c["c_custkey"]), l["l_orderkey"] == o["o_orderkey"])
    return joined.select(*[F.expr(v.replace("::VARCHAR", "::STRING")).alias(k) for k, v in RUN.items()])


SCORED_RUNS = f"""raw AS (SELECT {", ".join(f"{v} AS {k}" for k, v in RUN.items())} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
  based AS (SELECT * REPLACE (CASE WHEN baseline > 0 THEN baseline ELSE tokens END AS baseline, CASE WHEN scoped_baseline > 0 THEN scoped_baseline ELSE tokens END AS scoped_baseline,
    CASE WHEN status <> 'not_evaluated' AND tokens > budget THEN 'serialized budget exceeded' ELSE error END AS error) FROM raw),
  s AS (SELECT *, CASE WHEN required_total = 0 THEN 0.0 ELSE required_found::DOUBLE / required_total END AS recall, 1 - tokens::DOUBLE / baseline AS saving, 1 - tokens::DOUBLE / scoped_baseline AS scoped_saving,
    status = 'sufficient' AND required_found < required_total AS wrong, status IN ('blocked', 'indeterminate') AND required_found = required_total AS needless FROM based),
  main AS (SELECT *, coalesce(required_total > 0 AND error = '' AND budget = max(budget) FILTER (WHERE required_total > 0 AND error = '') OVER (PARTITION BY task, repeat), false) AS top FROM s WHERE mode = 'phase7'),
  one AS (SELECT * FROM raw WHERE mode LIKE 'phase7%' QUALIFY row_number() OVER (PARTITION BY mode, task, budget, repeat ORDER BY tokens DESC, reads DESC, rounds DESC) = 1),
  stops AS (SELECT a.category, greatest(b.tokens - a.tokens, 0) AS tokens, greatest(b.reads - a.reads, 0) AS reads, greatest(b.rounds - a.rounds, 0) AS rounds FROM one a JOIN one b USING (task, budget, repeat) WHERE a.mode = 'phase7' AND b.mode = 'phase7_no_early_stop')"""
_MIDDLE = {"recall": "recall", "top5_recall": "top5", "top10_recall": "top10", "precision": "precision", "tokens": "tokens", "saving": "saving", "scoped_saving": "scoped_saving", "reads": "reads", "rounds": "rounds", "ms": "ms"}
REPORT_SQL = f"""SELECT count(*)::BIGINT AS results, count(DISTINCT task)::BIGINT AS tasks, count(*) FILTER (WHERE required_found = required_total AND error = '')::BIGINT AS passed_retrieval,
  {", ".join(f"count(*) FILTER (WHERE status = '{x}')::BIGINT AS {x}" for x in ("sufficient", "blocked", "indeterminate"))}, count(*) FILTER (WHERE wrong)::BIGINT AS false_sufficiency, count(*) FILTER (WHERE needless)::BIGINT AS false_insufficiency,
  count(*) FILTER (WHERE precision IS NULL)::BIGINT AS empty_retrieval, count(*) FILTER (WHERE fabricated)::BIGINT AS provider_fabrication, count(*) FILTER (WHERE leaked)::BIGINT AS cross_repo_leaks, count(*) FILTER (WHERE varies)::BIGINT AS nondeterministic,
  count(*) FILTER (WHERE error <> '')::BIGINT AS runtime_errors, count(*) FILTER (WHERE tokens > budget)::BIGINT AS budget_violations, count(*) FILTER (WHERE wrong AND top)::BIGINT AS false_sufficiency_max_budget,
  {", ".join(f"count(*) FILTER (WHERE wrong AND top AND class LIKE '{x}%')::BIGINT AS false_sufficiency_{x}" for x in ("supported", "diagnostic", "adversarial"))},
  {", ".join(f"round(quantile_cont({v}::DOUBLE, 0.5), 6) AS median_{k}" for k, v in _MIDDLE.items())},
  {", ".join(f"round(coalesce(quantile_cont({x}, 0.5) FILTER (WHERE top AND class LIKE 'supported%'), 0), 6) AS median_supported_{x}" for x in ("saving", "scoped_saving"))}, round(avg(recall), 6) AS mean_recall, round(avg(saving), 6) AS mean_saving,
  {", ".join(f"round(quantile_cont(saving, {p / 100}), 6) AS p{p}_saving" for p in (25, 75, 90))}, round(quantile_cont(ms::DOUBLE, 0.95), 6) AS p95_ms,
  {", ".join(f"(SELECT coalesce(sum({x}), 0) FROM stops)::BIGINT AS early_stop_{x}" for x in ("tokens", "reads", "rounds"))} FROM main"""


@query("report_aggregate", f"WITH {SCORED_RUNS} {REPORT_SQL}")
def report_aggregate(spark, d):
    return evaluation.report(runs(spark, d))


@query("group_summaries", f"""WITH {SCORED_RUNS}, g AS (SELECT 'mode' AS kind, mode AS name, * FROM s UNION ALL SELECT 'category', category, * FROM s WHERE mode = 'phase7' UNION ALL SELECT 'tier', tier, * FROM s WHERE mode = 'phase7')
    SELECT kind, name, count(*)::BIGINT AS results, count(DISTINCT task)::BIGINT AS tasks, count(*) FILTER (WHERE wrong)::BIGINT AS false_sufficiency, count(*) FILTER (WHERE fabricated)::BIGINT AS provider_errors,
    {", ".join(f"round(quantile_cont({x}, 0.5), 6) AS median_{x}" for x in ("recall", "saving", "scoped_saving"))} FROM g GROUP BY kind, name""")
def group_summaries(spark, d):
    return evaluation.summaries(runs(spark, d))


@query("kind_recall", """WITH need AS (SELECT o_custkey AS task, o_orderkey AS item, CASE o_orderpriority WHEN '1-URGENT' THEN 'symbol' WHEN '2-HIGH' THEN 'file' WHEN '3-MEDIUM' THEN 'relationship' ELSE 'provider' END AS kind FROM orders),
    r AS (SELECT n.task, n.kind, count(f.item)::DOUBLE / count(*) AS recall FROM need n LEFT JOIN (SELECT DISTINCT l_orderkey AS item FROM lineitem WHERE l_quantity > 45) f ON n.item = f.item GROUP BY ALL)
    SELECT c_custkey AS task, k AS kind, round(coalesce(recall, 1.0), 6) AS recall FROM customer CROSS JOIN (SELECT unnest(['symbol', 'file', 'relationship', 'provider']) AS k) LEFT JOIN r ON r.task = c_custkey AND r.kind = k""")
def kind_recall(spark, d):
    o = corpus.table(spark, d, "orders")
    p = F.col("o_orderpriority")
    need = o.select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("item"), F.when(p == "1-URGENT", "symbol").when(p == "2-HIGH", "file").when(p == "3-MEDIUM", "relationship").otherwise("provider").alias("kind"))
    big = corpus.table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("item")).distinct()
    tasks = corpus.table(spark, d, "customer").select(F.col("c_custkey").alias("task"))
    got = evaluation.kind_recall(need, need.join(big, "item").select("task", "item"), tasks, ("symbol", "file", "relationship", "provider"))
    return got.select("task", "kind", F.round("recall", 6).alias("recall"))


@query("acceptance", f"WITH {SCORED_RUNS}, t AS (SELECT task, max(class) AS class, bool_and(required_found = required_total) AS ok FROM main WHERE top GROUP BY task) SELECT class, count(*)::BIGINT AS tasks, count(*) FILTER (WHERE ok AND class LIKE 'supported%')::BIGINT AS passed FROM t GROUP BY class")
def acceptance(spark, d):
    return evaluation.acceptance(runs(spark, d))


@query("maximum_budget", f"WITH {SCORED_RUNS} SELECT task, repeat, budget, tokens FROM main WHERE top")
def maximum_budget(spark, d):
    tried = evaluation.scored(runs(spark, d)).filter(F.col("mode") == evaluation.MAIN)
    return evaluation.at_most(tried).filter("top").select("task", "repeat", "budget", "tokens")


@query("monotonicity_failures", f"""WITH {RESULTS} SELECT task, repeat, count(*) FILTER (WHERE recall_pct < before)::BIGINT AS failures FROM (SELECT task, repeat, recall_pct, lag(recall_pct) OVER (PARTITION BY task, repeat ORDER BY budget, tokens, recall_pct) AS before
    FROM results WHERE mode = '1-URGENT' AND flag <> 'R') GROUP BY task, repeat""")
def monotonicity_failures(spark, d):
    """Drops of recall with budget in one mode, within a task and repeat; failed runs don't count."""
    runs = results(spark, d).filter((F.col("mode") == "1-URGENT") & (F.col("flag") != "R"))
    w = Window.partitionBy("task", "repeat").orderBy("budget", "tokens", "recall_pct")
    return runs.withColumn("before", F.lag("recall_pct").over(w)).groupBy("task", "repeat").agg(F.count_if(F.col("recall_pct") < F.col("before")).alias("failures"))


#: Truth: a task's urgent orders; found: its orders by price.
FOUND = """truth AS (SELECT o_custkey AS task, o_orderkey AS item FROM orders WHERE o_orderpriority = '1-URGENT'), found AS (SELECT o_custkey AS task, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)"""


def truth_and_found(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tasks, items that each needs, and items found by place."""
    o = corpus.table(spark, d, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("item"), "o_totalprice", "o_orderpriority")
    found = o.withColumn("place", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("o_totalprice"), "item"))).select("task", "item", "place")
    tasks = corpus.table(spark, d, "customer").select(F.col("c_custkey").alias("task"))
    return tasks, o.filter("o_orderpriority = '1-URGENT'").select("task", "item"), found


@query("topk_recall", f"""WITH {FOUND}, t AS (SELECT t.task, count(f.item)::DOUBLE / count(*) AS recall FROM truth t LEFT JOIN found f ON t.task = f.task AND t.item = f.item AND f.place <= 5 GROUP BY t.task)
    SELECT c_custkey AS task, round(coalesce(recall, 1.0), 6) AS recall FROM customer LEFT JOIN t ON c_custkey = task""")
def topk_recall(spark, d):
    """The share of what a task needs among its first five; a task that needs nothing has 1."""
    tasks, truth, found = truth_and_found(spark, d)
    hits = truth.join(found.filter("place <= 5").select("task", "item", F.lit(1).alias("hit")), ["task", "item"], "left")
    recall = hits.groupBy("task").agg((F.count("hit").cast("double") / F.count(F.lit(1))).alias("recall"))
    return tasks.join(recall, "task", "left").select("task", F.round(F.coalesce("recall", F.lit(1.0)), 6).alias("recall"))


@query("precision", f"""WITH {FOUND} SELECT c_custkey AS task, round(count(t.item)::DOUBLE / nullif(count(f.item), 0), 6) AS precision FROM customer LEFT JOIN found f ON c_custkey = f.task AND f.place <= 5
    LEFT JOIN truth t ON t.task = f.task AND t.item = f.item GROUP BY c_custkey""")
def precision(spark, d):
    """The share of a task's first five that it needs; null where nothing is found."""
    tasks, truth, found = truth_and_found(spark, d)
    shown = tasks.join(found.filter("place <= 5"), "task", "left").join(truth.withColumn("hit", F.lit(1)), ["task", "item"], "left")
    return shown.groupBy("task").agg(F.round(F.try_divide(F.count("hit").cast("double"), F.count("item")), 6).alias("precision"))


@query("scored_results", f"""WITH {SCORED_RUNS} SELECT task, mode, budget, repeat, tokens, round(recall, 6) AS recall, round(saving, 6) AS saving, round(scoped_saving, 6) AS scoped_saving,
    wrong AS false_sufficiency, needless AS false_insufficiency, error FROM s""")
def scored_results(spark, d):
    rounded = [F.round(k, 6).alias(k) for k in ("recall", "saving", "scoped_saving")]
    return evaluation.scored(runs(spark, d)).select("task", "mode", "budget", "repeat", "tokens", *rounded, "false_sufficiency", "false_insufficiency", "error")


@query("fingerprints", "SELECT l_orderkey, sha256(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, '|' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS fingerprint FROM lineitem GROUP BY l_orderkey")
def fingerprints(spark, d):
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")]).alias("s"))
    g = corpus.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return g.select("l_orderkey", F.sha2(F.array_join(F.transform("x", lambda x: x["s"]), "|"), 256).alias("fingerprint"))


@query("early_stop_totals", f"WITH {SCORED_RUNS} SELECT category, count(*)::BIGINT AS tasks, sum(tokens)::BIGINT AS tokens, sum(reads)::BIGINT AS reads, sum(rounds)::BIGINT AS rounds FROM stops GROUP BY category")
def early_stop_totals(spark, d):
    g = evaluation.early_stops(runs(spark, d)).groupBy("category")
    return g.agg(F.count(F.lit(1)).alias("tasks"), *[F.sum(k).alias(k) for k in ("tokens", "reads", "rounds")])


@query("gate_validation", f"""WITH {SCORED_RUNS}, r AS ({REPORT_SQL}), e AS (SELECT count(*) AS n, count(*) FILTER (WHERE wrong) AS bad, avg(recall) AS recall FROM main WHERE top AND class LIKE 'supported%')
    SELECT provider_fabrication = 0 AS provider_fabrication_zero, cross_repo_leaks = 0 AS cross_repo_leakage_zero, budget_violations = 0 AS budget_violations_zero, false_sufficiency = 0 AS false_sufficiency_zero, runtime_errors = 0 AS runtime_errors_zero,
    NOT EXISTS (FROM s WHERE mode = 'panoramic' AND tokens <> baseline) AS panoramic_baseline_zero, NOT EXISTS (FROM s WHERE mode = 'scoped_panoramic' AND tokens <> scoped_baseline) AS scoped_baseline_zero,
    nondeterministic AS determinism_failures, recall >= 0.95 AS supported_recall_at_least_95, n > 0 AND bad / n < 0.05 AS false_sufficiency_below_5, median_supported_saving >= 0.5 AS token_reduction_at_least_50 FROM r, e""")
def gate_validation(spark, d):
    return evaluation.gates(runs(spark, d))


@query("determinism", f"""WITH {RESULTS}, p AS (SELECT task, repeat, sha256(string_agg(mode || ':' || budget || ':' || tokens, '|' ORDER BY mode, budget, tokens)) AS print FROM results GROUP BY ALL)
    SELECT task, count(*)::BIGINT AS repeats, count(DISTINCT print) > 1 AS varies FROM p GROUP BY task""")
def determinism(spark, d):
    """Whether the repeats of a task differ: the fingerprints of all that each returned, in order."""
    item = F.struct("mode", "budget", "tokens", F.concat_ws(":", "mode", F.col("budget").cast("string"), F.col("tokens").cast("string")).alias("s"))
    runs = results(spark, d).groupBy("task", "repeat").agg(F.array_sort(F.collect_list(item)).alias("x"))
    prints = runs.select("task", F.sha2(F.array_join(F.transform("x", lambda x: x["s"]), "|"), 256).alias("print"))
    return prints.groupBy("task").agg(F.count(F.lit(1)).alias("repeats"), (F.count_distinct("print") > 1).alias("varies"))
