"""Percentiles by rounds of counting, and that reports keep no buffer of all values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from factline.operators import evaluation, quantiles

from test_operators import run_table

ODD = {
    "plain": [random.Random(1).uniform(-5e4, 1) for _ in range(3000)],
    "ties": [0.5] * 500 + [0.25] * 501,
    "close": [1e6 + i * 2**-30 for i in range(2000)],
    "wide": [s * 10.0**e for e in range(-320, 309, 30) for s in (-1, 1)],
    "ends": [-math.inf, math.inf, math.nan, 1.0, 2.0, -4.0, 0.0, 3.0],
    "one": [7.0],
    "none": [None, None],
    None: [1.0, None, 4.0],
}


@pytest.mark.parametrize("parts", [64, 4096])
def test_percentiles_equal_sparks(spark, monkeypatch, parts):
    monkeypatch.setattr(quantiles, "PARTS", parts)
    rows = spark.createDataFrame([(k, x, i) for k, xs in ODD.items() for i, x in enumerate(xs)], "k string, x double, i long").repartition(3)
    shares = {f"p{i}": p for i, p in enumerate((0.0, 0.25, 0.5, 0.9, 0.95, 1.0))}
    got = quantiles.summarised(rows, ["k"], {"n": F.count(F.lit(1))}, {"x": F.col("x"), "i": F.col("i")}, {k: ("x", p) for k, p in shares.items()} | {"mid": ("i", 0.5)})
    want = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.percentile("x", p).alias(k) for k, p in shares.items()], F.percentile("i", 0.5).alias("mid"))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_groups_and_nothing(spark):
    rows = spark.range(5).filter("id > 9")
    got = quantiles.summarised(rows, [], {"n": F.count(F.lit(1))}, {"x": F.col("id")}, {"p": ("x", 0.5)})
    assert [tuple(r) for r in got.collect()] == [(0, None)]


def refused(*_):
    raise AssertionError("a buffer of all distinct values")


def test_a_report_has_no_buffer_of_all_values(spark, monkeypatch):
    monkeypatch.setattr(F, "percentile", refused)
    runs = run_table(spark, *[{"task": f"t{i}", "tokens": 3 * i + 1, "baseline": 1009, "budget": 10**6} for i in range(300)])
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    got = evaluation.report(runs).first()
    assert (got["results"], got["tasks"]) == (300, 300)
    assert got["median_tokens"] == 449.5 and got["p90_saving"] == round(1 - 90.7 / 1009, 6)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_summaries_have_no_buffer_of_all_values(spark, monkeypatch):
    monkeypatch.setattr(F, "percentile", refused)
    runs = run_table(spark, *[{"task": f"t{i % 7}", "mode": ("phase7", "manual")[i % 2], "tier": None, "tokens": i, "baseline": 1009} for i in range(301)])
    got = {(r["kind"], r["name"]): (r["results"], r["tasks"], r["median_saving"]) for r in evaluation.summaries(runs).collect()}
    main = (151, 7, round(1 - 150 / 1009, 6))
    assert got == {("mode", "phase7"): main, ("category", "c"): main, ("tier", None): main, ("mode", "manual"): (150, 7, main[2])}


def test_gates_sort_and_buffer_no_more_than_the_mode_under_test(spark, monkeypatch):
    monkeypatch.setattr(F, "percentile", refused)
    seen = []
    at_most = evaluation.at_most
    monkeypatch.setattr(evaluation, "at_most", lambda runs: at_most(seen.append(runs) or runs))
    runs = run_table(spark, *[{"task": f"t{i}", "tokens": 10 + i % 3} for i in range(60)], {"mode": "panoramic", "tokens": 40, "baseline": 41}, {"mode": "scoped_panoramic", "tokens": 40, "scoped_baseline": 40})
    got = evaluation.gates(runs).first()
    assert not got["panoramic_baseline_zero"] and got["scoped_baseline_zero"]
    assert got["supported_recall_at_least_95"] and got["false_sufficiency_below_5"] and got["token_reduction_at_least_50"]
    assert [df.count() for df in seen] == [60]
    none = evaluation.gates(run_table(spark, {"mode": "manual"}, {"mode": "panoramic", "tokens": 40, "baseline": 40})).first()
    assert none["panoramic_baseline_zero"] and not none["token_reduction_at_least_50"] and not none["supported_recall_at_least_95"] and not none["false_sufficiency_below_5"]
