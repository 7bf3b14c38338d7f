"""Blocks, ranges and orders of the language-model scores; what they shuffle and what they leave."""

import collections
import math
import time

import pytest
from pyspark.sql import functions as F

from factline.llm import lm_scores, storage
from test_lm_and_pipeline import same


def brute(rows, order, held_out):
    """Stupid backoff of any order, word by word."""
    words = [(i, (t or "").encode().lower().split()) for i, t in rows]
    every = lambda w: collections.Counter(tuple(w[a : a + k]) for k in range(1, order + 1) for a in range(len(w) - k + 1))
    total = collections.Counter()
    for _, w in words:
        total.update(every(w))
    size, out = sum(len(w) for _, w in words), []
    for i, w in words:
        own, s = every(w) if held_out else collections.Counter(), 0.0
        n = max(size - len(w) * held_out, 1)
        times = lambda g, own=own, n=n: total[g] - own[g] if g else n
        for at in range(len(w)):
            longest = min(order, at + 1)
            grams = [tuple(w[at + 1 - k : at + 1]) for k in range(longest, 0, -1)]
            g = next((g for g in grams if times(g) > 0), None)
            s += (longest - len(g or "1")) * math.log(0.4) + (math.log(times(g) / times(g[:-1])) if g else math.log(0.5 / n))
        out.append((str(i), len(w), s / len(w) if w else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order, held_out", [(1, True), (3, True), (3, False), (4, True)])
def test_orders_against_brute_force_over_many_blocks(odd, odd_rows, monkeypatch, order, held_out):
    monkeypatch.setattr(lm_scores, "SLICE", 40_000)
    monkeypatch.setattr(lm_scores, "RANGE", 30_000)
    want = brute([r[:2] for r in odd_rows], order, held_out)
    same(lm_scores.score(odd, order=order, held_out=held_out).collect(), want)
    monkeypatch.setattr(lm_scores, "SHARE", 2)  # fewer tasks than blocks and ranges
    same(lm_scores.score(odd, order=order, held_out=held_out).collect(), want)


def test_blanks_split_words_as_everywhere(spark):
    rows = [(1, "  Ab c\x0bd\x1ce \x85\xa0X\r\n"), (2, "ab C"), (3, "\f \t"), (4, ""), (5, "É世 \x00 b\x0c")]
    same(lm_scores.score(spark.createDataFrame(rows, "doc_id long, text string"), order=3).collect(), brute(rows, 3, True))


def test_blocks_of_distinct_words_only(spark, monkeypatch):
    monkeypatch.setattr(lm_scores, "SLICE", 1)  # a block for each of most documents
    rows = [(i, f" {a} {b}") for i, (a, b) in enumerate(["ab", "ab", "ab", "ba", "bc", "ca", "cb", "cd", "da"])] + [(20, "a"), (21, "d"), (22, "b b")]
    same(lm_scores.score(spark.createDataFrame(rows, "doc_id long, text string"), order=3).collect(), brute(rows, 3, True))


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    found = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_shuffles_are_few_bytes_and_go_between_orders(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    before, files = shuffled(spark), shuffle_files(spark)
    found = lm_scores.score(docs, order=3)
    end = time.time() + 20
    while (left := shuffle_files(spark) - files) and time.time() < end:
        time.sleep(0.5)  # they are deleted in the background
    assert len([x for x in left if x.endswith(".data")]) <= 4  # at most of the size's sum, a row a task
    found.write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 6 * size  # a row of its own for each n-gram of a document took 10.6 times


def test_sums_and_join_share_one_shuffle_of_ngrams(docs):
    rows = docs.select(F.col("doc_id").alias("doc"), "text", (F.col("doc_id") % 3).cast("int").alias("block"))
    with storage.settings(docs.sparkSession, lm_scores.DEALT_ONCE):
        found = lm_scores._totals(rows, 1, 2, 5, 2)
        assert found.count() and found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    dealt = [x for x in plan.splitlines() if "shufflepartitionidpassthrough" in x]
    assert len(dealt) == 2 and sum("ReusedExchange" in x for x in dealt) == 1, plan


def test_settings_come_back(spark):
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), storage.settings(spark, {key: "false", "spark.none.such": "1"}):
        assert spark.conf.get(key) == "false"
        1 / 0
    assert spark.conf.get(key) == before and spark.conf.get("spark.none.such", None) is None
