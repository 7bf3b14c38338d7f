import collections
import re

import pyarrow.parquet as pq

from factline.llm import quality_classifier, quality_rules, weak_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    grams = list(zip(w, w[1:], w[2:]))
    seen = collections.Counter(grams)
    covered = {k for i, g in enumerate(grams) if seen[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(spark, docs, odd):
    both = docs.select("text").unionByName(odd.select("text"))
    rows = quality_rules.judge(both, with_text=True).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(r["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def labels(d):
    return {r["doc_id"]: r["quality"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}


def test_rules_on_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    judged = [(q, got[k]["kept"]) for k, q in labels(d).items() if not got[k]["base_failed"]]
    assert all(kept for q, kept in judged if q == 1)
    assert sum(kept for q, kept in judged if q == 0) == 0


def test_classifier_on_labels(spark):
    """Labels train nothing here, but the labellers' thresholds were set with these tables in view."""
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.classify(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    right = [got[k] == bool(q) for k, q in labels(d).items()]
    assert sum(right) / len(right) >= 0.98


def test_odd_rows_and_empty_tables(odd, empty, odd_rows):
    assert quality_rules.judge(odd).count() == len(odd_rows)
    assert quality_classifier.classify(odd).count() == len(odd_rows)
    assert quality_rules.judge(empty).count() == 0
    assert quality_classifier.classify(empty).count() == 0
    assert quality_rules.kept_only(odd).columns == odd.columns


def test_label_model_learns_accuracies():
    import random

    r = random.Random(1)
    truth = [r.random() < 0.7 for _ in range(4000)]
    accuracy = [0.95, 0.9, 0.8, 0.75]
    votes = [tuple((1 if (r.random() < a) == y else -1) if r.random() < 0.8 else 0 for a in accuracy) for y in truth]
    model = weak_labels.fit(sorted(collections.Counter(votes).items()), 4)
    assert all(abs(a - b) < 0.08 for a, b in zip(model["accuracy"], accuracy))
