import collections
import math
import random

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from factline.llm import lm_scores, mixing, packing, quality_rules, queries
from test_lines_and_mix import brute_lines

D = "/root/testdata/sf0.001"


def brute_scores(rows):
    words = [(i, (t or "").encode().lower().split()) for i, t in rows]
    one, two = collections.Counter(), collections.Counter()
    for _, w in words:
        one.update(w)
        two.update(zip(w, w[1:]))
    total, out = sum(one.values()), []
    for i, w in words:
        own1, own2, s = collections.Counter(w), collections.Counter(zip(w, w[1:])), 0.0
        n = max(total - len(w), 1)
        for k, x in enumerate(w):
            pair = two[w[k - 1], x] - own2[w[k - 1], x] if k else 0
            if pair > 0:
                s += math.log(pair) - math.log(one[w[k - 1]] - own1[w[k - 1]])
            else:
                left = one[x] - own1[x]
                s += (math.log(0.4) if k else 0.0) + (math.log(left / n) if left > 0 else math.log(0.5 / n))
        out.append((str(i), len(w), s / len(w) if w else None))
    return sorted(out, key=repr)


def same(got, want):
    got = sorted(((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in got), key=lambda r: (r[0], r[1], r[2] or 0))
    want = sorted(want, key=lambda r: (r[0], r[1], r[2] or 0))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(a[2] == b[2] if None in (a[2], b[2]) else abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, want))


def test_scores_against_brute_force(docs, texts, monkeypatch):
    same(lm_scores.score(docs).collect(), brute_scores(list(texts.items())))
    monkeypatch.setattr(lm_scores, "SLICE", 30_000)
    monkeypatch.setattr(lm_scores, "FREQUENT", 20)
    monkeypatch.setattr(lm_scores, "SHARE", 10**6)
    same(lm_scores.score(docs).collect(), brute_scores(list(texts.items())))


def test_packing_round_trips():
    r = np.random.default_rng(3)
    for n in (0, 1, 500):
        h = np.concatenate([np.sort(r.integers(0, 2**64, n, dtype=np.uint64)), np.sort(r.integers(0, 2**64, n, dtype=np.uint64))])
        assert (packing.unpack_hashes(packing.pack_hashes(h)) == h).all()


def test_scores_of_odd_rows(odd, odd_rows, empty):
    same(lm_scores.score(odd).collect(), brute_scores([r[:2] for r in odd_rows]))
    assert lm_scores.score(empty).count() == 0


def test_trigrams_prefer_what_others_hold(spark):
    rows = [(i, "one two three four five six") for i in range(5)] + [(9, "six four two one three five")]
    got = {r["doc_id"]: r["log_score"] for r in lm_scores.score(spark.createDataFrame(rows, "doc_id long, text string"), order=3).collect()}
    assert got[0] > got[9]


def shingles(text, k=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_each_stage_against_brute_force(spark, docs):
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = stages[0](spark, docs, D)
    verdict = {r["doc_id"] for r in quality_rules.judge(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == verdict and kept.columns == docs.columns
    lines = stages[1](spark, kept, D)
    before = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = {i: t for i, _, _, t in brute_lines(before, 40, 5)}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want and lines.columns == docs.columns
    single = stages[2](spark, lines, D)
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    sets = {i: shingles(t) for i, t in want.items()}
    for i in want:
        reached, front = {i}, [i]
        while front:
            a = front.pop()
            front += [k for k in want if k not in reached and len(sets[a] & sets[k]) >= 0.8 * len(sets[a] | sets[k])]
            reached |= set(front)
        assert (i in left) == (min(reached) == i)
    mixed = stages[3](spark, single, D)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(single).collect() if r["copies"]}
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == copies and mixed.columns == docs.columns
    coded = stages[4](spark, mixed, D).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r["exact"] and r["ids"] == library.encode(left[r["doc_id"]]) for r in coded)
    whole = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, D).collect())
    assert whole == sorted((r["doc_id"], r["n_tokens"]) for r in coded)


def test_one_of_each_group_stays_whatever_its_ids(spark, odd, odd_rows):
    from samples import SCHEMA

    left = corpus_pipeline.near_duplicates(spark, odd, D).collect()
    got = collections.Counter(r["text"] or "" for r in left)
    blank = [t for t in got if not t.split()]
    assert len(blank) == 1 and max(got.values()) == 1
    assert {t for t in got if t.split()} <= {r[1] for r in odd_rows}
    assert {r[0] for r in odd_rows[:12]} <= {r["doc_id"] for r in left}
    twins = spark.createDataFrame([r for r in odd_rows if r[0] is None], SCHEMA)
    assert corpus_pipeline.near_duplicates(spark, twins, D).count() == 2


def test_repeated_ids_go_as_often_as_taken(spark):
    rows = [(1, f"word{i % 3} " * (1 + i % 3), "en", f"s{i % 2}", None) for i in range(9)] + [(None, "a b c", "en", None, 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["size"], r["source"]] += r["copies"]
    got = collections.Counter((r["doc_id"], len(r["text"].split()), r["source"]) for r in corpus_pipeline.mixture(spark, docs, D).collect())
    assert got == +want


def test_stages_take_odd_rows(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, D)
        assert out.count() <= 3 * odd.count()
        assert stage(spark, empty, D).count() == 0
        if name != "piece encoding":
            assert sorted(out.columns) == sorted(odd.columns)


def test_every_query_has_whole_results(spark, texts):
    random.seed(0)
    for name, query in queries.QUERIES.items():
        assert query(spark, D).count() == len(texts), name
