"""Registered queries against the libraries, or against versions that hold all rows in memory."""

import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
import tokenizers
import xxhash

from factline.llm import quality_classifier, quality_rules, queries

D = "/root/testdata/sf0.001"


def test_token_counts_of_the_query(spark, texts):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: tuple(r) for r in queries.op1_token_counts(spark, D).collect()}
    for i, t in texts.items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (i, len((t or "").encode()), n, n > 1024)


def test_piece_digests_of_the_query(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in queries.op6_piece_codec(spark, D).collect()}
    for i, t in texts.items():
        ids = library.encode(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["exact"]
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<i4").tobytes()).hexdigest()


def posterior(votes):
    """Expectation-maximisation row by row: chances of good, from a matrix of votes."""
    good = np.where((votes < 0).any(axis=1), 0.05, 0.95)
    prior = {True: {-1: 1, 0: 10, 1: 20}, False: {-1: 20, 0: 10, 1: 4}}
    for _ in range(60):
        odds = np.full(len(votes), np.log((good.sum() + 1) / ((1 - good).sum() + 1)))
        for j in range(votes.shape[1]):
            chance = {}
            for y, weight in ((True, good), (False, 1 - good)):
                seen = {v: prior[y][v] + weight[votes[:, j] == v].sum() for v in (-1, 0, 1)}
                chance[y] = {v: n / sum(seen.values()) for v, n in seen.items()}
            odds += [np.log(chance[True][v] / chance[False][v]) for v in votes[:, j].tolist()]
        new = 1 / (1 + np.exp(-odds))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    return good


def rule_votes(r):
    n, letters = max(r["n_words"], 1), max(r["word_chars"], 1)
    low = lambda x, good, bad: -1 if x > bad else 1 if x <= good else 0
    length, much = r["word_chars"] / n, r["n_words"] >= 30
    common = r["n_common"] / n
    return [
        low(r["n_symbols"] / letters, 0.01, 0.06),
        low(r["n_repeat_words"] / n, 0.10, 0.35) if much else 0,
        low(r["n_dup_lines"] / r["n_text_lines"], 0.0, 0.30) if r["n_text_lines"] >= 4 else 0,
        -1 if length < 2 or length > 14 else 1 if 3 <= length <= 9 else 0,
        low(r["n_shouted"] / n, 0.05, 0.30),
        (-1 if common < 0.03 else 1 if common >= 0.12 else 0) if much else 0,
    ]


def test_rule_posteriors_of_the_query(spark, docs):
    rows = quality_rules.judge(docs).collect()
    good = posterior(np.array([rule_votes(r) for r in rows]))
    want = {r["doc_id"]: (round(float(p), 6), not r["base_failed"] and p >= 0.5) for r, p in zip(rows, good)}
    for r in queries.op3_quality_rules(spark, D).collect():
        assert abs(r["p_good"] - want[r["doc_id"]][0]) < 2e-6 and r["kept"] == want[r["doc_id"]][1]


def test_classifier_of_the_query(spark, texts):
    reader = quality_classifier.Reader()
    read = {i: reader.read(t) for i, t in texts.items()}
    good = dict(zip(read, posterior(np.array([v for v, _, _ in read.values()]))))
    rows = {}
    for i, (_, n, x) in read.items():
        h = xxhash.xxh64_intdigest((texts[i] or "").encode(), seed=42)
        if n > 0:
            key = h - (1 << 64) if h >> 63 else h
            rows[key] = (min(good[i], rows.get(key, (2,))[0]), x)
    assert len(rows) <= quality_classifier.SAMPLE
    x = np.array([rows[k][1] for k in sorted(rows)])
    w, b = quality_classifier.train(x, np.array([rows[k][0] for k in sorted(rows)]))
    for r in queries.op4_quality_classifier(spark, D).collect():
        want = 1 / (1 + np.exp(-np.clip(read[r["doc_id"]][2] @ w + b, -30, 30)))
        assert abs(r["quality"] - want) < 1e-4
        assert r["kept"] == (want >= 0.5) or abs(want - 0.5) < 1e-4
