"""A label model for rules that vote or abstain: expectation-maximisation over the counts of vote patterns.

Votes are 1 (good), 0 (abstain) and -1 (bad).  Each rule has its own chance of each vote for good and for bad documents;
given the class, rules are taken as independent.  With k rules there are at most 3^k patterns, so the model is fitted from
a table of bounded size, whatever the number of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOTES = (-1, 0, 1)
#: A priori votes of a rule, as counts added to those seen: rules are mostly right when they vote.
PRIOR = {True: {-1: 1.0, 0: 10.0, 1: 20.0}, False: {-1: 20.0, 0: 10.0, 1: 4.0}}


def pattern_counts(votes: DataFrame, rules: list[str]) -> list[tuple[tuple[int, ...], int]]:
    """Counts of the patterns, at most 3^k rows."""
    rows = votes.groupBy(*rules).agg(F.count(F.lit(1)).alias("_n")).collect()
    return sorted((tuple(int(r[x]) for x in rules), int(r["_n"])) for r in rows)


def fit(patterns: list[tuple[tuple[int, ...], int]], k: int, rounds: int = 60) -> dict:
    """Log-odds of good: a constant and, for each rule, one term a vote; with the rules' accuracies when they vote."""
    good = {p: (0.05 if -1 in p else 0.95) for p, _ in patterns}
    n = sum(c for _, c in patterns)
    bias, terms, accuracy = 0.0, [dict.fromkeys(VOTES, 0.0)] * k, [0.5] * k
    for _ in range(rounds if n else 0):
        up = sum(good[p] * c for p, c in patterns)
        bias = math.log((up + 1.0) / (n - up + 1.0))
        terms, accuracy = [], []
        for j in range(k):
            seen = {y: dict(PRIOR[y]) for y in (True, False)}
            for p, c in patterns:
                seen[True][p[j]] += good[p] * c
                seen[False][p[j]] += (1 - good[p]) * c
            total = {y: sum(seen[y].values()) for y in seen}
            terms.append({v: math.log(seen[True][v] / total[True]) - math.log(seen[False][v] / total[False]) for v in VOTES})
            voted = sum(seen[y][v] for y in seen for v in (-1, 1))
            accuracy.append((seen[True][1] + seen[False][-1]) / voted)
        new = {p: 1 / (1 + math.exp(-max(-500.0, min(500.0, bias + sum(t[v] for t, v in zip(terms, p, strict=True)))))) for p, _ in patterns}
        moved = max(abs(new[p] - good[p]) for p in new)
        good = new
        if moved < 1e-9:
            break
    return {"bias": bias, "terms": terms, "accuracy": accuracy}


def log_odds(model: dict, rules: list[str]) -> Column:
    out = F.lit(model["bias"])
    for name, term in zip(rules, model["terms"], strict=True):
        out = out + F.when(F.col(name) > 0, term[1]).when(F.col(name) < 0, term[-1]).otherwise(term[0])
    return out


def probability(model: dict, rules: list[str]) -> Column:
    return 1 / (1 + F.exp(-log_odds(model, rules)))
