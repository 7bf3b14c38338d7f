"""Quality classifier: heuristic labellers, weighed by a label model, teach a hashed linear scorer.

The labellers' votes on all documents give pattern counts, from which expectation-maximisation estimates their
accuracies.  The posterior labels of a bounded sample train logistic regression on hashed features (shapes of words,
their ends, and shares of repeats), and the scorer then judges every document, also where all labellers abstain.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm import weak_labels
from factline.llm.quality_rules import COMMON
from factline.llm.storage import cut
from factline.llm.text import packed, unpacked
from factline.llm.token_counts import slices

LABELLERS = ["marked", "shouted", "barred", "stuck", "plain", "worded"]
#: Hashed features; documents of the training sample, those of the smallest hashes.
DIMS, SAMPLE = 1024, 8000
#: Texts of fewer characters, blanks aside, have smaller features.
SHORT = 80
#: Characters of a piece; longer words are read as several pieces, each like a word.
PIECE = 64
#: Words that a task remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
LETTERS = re.compile(r"[^\W\d_]+")
RUNS = re.compile(r"(.)\1+")


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIMS


def shape(word: str) -> str:
    """Letters to X or x, digits to 9, the rest as it is, runs to one."""
    out = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return RUNS.sub(r"\1", out)


#: Bits of what a word tells the labellers.
MARKED, SHOUTED, BAR, COMMON_WORD = 1, 2, 4, 8


class Reader:
    """Votes and features of whole texts; each word's slots and bits are worked out once a task."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.common = set(COMMON)
        self.shares = [_slot(f"={k}") for k in range(24)]

    def word(self, w: str) -> int:
        form = shape(w)
        bits = 0
        if len(form) > 1 and any(c in "#*$%&<>|" for c in form):
            bits |= MARKED
        if sum(c.isupper() for c in w) >= 2 and w.upper() == w:
            bits |= SHOUTED
        if w == "|":
            bits |= BAR
        if w.strip(".,;:!?").lower() in self.common:
            bits |= COMMON_WORD
        return (_slot(form) << 20) | (_slot("$" + w[-2:].lower()) << 8) | bits

    def codes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.word(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def read(self, text: str | None, featured: bool = True) -> tuple[list[int], int, np.ndarray | None]:
        words = (text or "").split()
        n = len(words)
        if not n:
            return [0] * len(LABELLERS), 0, np.zeros(DIMS, dtype=np.float32)
        n_words = n
        if len(max(words, key=len)) > PIECE:
            words = [w[k : k + PIECE] for w in words for k in range(0, len(w), PIECE)]
            n = len(words)
        code = self.codes(words)
        share = [float(np.count_nonzero(code & bit)) / n for bit in (MARKED, SHOUTED, BAR, COMMON_WORD)]
        stuck = sum(map(str.__eq__, words, words[1:])) / n
        kinds = len(set(words)) / n
        common = share[3] * n / n_words
        clean = share[0] < 0.02 and share[1] < 0.05 and share[2] < 0.01
        votes = [
            -1 if share[0] > 0.15 else 0,
            -1 if share[1] > 0.30 else 0,
            -1 if share[2] > 0.10 else 0,
            -1 if n >= 30 and stuck > 0.20 else 0,
            1 if clean and stuck < 0.02 else 0,
            (1 if common > 0.12 else -1 if common < 0.02 else 0) if n_words >= 30 else 0,
        ]
        if not featured:
            return votes, n_words, None
        x = np.bincount(code >> 20, minlength=DIMS) + 0.5 * np.bincount(code >> 8 & 0xFFF, minlength=DIMS)
        x = np.sqrt(x / n) * min(1.0, sum(map(len, words[:SHORT])) / SHORT)  # a few characters are little evidence either way
        for k, v in enumerate([*share, stuck, 1 - kinds if n >= 30 else 0.0]):
            x[self.shares[k]] += 2.0 * v
        return votes, n_words, x.astype(np.float32)


def _votes():
    kind = pa.struct([("n_words", pa.int64()), *((x, pa.int32()) for x in LABELLERS)])

    @F.arrow_udf("n_words long, " + ", ".join(f"{x} int" for x in LABELLERS))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader()
        for texts in batches:
            out = []
            for part in slices(texts):
                for text in part:
                    votes, n, _ = reader.read(text, featured=False)
                    out.append({"n_words": n, **dict(zip(LABELLERS, votes, strict=True))})
            yield pa.array(out, kind)

    return run


def _features():
    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader()
        for texts in batches:
            yield pa.array([reader.read(t)[2].tobytes() for part in slices(texts) for t in part], pa.binary())

    return run


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 2.0, decay: float = 1e-4, keep: float = 0.9) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by gradient steps with momentum over all rows; it starts from the share of good
    ones, so a text that tells little is judged by that share."""
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    if not len(x):
        return w, b
    good = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b = float(np.log(good / (1 - good)))
    move, shift = np.zeros_like(w), 0.0
    for _ in range(rounds):
        miss = ((1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / len(y)).astype(np.float32)
        move = keep * move - rate * (x.T @ miss + decay * w)
        shift = keep * shift - rate * float(miss.sum())
        w, b = w + move, b + shift
    return w, b


def _scorer(w: np.ndarray, b: float):
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader()
        for texts in batches:
            out = [float(1 / (1 + np.exp(-np.clip(reader.read(t)[2] @ w + b, -30, 30)))) for part in slices(texts) for t in part]
            yield pa.array(out, pa.float64())

    return run


def classify(docs: DataFrame, text: str = "text", sample: int = SAMPLE, keep_at: float = 0.5) -> DataFrame:
    """``docs`` without its text, with ``quality`` (probability of being good) and ``kept`` added.

    A null or empty text has no features and gets the scorer's constant.  Repeated rows score alike; an empty table gives
    an empty one and trains nothing.  ``sample`` bounds the training rows (DIMS 4-byte features each) that reach the
    driver; label counts cover all documents.  No shuffle but of pattern counts and of the sample's smallest hashes.
    """
    rows = packed(docs, text, text)
    voted = rows.select(F.xxhash64("_text").alias("_hash"), _votes()("_text").alias("_v")).select("_hash", "_v.*")
    voted = cut(voted, "label-votes")
    model = weak_labels.fit(weak_labels.pattern_counts(voted, LABELLERS), len(LABELLERS))
    judged = voted.withColumn("p", weak_labels.probability(model, LABELLERS)).filter("n_words > 0")
    chosen = judged.groupBy("_hash").agg(F.min("p").alias("p")).orderBy("_hash").limit(sample)  # texts, each once
    found = rows.select(F.xxhash64("_text").alias("_hash"), "_text").join(F.broadcast(chosen), "_hash")  # ``sample`` rows
    found = found.groupBy("_hash").agg(F.first("_text").alias("_text"), F.first("p").alias("p"))
    sampled = sorted(found.select("_hash", "p", _features()(F.col("_text")).alias("x")).collect())
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in sampled]) if sampled else np.zeros((0, DIMS), dtype=np.float32)
    w, b = train(x, np.array([r["p"] for r in sampled]))
    scored = rows.withColumn("_quality", _scorer(w, b)("_text"))
    return unpacked(scored, docs, {"quality": F.col("_quality"), "kept": F.col("_quality") >= keep_at}, text)
