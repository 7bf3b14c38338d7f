"""Token counts under a byte-level BPE vocabulary, by rank-synchronous array merging.

Pre-tokens of a batch lie one after another in a flat symbol array.  Each round finds every sequence's lowest-rank
pair, merges all its (leftmost, not overlapping) occurrences in all sequences at once, and closes the gaps; a sequence
without a mergeable pair leaves with its count of surviving symbols.  Texts are first cut into chunks at blanks, where no
pre-token can continue, and only chunks new to the task are merged.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.text import packed, unpacked

#: Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer sequences are merged one by one with a heap: rounds over all of them would cost their length squared.
LONG = 1024
#: Chunks that a task remembers; beyond it the memory starts anew.
REMEMBERED = 600_000
NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in set(plain):
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def load_bpe(path: str) -> dict:
    """Vocabulary file to arrays: pair keys in order, their ranks, merged symbols, and the symbol of each byte."""
    with open(path, encoding="utf-8") as f:
        whole_file = json.load(f)
    vocab, merges = whole_file["model"]["vocab"], whole_file["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    size = max(vocab.values()) + 1
    keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
    return {
        "size": size,
        "keys": keys[order],
        "ranks": order.astype(np.int32),
        "merged": merged,
        "bytes": np.array([vocab[c] for c in byte_letters()], dtype=np.int32),
        "special": [t["content"] for t in whole_file["added_tokens"]],
    }


def pair_ranks(bpe: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = left.astype(np.int64) * bpe["size"] + right
    at = np.minimum(np.searchsorted(bpe["keys"], key), len(bpe["keys"]) - 1)
    return np.where(bpe["keys"][at] == key, bpe["ranks"][at], NONE)


def merge_long(bpe: dict, sym: np.ndarray) -> int:
    """Surviving symbols of one long sequence: lowest rank first, leftmost first."""
    n, s = len(sym), sym.tolist()
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    known = dict(zip(bpe["keys"].tolist(), bpe["ranks"].tolist(), strict=True))
    size, merged = bpe["size"], bpe["merged"]
    heap = [(r, i) for i, r in enumerate(pair_ranks(bpe, sym[:-1], sym[1:]).tolist()) if r != NONE]
    heapq.heapify(heap)
    alive = n
    while heap:
        r, i = heapq.heappop(heap)
        j = right[i] if s[i] >= 0 else n
        if j >= n or known.get(s[i] * size + s[j]) != r:
            continue
        s[i], s[j] = int(merged[r]), -1
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        alive -= 1
        for a in (left[i], i):
            if a >= 0 and right[a] < n and (k := known.get(s[a] * size + s[right[a]])) is not None:
                heapq.heappush(heap, (k, a))
    return alive


def merge_counts(bpe: dict, sequences: list[bytes]) -> np.ndarray:
    """Surviving symbols of each sequence, all merged together round by round."""
    out = np.array([len(x) for x in sequences], dtype=np.int64)
    for k in np.flatnonzero(out > LONG):
        out[k] = merge_long(bpe, bpe["bytes"][np.frombuffer(sequences[k], dtype=np.uint8)])
    rows = np.flatnonzero((out > 1) & (np.array([len(x) for x in sequences]) <= LONG)) if len(out) else out
    if not len(rows):
        return out
    sym = bpe["bytes"][np.frombuffer(b"".join([sequences[k] for k in rows]), dtype=np.uint8)]
    size = out[rows]
    rank = None
    while len(rows):
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        last = start + size - 1
        if rank is None:
            rank = np.full(len(sym), NONE, dtype=np.int32)
            rank[:-1] = pair_ranks(bpe, sym[:-1], sym[1:])
            rank[last] = NONE
        low = np.minimum.reduceat(rank, start)
        out[rows] = size
        live = low != NONE
        if not live.all():
            keep = np.repeat(live, size)
            sym, rank, rows, size, low = sym[keep], rank[keep], rows[live], size[live], low[live]
            if not len(rows):
                break
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
        hit = rank == np.repeat(low, size)
        at = np.flatnonzero(hit)
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = at[1:] != at[:-1] + 1
        if not fresh.all():  # of pairs that overlap, every second one from the left
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        sym[at] = bpe["merged"][rank[at]]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        owner = np.searchsorted(start, at, side="right") - 1
        size = size - np.bincount(owner, minlength=len(size))
        moved = np.cumsum(keep) - 1
        at = moved[at]
        sym, rank = sym[keep], rank[keep]
        last = np.zeros(len(sym), dtype=bool)
        last[np.cumsum(size) - 1] = True
        for touched in (at, at[at > 0] - 1):
            touched = touched[~last[touched]]
            rank[touched] = pair_ranks(bpe, sym[touched], sym[touched + 1])
        rank[last] = NONE
    return out


class Counter:
    """Counts of whole texts; chunks seen before in this task are looked up."""

    def __init__(self, bpe: dict):
        import re

        import regex

        self.bpe, self.seen = bpe, {}
        self.pieces = regex.compile(PATTERN).findall
        self.chunks = re.compile(r"\s*\S+|\s+").findall
        #: Control characters that count as blanks for one library and not for the other: such texts stay in one chunk.
        self.odd = re.compile("[\x1c-\x1f]").search
        self.special = re.compile("|".join(map(re.escape, bpe["special"]))) if bpe["special"] else None

    def split(self, text: str) -> list[str]:
        return [text] if self.odd(text) else self.chunks(text)

    def learn(self, fresh: list[str]) -> None:
        parts = [self.pieces(c) for c in fresh]
        sizes = [len(p) for p in parts]
        flat = list(dict.fromkeys(x for p in parts for x in p))
        counts = dict(zip(flat, merge_counts(self.bpe, [x.encode("utf-8", "surrogatepass") for x in flat]).tolist(), strict=True))
        for c, p, n in zip(fresh, parts, sizes, strict=True):
            self.seen[c] = counts[p[0]] if n == 1 else sum([counts[x] for x in p])

    def count(self, texts: list[str | None]) -> list[int]:
        out, work = [], []
        for text in texts:
            text, special = text or "", 0
            if self.special and "<" in text and self.special.search(text):
                parts = self.special.split(text)
                special = len(parts) - 1
            else:
                parts = [text]
            work.append((special, [c for p in parts if p for c in self.split(p)]))
        fresh = {c for _, cs in work for c in cs}
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        fresh.difference_update(self.seen)
        self.learn(list(fresh))
        look = self.seen.__getitem__
        out = [special + sum(map(look, cs)) for special, cs in work]
        return out


def slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[list]:
    """A batch as Python lists of a few MB each, so that memory doesn't follow the batch size."""
    begin, held = 0, 0
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield texts[begin:i].to_pylist()
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield texts[begin:].to_pylist()


def token_count_udf(path: str):
    """A column function: text to its number of tokens (long; null counts as empty)."""
    bpe = load_bpe(path)

    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(bpe)
        for texts in batches:
            counts: list[int] = []
            for part in slices(texts):
                counts += counter.count(part)
            yield pa.array(counts, pa.int64())

    return n_tokens


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 1024, into: str = "n_tokens") -> DataFrame:
    """Add ``n_bytes``, ``into`` and ``over_limit`` to ``docs``.

    A null or empty text has 0 tokens.  Repeated rows keep one result each; an empty table gives an empty one.  Columns
    of the same names in ``docs`` are replaced.  No shuffle; memory per task is bounded by ``REMEMBERED`` chunks, the
    slice of a batch at work, and the longest text.
    """
    rows = packed(docs, text).withColumn("_n", token_count_udf(path)("_text"))
    added = {"n_bytes": F.octet_length("_text").cast("long"), into: F.col("_n"), "over_limit": F.col("_n") > limit}
    return unpacked(rows, docs, added)
