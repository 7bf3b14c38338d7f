"""Suffix arrays of many short segments, by induced sorting, with their permuted common prefixes; all in numpy.

Buckets of equal first symbols are processed in order, each as a whole: what a bucket's suffixes induce into it (runs of
one symbol) takes a round a repetition, what they induce into later buckets is one stable counting step.  Suffixes need
to be in order by their first ``depth`` symbols only, so the recursion on the names of leftmost-smaller substrings ends
in rank doubling over as many names as can matter.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their right neighbour's (a virtual least symbol follows the last)."""
    n = len(text)
    step = np.empty(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    step[-1] = -1
    where = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(where[::-1])[::-1]] > 0


def _deal(out: np.ndarray, at: np.ndarray, symbol: np.ndarray, items: np.ndarray, forward: bool) -> None:
    """Append items to their symbols' buckets in order; ``at`` holds the next free place of each."""
    order = np.argsort(symbol, kind="stable")
    counts = np.bincount(symbol, minlength=len(at))
    begin = np.cumsum(counts) - counts
    sorted_symbol = symbol[order]
    rank = np.arange(len(items)) - begin[sorted_symbol]
    out[at[sorted_symbol] + rank if forward else at[sorted_symbol] - rank] = items[order]
    at += counts if forward else -counts


def induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones in order (of whatever prefix the seeds are in order by)."""
    n = len(text)
    counts = np.bincount(text, minlength=symbols)
    end = np.cumsum(counts)
    begin = end - counts
    out = np.full(n, -1, dtype=np.int32)
    seed_counts = np.bincount(text[seeds], minlength=symbols)
    by = np.argsort(text[seeds], kind="stable")
    seed_begin = np.cumsum(seed_counts) - seed_counts
    grouped = seeds[by]
    head, tail = begin.copy(), end - 1
    last = n - 1  # its right neighbour is the virtual least symbol, so it comes first of all
    out[head[text[last]]] = last
    head[text[last]] += 1
    used = np.flatnonzero(counts)
    for c in used.tolist():  # larger ones, left to right
        a = begin[c]
        while a < head[c]:
            here = out[a : head[c]]
            a = head[c]
            before = here[here > 0] - 1
            own = before[(text[before] == c) & ~smaller[before]]
            out[head[c] : head[c] + len(own)] = own
            head[c] += len(own)
        entries = np.concatenate((out[begin[c] : head[c]], grouped[seed_begin[c] : seed_begin[c] + seed_counts[c]]))
        before = entries[entries > 0] - 1
        before = before[~smaller[before]]
        symbol = text[before]
        on = symbol > c
        if on.any():
            _deal(out, head, symbol[on], before[on], True)
    for c in used[::-1].tolist():  # smaller ones, right to left
        a = end[c] - 1
        while a > tail[c]:
            here = out[tail[c] + 1 : a + 1][::-1]
            a = tail[c]
            before = here[here > 0] - 1
            own = before[(text[before] == c) & smaller[before]]
            out[tail[c] - len(own) + 1 : tail[c] + 1] = own[::-1]
            tail[c] -= len(own)
        entries = np.concatenate((out[tail[c] + 1 : end[c]][::-1], out[begin[c] : head[c]][::-1]))
        before = entries[entries > 0] - 1
        before = before[smaller[before]]
        symbol = text[before]
        on = symbol < c
        if on.any():
            _deal(out, tail, symbol[on], before[on], False)
    return out


def name_substrings(text: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names, in text order, of leftmost-smaller substrings given in order: equal ones share a name."""
    n, m = len(text), len(lms)
    place = np.full(n, -1, dtype=np.int64)
    place[lms] = np.arange(m)
    size = np.empty(m, dtype=np.int64)
    size[:-1] = np.diff(lms) + 1
    size[-1] = n - lms[-1] + 1
    k = place[order]
    a, b = order[:-1], order[1:]
    new = size[k[:-1]] != size[k[1:]]
    new |= (size[k[:-1]] + lms[k[:-1]] > n) | (size[k[1:]] + lms[k[1:]] > n)  # the last reaches the virtual symbol
    left = np.flatnonzero(~new)
    for offset in range(int(size[k].max()) if m else 0):
        left = left[size[k[left]] > offset]
        if not len(left):
            break
        differ = text[a[left] + offset] != text[b[left] + offset]
        new[left[differ]] = True
        left = left[~differ]
    names = np.empty(m, dtype=np.int64)
    names[k] = np.concatenate(([0], np.cumsum(new)))
    return names


def rank_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by ``depth`` names at least."""
    m, rank, reach = len(names), names, 1
    while True:
        top = int(rank.max()) + 1
        if reach >= depth or top == m:
            return np.argsort(rank, kind="stable")
        ahead = np.zeros(m, dtype=np.int64)
        ahead[:-reach] = rank[reach:] + 1 if reach < m else ahead[:-reach]
        key = rank * (top + 1) + ahead
        order = np.argsort(key, kind="stable")
        rank = np.empty(m, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        reach *= 2


def suffix_array(text: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """Suffixes in order by their first ``depth`` symbols at least; symbols are below ``symbols``."""
    if len(text) < 2:
        return np.arange(len(text), dtype=np.int32)
    smaller = classify(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    if len(lms) < 2:
        return induce(text, smaller, lms, symbols)
    is_lms = np.zeros(len(text), dtype=bool)
    is_lms[lms] = True
    rough = induce(text, smaller, lms, symbols)
    rough = rough[is_lms[rough]]
    names = name_substrings(text, rough, lms)
    if names.max() + 1 == len(lms):
        order = rough
    elif names.max() < 1024:  # few names: buckets pay off once more
        order = lms[suffix_array(names.astype(np.int16), int(names.max()) + 1, depth // 2 + 1)]
    else:
        order = lms[rank_doubling(names, depth // 2 + 1)]
    return induce(text, smaller, order, symbols)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The permuted common prefixes of a text of bytes: by text position, the common prefix with the suffix before it in
    order, counted up to ``most``; eight bytes at a time."""
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    raw = np.concatenate((text.astype(np.uint8), np.zeros(most + 16, dtype=np.uint8)))
    word = np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw, (n + most + 8, 8), (1, 1))).view("<u8").ravel()
    out = np.zeros(n, dtype=np.int32)
    at = np.flatnonzero(before >= 0)
    other = before[at]
    for offset in range(0, most, 8):
        differ = word[at + offset] ^ word[other + offset]
        equal = differ == 0
        part, low = at[~equal], differ[~equal]
        same = np.zeros(len(low), dtype=np.int32)  # equal bytes of the first word that differs
        for k in range(1, 8):
            same += low & np.uint64((1 << 8 * k) - 1) == 0
        out[part] = offset + same
        at, other = at[equal], other[equal]
        out[at] = offset + 8
        if not len(at):
            break
    return np.minimum(np.minimum(out, most), n - np.maximum(before, np.arange(n))).astype(np.int32)


def equal_windows(order: np.ndarray, prefixes: np.ndarray, width: int) -> np.ndarray:
    """A number for every position: positions share it if their suffixes hang together by common prefixes of ``width``."""
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(prefixes[order] < width)
    return group
