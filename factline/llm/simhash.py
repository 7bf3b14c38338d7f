"""SimHash near-dedup: fingerprints that differ in few bits are linked, by bit-sliced comparison.

Equal fingerprints are one row from the start.  With radius r, 64 bits fall in r + 2 blocks, and two linked fingerprints
agree in two of them at least; every pair of blocks is a table of buckets.  Within a bucket, bit planes lie vertically:
bit k of all fingerprints is one row of machine words, and a few bitwise operations a plane update the distances of 64
fingerprints, kept as carry-save counters; a block is given up once all in it exceed the radius.  Only a spanning forest
of each bucket leaves its task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.llm.components import components
from factline.llm.storage import cut
from factline.llm.text import packed, unpacked, whole
from factline.llm.token_counts import slices

#: A bucket beyond this many rows is compared in parts, every part with every other: n rows travel n / PART times.
PART = 16384
#: Buckets up to this size are compared side by side, many in one pass.
SMALL = 48
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles, repeats included, A-Z lower-cased; fewer words than a shingle are one shingle."""
    import xxhash

    word = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not word:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(word)
    end = np.cumsum(np.array([len(w) for w in word]) + 1) - 1
    n = max(1, len(word) - shingle + 1)
    begins = [0, *(end[: n - 1] + 1).tolist()]
    ends = end[min(shingle, len(word)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], seed) for a, b in zip(begins, ends, strict=True)])
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the hashes of all word shingles, as an unsigned number; no words give zero."""
    h = shingle_hashes(text, shingle, seed)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text as a (signed) long."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [fingerprint(t, shingle) for part in slices(texts) for t in part]
            yield pa.array(np.array(found, dtype=np.uint64).view(np.int64))

    return run(whole(text))


def planes(prints: np.ndarray) -> np.ndarray:
    """A row of machine words for each bit: bit j of word w in row k is bit k of fingerprint 64 * w + j.

    ``prints`` has a fingerprint a row, as 64-bit words; one dimension stands for fingerprints of one word."""
    prints = prints.reshape(len(prints), -1)
    n = -(-len(prints) // 64) * 64
    padded = np.zeros((n, prints.shape[1]), dtype="<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


class Near:
    """Saturating carry-save counters of differing bits over lanes of words; asks for ``planes`` until all exceed."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.radius = radius
        self.digits = [np.zeros(shape, dtype=np.uint64) for _ in range((radius + 1).bit_length())]
        self.over = np.zeros(shape, dtype=np.uint64)

    def add(self, differs: np.ndarray) -> None:
        carry = differs
        for k, digit in enumerate(self.digits):
            self.digits[k], carry = digit ^ carry, digit & carry
        self.over |= carry

    def far(self) -> np.ndarray:
        """Lanes whose count exceeds the radius: compare the counters with it, highest digit first."""
        more, equal = self.over.copy(), ~self.over
        for k in range(len(self.digits) - 1, -1, -1):
            if self.radius >> k & 1:
                equal &= self.digits[k]
            else:
                more |= equal & self.digits[k]
                equal &= ~self.digits[k]
        return more


def within(rows: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Words of lanes near each query: planes against all queries at once, given up when every lane is too far."""
    queries = queries.reshape(len(queries), -1)
    near = Near((len(queries), rows.shape[1]), radius)
    for k in range(len(rows)):
        mask = np.where(queries[:, k // 64] >> np.uint64(k % 64) & np.uint64(1), ALL, np.uint64(0))
        near.add(rows[k][None, :] ^ mask[:, None])
        if k % 8 == 7 and k >= radius and (near.far() == ALL).all():
            break
    return ~near.far()


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def forest_of_one(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each of a bucket's fingerprints the index of the first in its component: every one asks once."""
    n, rows = len(prints), planes(prints)
    root = np.full(n, -1, dtype=np.int64)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed], front = seed, np.array([seed])
        while len(front):
            found = np.zeros(n, dtype=bool)
            for k in range(0, len(front), 64):
                near = within(rows, prints[front[k : k + 64]], radius)
                found |= lanes(np.bitwise_or.reduce(near, axis=0), n)
            front = np.flatnonzero(found & (root < 0))
            root[front] = seed
    return root


def shifted(rows: np.ndarray, by: int) -> np.ndarray:
    """Lane i gets lane i + by (by < 64)."""
    ahead = np.zeros_like(rows)
    ahead[:, :-1] = rows[:, 1:]
    return rows >> np.uint64(by) | ahead << np.uint64(64 - by)


def forest_of_many(prints: np.ndarray, bucket: np.ndarray, radius: int, most: int) -> np.ndarray:
    """Roots for rows of many small buckets in order: all lanes are compared with the lane 1, 2, ... further on."""
    rows, n = planes(prints), len(prints)
    left, right = [], []
    for lag in range(1, most):
        beside = bucket[lag:] == bucket[:-lag]
        if not beside.any():
            break
        near = Near((rows.shape[1],), radius)
        differs = rows ^ shifted(rows, lag)
        for k in range(len(rows)):
            near.add(differs[k])
            if k % 16 == 15 and k >= radius and (near.far() == ALL).all():
                break
        beside &= lanes(~near.far(), n)[: n - lag]
        hit = np.flatnonzero(beside)
        left.append(hit)
        right.append(hit + lag)
    root = np.arange(n)
    if not left:
        return root
    a, b = np.concatenate(left), np.concatenate(right)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bucket_links(prints: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers linked by a spanning forest within each bucket; rows come with equal buckets together."""
    edge = np.flatnonzero(np.diff(bucket)) + 1
    begin = np.concatenate(([0], edge))
    size = np.diff(np.concatenate((begin, [len(prints)])))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    low = 2
    while low <= SMALL:
        most = min(2 * low - 1, SMALL)
        rows = np.flatnonzero(np.repeat((size >= low) & (size <= most), size))
        if len(rows):
            root = forest_of_many(prints[rows], bucket[rows], radius, most)
            own = np.flatnonzero(root != np.arange(len(rows)))
            out.append((rows[own], rows[root[own]]))
        low = most + 1
    for k in np.flatnonzero(size > SMALL):
        rows = np.arange(begin[k], begin[k] + size[k])
        root = forest_of_one(prints[rows], radius)
        own = np.flatnonzero(root != np.arange(len(rows)))
        out.append((rows[own], rows[root[own]]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def met(rows: DataFrame, key: str, parts: Column, *columns: str) -> DataFrame:
    """``columns`` of rows dealt in ``parts`` of their key by ``node``, every two of which meet in a ``bucket``."""
    rows = rows.withColumn("g", parts.cast("int")).withColumn("c", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.struct(F.least("c", o).alias("i"), F.greatest("c", o).alias("j")))
    rows = rows.select(*columns, key, F.explode(pairs).alias("q")).select(*columns, F.xxhash64(key, "q.i", "q.j").alias("bucket"))
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def by_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets, from batches in order of ``bucket``."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        b = t.column("bucket").to_numpy()
        end = int(np.flatnonzero(b != b[-1])[-1]) + 1 if len(b) and b[0] != b[-1] else 0  # the last bucket may go on
        if end:
            yield t.slice(0, end)
        held = t.slice(end)
    if held is not None and held.num_rows:
        yield held


def compared(rows: DataFrame, tables: Column, radius: int) -> DataFrame:
    """(u, v) links between ``node`` ids, from rows (node, p) that share one of their bucket keys ``tables``; the
    fingerprint ``p`` is a long, or bytes of several 64-bit words.

    Buckets of one row drop out by a count.  A bucket beyond ``PART`` rows is dealt in parts, and every two parts meet in
    a bucket of their own, so no task gets an unbounded one."""
    keyed = rows.select("node", "p", F.explode(tables).alias("k"))
    sizes = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    keyed = met(keyed.join(sizes, "k"), "k", F.ceil(F.col("n") / PART), "node", "p")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_buckets(batches):
            if t.num_rows > 1:
                node, p, b = t.column("node").to_numpy(), t.column("p"), t.column("bucket").to_numpy()
                prints = p.to_numpy().view(np.uint64) if pa.types.is_int64(p.type) else np.frombuffer(b"".join(p.to_pylist()), dtype="<u8").reshape(t.num_rows, -1)
                u, v = bucket_links(prints, b, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], names=["u", "v"])

    return keyed.mapInArrow(compare, "u long, v long")


def links(prints: DataFrame, radius: int = 2, column: str = "fingerprint") -> DataFrame:
    """(u, v) between distinct fingerprints at ``radius`` or fewer differing bits: enough to connect all that are linked."""
    blocks = radius + 2
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    print_ = F.col(column)
    part = [F.shiftrightunsigned(print_, bounds[k]).bitwiseAND((1 << (bounds[k + 1] - bounds[k])) - 1) for k in range(blocks)]
    tables = [F.struct(F.lit(t).alias("t"), part[i].alias("a"), part[j].alias("b")) for t, (i, j) in enumerate(combinations(range(blocks), 2))]
    return compared(prints.select(print_.alias("node"), print_.alias("p"), column), F.array(*tables), radius)


#: Minima that make a bucket key, and keys: two sets of similarity 0.8 share one of the keys but for 4e-5.
BAND, BANDS = 2, 10
#: Words of the fingerprint of a set of shingles, and the differing bits up to which two sets are candidates.  Sets of
#: similarity 0.8 differ in 38 bits of 256 on average (deviation 6) and so are candidates but for 1e-7; the smallest sets
#: that can be 0.8 alike, of four and five shingles, differ in 48 (deviation 7) and are but for 4e-4.
SET_WORDS, SET_RADIUS = 4, 70
#: Texts, and shingles of texts, in a part of a group of candidates; every two parts are compared.
EXACT_PART, EXACT_SHINGLES = 1024, 2_000_000


def set_fingerprint(h: np.ndarray) -> bytes:
    """Majority bits over distinct shingle hashes, each stretched to ``SET_WORDS`` words; how often a text repeats a
    shingle doesn't count."""
    out = []
    for word in range(SET_WORDS):
        ones = np.zeros(64, dtype=np.int64)
        for k in range(0, len(h), 65536):
            x = h[k : k + 65536] + np.uint64(word + 1) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out.append(np.packbits(2 * ones > len(h), bitorder="little").tobytes())
    return b"".join(out)


def sets(text: Column, shingle: int) -> Column:
    """Of the set of a text's word shingles: a hash, the size, the fingerprint, and ``BANDS`` bucket keys of minima."""
    kind = pa.struct([("node", pa.int64()), ("size", pa.int64()), ("p", pa.binary()), ("keys", pa.list_(pa.int64()))])

    @F.arrow_udf("node long, size long, p binary, keys array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        odd = np.random.default_rng(9).integers(0, 2**63, BAND * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for texts in batches:
            out = []
            for part in slices(texts):
                for t in part:
                    h = np.unique(shingle_hashes(t, shingle))
                    least = np.full(BAND * BANDS, 2**64 - 1, dtype=np.uint64)
                    for k in range(0, len(h), 4096):
                        least = np.minimum(least, (h[k : k + 4096, None] * odd[None, :]).min(axis=0))
                    node = int.from_bytes(xxhash.xxh64_digest(h.tobytes()), "big", signed=True)
                    raw = least.tobytes()
                    keys = [int.from_bytes(xxhash.xxh64_digest(raw[8 * BAND * t : 8 * BAND * (t + 1)], t), "big", signed=True) for t in range(BANDS)]
                    out.append({"node": node, "size": len(h), "p": set_fingerprint(h), "keys": keys})
            yield pa.array(out, kind)

    return run(whole(text))


def forest_of_sets(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each of some sets the index of the first in its component, by links of Jaccard similarity ``least`` or more."""
    n, size = len(sets), np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(ids, np.cumsum(size)[:-1])
    owner = np.repeat(np.arange(n), size)
    inside = np.zeros(len(ids), dtype=bool)
    root = np.full(n, -1, dtype=np.int64)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed], front = seed, [seed]
        while front and len(ids):
            a = front.pop()
            inside[own[a]] = True
            common = np.bincount(owner[inside[ids]], minlength=n)
            inside[own[a]] = False
            found = np.flatnonzero((root < 0) & (common >= least * (size[a] + size - common) - 1e-9))
            root[found] = seed
            front += found.tolist()
            if len(found) or a == seed:
                left = root[owner] < 0
                ids, owner = ids[left], owner[left]
    return root


def exact_links(candidates: DataFrame, shingle: int, least: float) -> DataFrame:
    """(u, v) between nodes of one ``root`` whose sets of shingles are ``least`` alike, enough to connect all such.

    Rows are (root, node, n, shingles, _text), with the number of nodes and shingles of the root."""
    parts = F.greatest(F.ceil(F.col("n") / EXACT_PART), F.ceil(F.col("shingles") / EXACT_SHINGLES), F.lit(1))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_buckets(batches):
            b, node = t.column("bucket").to_numpy(), t.column("node").to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(np.diff(b)) + 1, [len(b)]))
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                rows = i + np.unique(node[i:j], return_index=True)[1]  # a repeated row once
                if len(rows) > 1:
                    texts = t.column("_text")
                    root = forest_of_sets([np.unique(shingle_hashes(texts[k].as_py(), shingle)) for k in rows.tolist()], least)
                    own = np.flatnonzero(root != np.arange(len(rows)))
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array(node[rows[own]]), pa.array(node[rows[root[own]]])], names=["u", "v"])

    return met(candidates, "root", parts, "node", "_text").mapInArrow(compare, "u long, v long")


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, least: float) -> DataFrame:
    """(doc_id, row, keep): rows by id and hash of their text, with the first of their group (nulls come last)."""
    body = docs[f"`{text}`"]
    marked = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), F.xxhash64(whole(body)).alias("row"), sets(body, shingle).alias("s")).select("doc_id", "row", "s.*")
    marked = cut(marked, "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    nodes = cut(marked.groupBy("node").agg(first, F.first("size").alias("size"), F.first("p").alias("p"), F.first("keys").alias("keys")), "distinct-sets", marked.count())
    loose = components(compared(nodes.select("node", "p", "keys"), F.col("keys"), SET_RADIUS))
    loose = cut(nodes.select("node", "size", F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_row")).join(loose, "node"), "candidates")
    sums = loose.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("_of"), whole(body).alias("_text"))
    rows = rows.join(loose, F.col("_of").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_row"))).join(sums, "root")
    roots = components(exact_links(rows, shingle, least))
    labelled = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    labelled = cut(labelled, "labels")
    named = labelled.join(labelled.groupBy("root").agg(F.min("first").alias("keep")), "root").select("node", "keep")
    return marked.select("doc_id", "row", "node").join(named, "node").select("doc_id", "row", "keep")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) by similarity of word shingles, for edits that flip more bits than a small radius holds.

    Candidates share a bucket of minima and are near by bit-sliced comparison of their fingerprints, which are over the
    distinct shingles of a text.  Texts of candidates that hang together are compared exactly: a link is a Jaccard
    similarity of ``least`` or more between their sets of shingles.  A pair of 0.8 is no candidate with 5e-5 (see
    ``BANDS`` and ``SET_RADIUS``, which are for 0.8 and more).  Nulls, repeated rows and empty tables are as in
    ``near_groups``; texts without words are one group; a very long text is hashed in pieces, its shingles at once.
    """
    if least < 0.8:
        raise ValueError("candidates are searched for similarities of 0.8 or more")
    return _grouped(docs, doc_id, text, shingle, least).select("doc_id", F.col("keep.doc_id").alias("component_id"))


def first_of_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of ``near_copies``: that of smallest id; among equal or null ids one by hash."""
    first = _grouped(docs, doc_id, text, shingle, least).select("keep.doc_id", "keep.row").distinct()
    rows = packed(docs, text)
    same = F.col("_in").getField(doc_id).cast("long").eqNullSafe(first["doc_id"]) & (F.xxhash64("_text") == first["row"])
    left = rows.join(first, same, "left_semi").select("_in", F.col("_in").getField(doc_id).alias("_id"), F.xxhash64("_text").alias("_row"))
    return unpacked(left.dropDuplicates(["_id", "_row"]), docs, {})


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint as long, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest id that links reach.  A null, empty or blank text has fingerprint zero and is linked
    like any other; a null id is grouped too and is never the smallest unless all are null; repeated rows share a group;
    an empty table gives an empty one.  A fingerprint that most rows share is one row from the first aggregation on.
    """
    marked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprints(F.col(text), shingle).alias("fingerprint"))
    marked = cut(marked, "fingerprints")
    prints = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints, radius))
    labelled = prints.join(roots, prints["fingerprint"] == roots["node"], "left")
    labelled = cut(labelled.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")), "labels")
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
