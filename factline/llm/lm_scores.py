"""Language-model scores with stupid backoff (Brants and others, 2007), relationally.

1. Documents are dealt to blocks of bounded size, and every block explodes to its n-grams: a distinct one is a row, with
   its count in the block.  On their way the rows are arrays, one for each block and range of hashes.
2. The count table is those rows summed by hash; n-grams that occur once in all are left out, as only their own document
   could ask for them.
3. The exploded n-grams are joined to the count table by hash; a row then says how often a block's n-gram occurs in all.
4. The rows of a block meet its documents, a document's own n-grams are taken off, and its words' scores are summed.

The first two orders are counted together and each further one by itself, so that the rows of few orders are on disk at
once.  Every row is an n-gram of one block, so all tables grow with the text; an n-gram in every document is a row a
block, and no task holds more than a block or a range of hashes at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.storage import cut, settings
from factline.llm.text import whole

BACKOFF = 0.4
#: Bytes of text in a block, and text whose n-grams make a range of hashes.
SLICE, RANGE = 12_000_000, 8_000_000
#: A block or a range is a task of its own, up to so many.
SHARE = 20_000
#: Not read any more: a frequent n-gram is one row a block and needs no dealing.  A test sets it.
FREQUENT = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)
GRAMS = "part int, block int, start long, grams array<long>, counts array<int>"
#: Ranges are dealt once for the sums and the join, and what a job has shuffled goes when its table is written.
DEALT_ONCE = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _bytes_of(texts: pa.LargeStringArray) -> list[bytes]:
    """As ``to_pylist`` of them as bytes, in a quarter of its time."""
    _, offsets, raw = texts.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist() if len(texts) else [0]
    joined = raw.to_pybytes() if raw is not None else b""
    return [joined[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Grams:
    """The n-grams of a block's documents by hash.  Words are A-Z lower-cased."""

    def __init__(self, texts: pa.ChunkedArray):
        import xxhash

        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).combine_chunks()))
        found = lists.flatten().dictionary_encode()
        words = _bytes_of(found.dictionary)
        ids = found.indices.to_numpy(zero_copy_only=False)
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        del lists, found
        blank = ids == (words.index(b"") if b"" in words else -1)  # before a first blank and after a last one
        self.sizes = np.diff(edges) - np.diff(np.concatenate(([0], np.cumsum(blank)))[edges])
        self.ids = ids[~blank]
        self.words = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        #: Place of a token in its document, from 1.
        self.place = np.arange(1, len(self.ids) + 1, dtype=np.int32) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes).astype(np.int32)

    def orders(self, last: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """By order from 1: the order, the number that its first n-gram has within the block, and the n-grams that end at
        the tokens with so many before them in their documents; of order 1 those of ``words``."""
        token, gram = self.words[self.ids], None
        for k in range(1, last + 1):
            if k == 1:
                gram = _mixed(token)
                yield 1, 1, _mixed(self.words)
            else:
                gram[1:] = gram[:-1] * MIX  # whatever goes over a document's edge is left out below
                gram += token
                gram += np.uint64(k)
                gram = _mixed(gram)
                yield k, 1 + (k - 1) * (len(token) + 1), gram[self.place >= k]  # ``words`` may hold the blank, too


def explode(first: int, last: int, ranges: int) -> Callable[[pa.Table], pa.Table]:
    """The distinct n-grams of orders ``first`` to ``last`` of a block, ascending in each order, as one row a range of hashes
    with their counts; ``start`` numbers the first one within the block's.  Order 1 brings the number of all words, as 0."""

    def run(table: pa.Table) -> pa.Table:
        block = Grams(table.column("text"))
        by = table.column("block")[0].as_py()
        out: list[pa.RecordBatch] = []
        for k, start, gram in block.orders(last):
            if k < first:
                continue
            if k == 1:
                at = np.argsort(gram)
                found, counts = gram[at], np.bincount(block.ids, minlength=len(gram))[at]  # of the blank none
                out.append(_row_a_range(by, 0, np.zeros(1, dtype=np.uint64), np.array([len(block.ids)]), ranges))
            else:
                found, counts = np.unique(gram, return_counts=True)
            out.append(_row_a_range(by, start, found, counts, ranges))
        return pa.Table.from_batches(out)

    return run


def _row_a_range(block: int, start: int, grams: np.ndarray, counts: np.ndarray, ranges: int) -> pa.RecordBatch:
    part = _range_of(grams, ranges)
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    ends = pa.array(np.append(edges, len(grams)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (grams.view(np.int64), counts.astype(np.int32))]
    columns = [pa.array(part[edges]), pa.array(np.full(len(edges), block, dtype=np.int32)), pa.array(edges + start), *lists]
    return pa.RecordBatch.from_arrays(columns, names=["part", "block", "start", "grams", "counts"])


def _range_of(grams: np.ndarray, ranges: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def _scores(order: int, held_out: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        block = Grams(docs.column("text"))
        slot, total = found.column("slot").to_numpy(), found.column("total").to_numpy()
        everything = total[slot == 0].sum()  # summed, as it may be missing
        everything = np.maximum(everything - block.sizes if held_out else np.full(len(block.sizes), everything), 1.0)
        doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
        context, longest = np.repeat(everything, block.sizes), np.minimum(order, block.place)
        # the longest n-gram seen elsewhere decides; each step back costs a factor
        score = np.repeat(np.log(0.5) - np.log(everything), block.sizes) + (longest - 1) * np.log(BACKOFF)
        for k, start, gram in block.orders(order):
            ends = np.flatnonzero(block.place >= k)
            if k == 1:
                kinds, of = len(gram), np.argsort(np.argsort(gram))[block.ids]
            else:
                kinds, of = np.unique(gram, return_inverse=True)
                kinds = len(kinds)
            del gram
            here = (slot >= start) & (slot < start + kinds)
            times = np.zeros(kinds, dtype=np.int64)
            times[slot[here] - start] = total[here]
            known = times[of] > 0
            ends, of = ends[known], of[known]
            others = times[of]
            if held_out:
                _, pair, own = np.unique(of * len(block.sizes) + doc[ends], return_inverse=True, return_counts=True)
                others = others - own[pair]
            seen = (others > 0) & (context[ends] > 0)
            ends, others = ends[seen], others[seen]
            score[ends] = np.log(others) - np.log(context[ends]) + (longest[ends] - k) * np.log(BACKOFF)
            context = np.zeros(len(score))  # of the next order: the n-gram that ends a word earlier
            context[ends[ends + 1 < len(score)] + 1] = others[ends + 1 < len(score)]
        sums = np.bincount(doc, weights=score, minlength=len(block.sizes))
        mean = [s / n if n else None for s, n in zip(sums.tolist(), block.sizes.tolist(), strict=True)]
        return pa.table({"doc_id": docs.column("doc"), "n_words": pa.array(block.sizes), "log_score": pa.array(mean, pa.float64())})

    return run


def _dealt(rows: DataFrame, by: str, kinds: int) -> DataFrame:
    return rows.repartitionById(kinds, F.col(by)) if kinds <= SHARE else rows.repartition(SHARE, by)


def _totals(rows: DataFrame, first: int, last: int, ranges: int, least: int) -> DataFrame:
    """(block, slot, total): how often the n-grams of the blocks occur in all, if ``least`` times or more."""
    sent = rows.groupBy("block").applyInArrow(explode(first, last, ranges), GRAMS)
    sent = _dealt(sent, "part", ranges)
    grams = sent.select("part", "block", "start", "counts", F.posexplode("grams").alias("at", "gram"))
    grams = grams.select("part", "gram", "block", (F.col("start") + F.col("at")).alias("slot"), F.col("counts")[F.col("at")].alias("n"))
    # conditions that always hold, so that both sides read all columns, hence one shuffle
    counts = grams.filter(F.coalesce(F.col("slot") + F.col("block"), F.lit(0)) >= 0).groupBy("part", "gram").agg(F.sum("n").alias("total"))
    joined = grams.join(counts.filter(F.col("total") >= least).hint("shuffle_hash"), ["part", "gram"]).filter(F.col("total") >= F.col("n"))
    return joined.select("block", "slot", "total")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 2, held_out: bool = True) -> DataFrame:
    """(doc_id, n_words, log_score): the mean log score of a document's words under the n-grams of all documents.

    With ``held_out`` a document's own n-grams don't count for it, so a passage found nowhere else backs off; a word
    found nowhere else counts a half.  A null or empty text has no words and a null score; repeated rows score alike and
    count as separate documents, as do rows with one id and different texts; an empty table gives an empty one.  All
    n-grams count.  A very long text is exploded whole, and rows of one id and text lie in one block, however many.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), whole(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0
    blocks = 1 + size // SLICE
    rows = _dealt(rows.withColumn("block", F.pmod(F.xxhash64("doc", "text"), F.lit(blocks)).cast("int")), "block", blocks)
    found = None
    with settings(docs.sparkSession, DEALT_ONCE):
        for first, last in [(1, min(2, order)), *((k, k) for k in range(3, order + 1))]:
            made = cut(_totals(rows, first, last, 1 + size // RANGE, 2 if held_out else 1), "ngram-totals")
            found = made if found is None else found.unionByName(made)
    return rows.groupBy("block").cogroup(_dealt(found, "block", blocks).groupBy("block")).applyInArrow(_scores(order, held_out), "doc_id long, n_words long, log_score double")
