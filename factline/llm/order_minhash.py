"""Document fingerprints by order MinHash (Marcais and others, 2019), in column expressions only.

A text's k-mers are runs of ``K`` words, numbered by occurrence; a text with few blanks, or of fewer than ``K`` words,
has runs of ``K_CHARS`` characters instead, so that an edit changes some of its k-mers and not all.  Their hashes fall in ``BINS`` bins; of each bin the
``TUPLE`` smallest are selected, put back in text order and hashed together.  Two texts agree in a bin if they share its
smallest k-mers in the same order, which moving, inserting or deleting words upsets, as it does the edit distance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.llm.text import whole, words

#: Words of a k-mer, and characters of one in texts with more than ``SPARSE`` characters a word or fewer than K words.
K, K_CHARS, SPARSE = 5, 8, 40
BINS_BITS = 5
BINS = 1 << BINS_BITS
#: A selected k-mer is one long: its bin, 27 bits of its hash, its position (31 bits, which any array's places fit).
PLACE_BITS = 31
LAST_PLACE = (1 << PLACE_BITS) - 1
HASH_BITS = 63 - BINS_BITS - PLACE_BITS
#: Neighbours are looked up within runs of about so many bytes of text.
RUN = 32 << 20


def _packed(h: Column, place: Column) -> Column:
    in_bin = F.shiftleft(h.bitwiseAND(F.lit(BINS - 1)), 63 - BINS_BITS)
    by_hash = F.shiftleft(F.shiftrightunsigned(h, 64 - HASH_BITS), PLACE_BITS)
    return in_bin.bitwiseOR(by_hash).bitwiseOR(place.cast("long"))


def _occurrences() -> Column:
    """Packed k-mers of a text that repeats some: the first keeps its hash, later ones are hashed with their number."""
    s = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    first_at = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["h"] != F.get(s, i - 1)["h"]))

    def numbered(run: Column) -> Column:
        return F.transform(run, lambda x, o: F.when(o == 0, _packed(x["h"], x["p"])).otherwise(_packed(F.xxhash64(x["h"], o), x["p"])))

    # one-element arrays stand for names: the sorted k-mers and the starts of their runs are made once
    def with_sorted(s: Column) -> Column:
        return F.flatten(F.transform(F.array(first_at(s)), lambda starts: with_starts(s, starts)))

    def with_starts(s: Column, starts: Column) -> Column:
        end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(s))
        return F.flatten(F.transform(starts, lambda a, j: numbered(F.slice(s, a + 1, end(j) - a))))

    return F.flatten(F.transform(F.array(s), with_sorted))


def signature(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add ``into``: one "bin:hash" string for every bin with a k-mer, in order of bins; no words give an empty array."""
    out = df.withColumn("_w", words(F.col(text)))
    sparse = (F.size("_w") > 0) & ((F.size("_w") < K) | (F.char_length(text) > SPARSE * F.size("_w")))
    out = out.withColumn("_k", F.when(sparse, F.lit(K_CHARS)).otherwise(F.lit(K))).withColumn("_w", F.when(sparse, F.split(F.col(text), "")).otherwise(F.col("_w")))
    kmers = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - (F.col("_k") - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(F.col("_w"), i, F.col("_k"))))
    out = out.withColumn("_h", F.when(F.size("_w") > 0, kmers).otherwise(F.array().cast("array<bigint>")))
    plain = F.transform("_h", lambda h, i: _packed(h, i))
    out = out.withColumn("_s", F.sort_array(F.when(F.size(F.array_distinct("_h")) == F.size("_h"), plain).otherwise(_occurrences())))
    bin_of = lambda x: F.shiftright(x, 63 - BINS_BITS)
    s = F.col("_s")
    # the two smallest of a bin: the one before the last but one is another bin's
    few = F.filter(s, lambda x, i: F.coalesce(bin_of(F.get(s, i - 2)) != bin_of(x), F.lit(True)))
    out = out.withColumn("_few", few)
    f = F.col("_few")
    place = lambda x: x.bitwiseAND(F.lit(LAST_PLACE))
    kmer = lambda x: F.shiftright(x, PLACE_BITS)

    def slot(x: Column, i: Column) -> Column:
        y = F.get(f, i + 1)
        both = F.when(place(x) <= place(y), F.xxhash64(kmer(x), kmer(y))).otherwise(F.xxhash64(kmer(y), kmer(x)))
        value = F.when(bin_of(y) == bin_of(x), both).otherwise(F.xxhash64(kmer(x)))
        new_bin = F.coalesce(bin_of(F.get(f, i - 1)) != bin_of(x), F.lit(True))
        return F.when(new_bin, F.concat_ws(":", bin_of(x).cast("string"), F.substring(F.lpad(F.hex(value), 16, "0"), 1, 8)))

    out = out.withColumn(into, F.filter(F.transform(f, slot), lambda x: x.isNotNull()))
    return out.drop("_w", "_k", "_h", "_s", "_few")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins that either fills in which both agree; 1 for two texts without words."""
    bins = lambda x: F.transform(x, lambda v: F.substring_index(v, ":", 1))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either.cast("double"))


def _longs(values: list[int]) -> Column:
    """An array literal, handed over as one string that the optimizer folds."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


def _run_of(bounds: list[int], value: Column) -> Column:
    """Index of the last of the ascending bounds that ``value`` reaches: among the heads of slices, then in a slice."""
    step = max(1, math.isqrt(len(bounds)))
    at_most = lambda array: F.size(F.filter(array, lambda b: b <= value))
    head = at_most(_longs(bounds[::step])) - 1
    return head * step + at_most(F.slice(_longs(bounds), head * step + 1, F.lit(step))) - 1


def with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Add ``_a``, the row's signature, and ``_next`` and ``_c``, text and signature of the row with the next id (for the
    last row, the first).

    Rows are dealt to runs between ids that an approximate quantile of the ids picks, as many runs as the bytes of text
    ask for; the row on each bound also goes to the run before it, to close it, so a text is moved once and no run waits
    for another.  Rows that repeat one id stay in one run, as their order by text needs; the run is sorted with spilling.
    """
    rows = docs.withColumn("_doc", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))).withColumn("_text", whole(text))
    count, low, size = rows.agg(F.count(F.lit(1)), F.min("_doc"), F.sum(F.octet_length("_text"))).first()
    runs = max(1, -(-(size or 0) // RUN))
    share = [k / runs for k in range(1, runs)]
    bounds = rows.agg(F.percentile_approx("_doc", share, max(10_000, 4 * runs))).first()[0] if share and count else []
    bounds = sorted({low, *bounds}) if count else [0]
    run = _run_of(bounds, F.col("_doc"))
    # the first row of a run closes the one before; the first of all closes the last
    on_bound = F.get(_longs(bounds), run) == F.col("_doc")
    closes = F.when(on_bound, F.pmod(run - 1, F.lit(len(bounds))))
    places = F.filter(F.array(F.struct(run.alias("run"), F.lit(False).alias("extra")), F.struct(closes.alias("run"), F.lit(True).alias("extra"))), lambda x: x["run"].isNotNull())
    rows = signature(rows, "_text", "_a").withColumn("_place", F.explode(places))
    order = Window.partitionBy("_place.run").orderBy("_place.extra", "_doc", "_text")
    ahead = {"_next": F.lead("_text").over(order), "_c": F.lead("_a").over(order)}
    return rows.withColumns(ahead).filter(~F.col("_place.extra")).drop("_place", "_doc")


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text, and likenesses.

    The edited text ends in the next document's first characters instead of the last quarter of its own.  A null text is
    empty; a null id comes first; rows with equal ids follow each other by text, equal rows in any order; a single row is
    its own next; an empty table gives an empty one.  K-mers of equal hash keep their text order, and a very long text is
    read whole.
    """
    rows = with_next(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    n = F.char_length("_text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), n - cut), F.substring(F.col("_next"), F.lit(1), cut)))
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256))
    rows = signature(rows, "_edited", "_b")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("_a", " ").alias("fingerprint"),
        F.array_join("_b", " ").alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b")).alias("near_edited"),
        likeness(F.col("_a"), F.col("_c")).alias("near_next"),
    )
