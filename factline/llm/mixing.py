"""Mixing sources to target weights, by weighted sampling without replacement (Efraimidis and Spirakis).

Every document gets the key -ln(u) / w, with u from a hash of its id and w its quality weight.  A source's words go round
whole as often as its target allows (complete epochs); the rest of the target is met by the documents of smallest keys,
whose sizes are summed in key order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.llm.storage import cut
from factline.llm.text import n_words, whole

#: No source, and so no document, is taken more often.
MOST = 3
#: Rows of a source that are summed in one task.
BUCKET = 4_000
#: So many sources at most are broadcast; their number is counted first, and more are joined by shuffle.
FEW = 50_000


def quality_weight(size: Column, chars: Column) -> Column:
    """Between 0.5 and 1: how near the text's characters a word are to six."""
    off = F.abs(chars.cast("double") / F.greatest(size, F.lit(1)) - 6.0) / 6.0
    return 0.5 + 0.5 / (1.0 + off)


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from a hash of the id; a null id is one value of its own."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, docs) to targets: shares of all words by weight, at most ``MOST`` times a source's size.

    With sources in the order of the share at which they are full, the full ones come first, so a running sum tells who
    is full and what share the others get.  One row a source, so its windows need no partitioning.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = F.lit(MOST) * F.col("source_size")
    order = Window.orderBy(full / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, whole_table = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole_table) - F.coalesce(F.sum(full).over(before), F.lit(0))).cast("double") / F.sum("weight").over(
        order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    out = sizes.withColumn("weight", w).withColumn("_level", level).withColumn("_full", full / F.col("weight") <= F.col("_level"))
    share = F.max(F.when(~F.col("_full"), F.col("_level"))).over(whole_table)
    return out.withColumn("target", F.when(F.col("_full"), full.cast("double")).otherwise(share * F.col("weight"))).drop("_level", "_full", "weight")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: its id, ``size`` (words), ``source_size``, ``target`` of its source, ``taken``.

    A null text has no words and is never needed; a null source is a source of its own, last in order; rows that repeat
    an id tie, and the order among them is by size and hash of the text (``row``); a very long text is one document like
    any other, taken or not as a whole; an empty table gives an empty one.
    ``taken`` is the size times the copies: complete epochs, plus one for those picked.  The document on the edge of a
    target is picked if that brings the sum nearer.

    A source's rows are dealt to buckets of about ``BUCKET`` rows along the key, so a source with most rows is many
    tasks: sums run within a bucket and start from the sum of the buckets before.
    """
    size = n_words(whole(text))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), F.char_length(whole(text)).alias("_chars"), F.xxhash64(whole(text)).alias("row"))
    sized = sized.withColumn("_key", -F.ln(uniform(F.col("doc_id"), seed)) / quality_weight(F.col("size"), F.col("_chars")))
    sized = cut(sized.drop("_chars"), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    targets = cut(source_targets(sizes, weights).withColumn("_source", named).drop("source"), "targets")
    rows = sized.withColumn("_source", named).join(F.broadcast(targets) if targets.count() <= FEW else targets, "_source")
    rows = rows.withColumn("_buckets", F.ceil(F.col("_docs") / BUCKET)).withColumn(
        "_bucket", F.least(F.floor((1 - F.exp(-F.col("_key"))) * F.col("_buckets")), F.col("_buckets") - 1)
    )
    # dealt by source and bucket: what a join by source alone has dealt would leave a hot source in one task
    rows = rows.repartition("_source", "_bucket")
    sums = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_up_to", F.sum("size").over(within)).join(sums, ["_source", "_bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    middle = (F.col("_ahead") + F.col("_up_to")) * 2 - F.col("size")
    copies = epochs + (middle <= 2 * rest).cast("long") * (rest > 0).cast("long")
    return rows.select("doc_id", "source", "row", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; rows that it doesn't take go.

    Nulls and empty tables are as in ``mix``.  Rows equal in id, source and text share what the mix takes of them: each
    goes as often as the others or once more, and together they go as often as taken.
    """
    taken = mix(docs, doc_id, text, source, weights, seed)
    key = ["_k0", "_k1", "_k2", "_row"]

    def keys(i: Column, s: Column, row: Column) -> list[Column]:
        return [F.coalesce(i.cast("string"), F.lit("")).alias("_k0"), F.coalesce(s.cast("string"), F.lit("")).alias("_k1"), F.concat(i.isNull().cast("string"), s.isNull().cast("string")).alias("_k2"), row.alias("_row")]

    copies = taken.select(*keys(F.col("doc_id"), F.col("source"), F.col("row")), "copies").groupBy(*key).agg(F.sum("copies").alias("_sum"), F.count(F.lit(1)).alias("_rows")).filter("_sum > 0")
    columns = [docs[f"`{c}`"].alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("_in"), *keys(docs[f"`{doc_id}`"], docs[f"`{source}`"], F.xxhash64(whole(docs[f"`{text}`"]))))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    both = rows.join(copies, key).withColumn("_times", (F.floor(F.col("_sum") / F.col("_rows")) + (place <= F.col("_sum") % F.col("_rows")).cast("long")).cast("int"))
    return both.filter("_times > 0").select("_in", F.explode(F.sequence(F.lit(1), "_times"))).select("_in.*")
