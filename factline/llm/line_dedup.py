"""Line dedup over all documents: explode normalised lines, hash, count documents a hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.llm.storage import cut
from factline.llm.text import lower_ascii, packed, strip_blank, unpacked

#: At most this many keys are in more than total / HOT documents, which bounds what is broadcast.
HOT = 1000


def line_key(line: Column) -> Column:
    return lower_ascii(strip_blank(line))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines`` and ``n_dropped`` (long) added.

    A line's key (stripped, A-Z lower-cased) of at least ``min_chars`` code points that at least ``min_docs`` documents
    hold loses its lines, but for those in the largest id that holds it.  A null text is one empty line and stays null;
    a null id counts as one document below all others; rows that repeat an id and a text count once and are all treated
    alike; an empty table gives an empty one.  Other columns pass through; ``n_lines`` and ``n_dropped`` are replaced.

    Shuffles: (hash, id, position) rows for the counts, the keys in few documents once more for the join, and each
    text once to meet its dropped positions.  Keys in more than 1/``HOT`` of all (key, document) pairs number fewer than
    ``HOT``; they are broadcast, so that no key can fill a task.
    """
    rows = packed(docs, text)
    rows = rows.withColumn("_doc", F.coalesce(F.col("_in").getField(doc_id).cast("long"), F.lit(-(2**63)))).withColumn("_row", F.xxhash64("_text"))
    lines = rows.select("_doc", "_row", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line")).withColumn("_key", line_key(F.col("_line")))
    lines = lines.filter(F.char_length("_key") >= min_chars)
    lines = cut(lines.select("_doc", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")), "lines")
    key = ["_h1", "_h2"]
    counts = lines.groupBy(*key).agg(F.countDistinct("_doc").alias("_docs"), F.max("_doc").alias("_last"))
    counts = cut(counts.filter(F.col("_docs") >= min_docs), "line-counts")
    total = counts.agg(F.sum("_docs")).first()[0] or 0
    hot = F.col("_docs") * HOT > total
    hot_keys = F.broadcast(counts.filter(hot))
    dropped = lines.join(hot_keys, key).unionByName(lines.join(hot_keys, key, "left_anti").join(counts.filter(~hot), key))
    dropped = dropped.filter(F.col("_doc") < F.col("_last")).groupBy("_doc", "_row").agg(F.collect_set("_pos").alias("_gone"))

    out = rows.join(dropped, ["_doc", "_row"], "left").withColumn("_lines", F.split("_text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.array_join(F.transform(stay, lambda p: F.get(F.col("_lines"), p)), "\n")
    added = {
        text: F.when(F.col("_gone").isNull(), F.col("_in").getField(text)).otherwise(kept),
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
    }
    return unpacked(out, docs, added)
