"""Quality rules under weak supervision: rules vote or abstain, a label model weighs them, its posterior decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.llm import weak_labels
from factline.llm.storage import cut
from factline.llm.text import BLANK, BLANK_CHARS, packed, strip_blank, unpacked, words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages, as whole words.
COMMON = (
    "the of and to in is that it for was on are as with be by this at or an "
    "de la le et les des en un du une que est pour qui par au "
    "el los se del las con su "
    "der die und von zu das ein den mit"
).split()

RULES = ["symbols", "repeats", "lines", "length", "shouting", "common"]


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines", "n_shouted", "n_common"]


def measures(rows: DataFrame) -> DataFrame:
    """Add the counts the rules go by to rows with a ``_text``; all in one pass over it, within the row.

    Repeated three-word windows are found by sorting their hashes with their positions: equal neighbours repeat, and the
    words they cover are the lengths of their union.
    """
    body = F.col("_text")
    out = rows.withColumn("_words", words(body))
    n = F.size("_words")
    at = lambda i: F.get(F.col("_words"), i)
    grams = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("p")),
    )
    out = out.withColumn("_grams", F.sort_array(grams))
    lines = F.filter(F.split(body, "\n", -1), lambda x: strip_blank(x) != "")
    same = lambda x, i: F.coalesce(F.get(F.col("_grams"), i)["h"] == x["h"], F.lit(False))
    again = F.filter(F.col("_grams"), lambda x, i: same(x, i + 1) | same(x, i - 1))
    out = out.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["p"]))).withColumn("_lines", lines)
    gaps = F.transform("_again", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_again"), i + 1) - p, F.lit(3))))
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.translate(body, BLANK_CHARS, "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long"),
            "n_text_lines": F.size("_lines").cast("long"),
            "n_shouted": F.regexp_count(body, F.lit(r"\p{Lu}{2,}")).cast("long"),
            "n_common": F.regexp_count(F.lower(body), F.lit(rf"(?<![^{BLANK}])(?:{'|'.join(COMMON)})(?=[{BLANK}.,;:]|$)")).cast("long"),
        }
    )
    return out.drop("_words", "_grams", "_again", "_lines")


def vote(value: Column, good: float | None, bad: float, low_is_good: bool = True) -> Column:
    if low_is_good:
        out = F.when(value > bad, -1)
        return (out if good is None else out.when(value <= good, 1)).otherwise(0)
    out = F.when(value < bad, -1)
    return (out if good is None else out.when(value >= good, 1)).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, each by a share of the text it judges; short texts give some of them nothing to go by."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    length = F.col("word_chars") / n
    long_enough = F.col("n_words") >= 30
    return {
        "symbols": vote(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), 0.01, 0.06),
        "repeats": F.when(long_enough, vote(F.col("n_repeat_words") / n, 0.10, 0.35)).otherwise(0),
        "lines": F.when(F.col("n_text_lines") >= 4, vote(F.col("n_dup_lines") / F.greatest(F.col("n_text_lines"), F.lit(1)), 0.0, 0.30)).otherwise(0),
        "length": F.when((length < 2) | (length > 14), -1).when((length >= 3) & (length <= 9), 1).otherwise(0),
        "shouting": vote(F.col("n_shouted") / n, 0.05, 0.30),
        "common": F.when(long_enough, vote(F.col("n_common") / n, 0.12, 0.03, low_is_good=False)).otherwise(0),
    }


def verdicts(rows: DataFrame, keep_at: float) -> DataFrame:
    """Packed rows with measures and verdicts; measured once, as votes are counted before they are weighed."""
    rows = cut(measures(rows).withColumns(votes()).drop("_text"), "votes")
    model = weak_labels.fit(weak_labels.pattern_counts(rows, RULES), len(RULES))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = rows.withColumn("p_good", weak_labels.probability(model, RULES))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at))


def judge(docs: DataFrame, text: str = "text", keep_at: float = 0.5, with_text: bool = False) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``p_good`` and ``kept`` added; its text column only ``with_text``.

    A null or empty text has no words and fails the base rules; repeated rows are judged alike; an empty table gives an
    empty one.  Names of added columns are replaced where ``docs`` has them.  No shuffle but the counts of vote patterns,
    at most 3^6 rows a task; the measures are written once, so the text is read once.
    """
    without = () if with_text else (text,)
    rows = verdicts(packed(docs, text, *without), keep_at)
    return unpacked(rows, docs, {c: F.col(c) for c in (*MEASURES, "base_failed", "p_good", "kept")}, *without)


def kept_only(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with just its columns."""
    return unpacked(verdicts(packed(docs, text), 0.5).filter("kept"), docs, {})
