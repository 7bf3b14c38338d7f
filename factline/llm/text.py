"""Column expressions for words, lines and row identity, shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but these; the class is the same in Java, RE2 and Python.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: Column | str) -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """Words of a text as an array; one split, then the empty ends are dropped."""
    return F.filter(F.split(text, rf"[{BLANK}]+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def strip_blank(text: Column) -> Column:
    return F.trim(text, F.lit(BLANK_CHARS))


def n_lines(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n")).cast("long") + 1


def packed(docs: DataFrame, text: str, *without: str) -> DataFrame:
    """The columns of ``docs`` in one struct ``_in`` and the whole text as ``_text``, so that no other name can clash."""
    kept = [docs[f"`{c}`"].alias(c) for c in docs.columns if c not in without]
    return docs.select(F.struct(*kept, F.lit(0).alias("_none")).alias("_in"), whole(docs[f"`{text}`"]).alias("_text"))


def unpacked(rows: DataFrame, docs: DataFrame, added: dict[str, Column], *without: str) -> DataFrame:
    """The columns of ``docs`` again, and those added, which replace columns of the same name."""
    lower = {c.lower() for c in added}
    kept = [F.col("_in").getField(c).alias(c) for c in docs.columns if c.lower() not in lower and c not in without]
    return rows.select(*kept, *[v.alias(k) for k, v in added.items()])
