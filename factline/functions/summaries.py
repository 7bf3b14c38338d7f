"""One-line summaries of symbols: first sentence of the docstring, else the signature, else kind and name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_comment(text: Column) -> Column:
    """A comment without its markers, line by line."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*(///?|#+|--+|/\*+|\*+(?!/))\s?", ""), r"\*/\s*$", "")))
    return F.trim(F.array_join(lines, "\n"), F.lit(" \n"))


def cut_bytes(text: Column, most: int, mark: str = "") -> Column:
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), 1, most).cast("string")), "�+$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut, F.lit(mark)))


def summary(docstring: Column, signature: Column, kind: Column, name: Column) -> Column:
    first = F.trim(F.regexp_extract(F.regexp_replace(docstring, r"\s+", " "), r"^\s*(.*?[.!?])(?:\s|$)", 1))
    sentence = F.when(first != "", first).otherwise(F.trim(F.split(docstring, "\n")[0]))
    return F.coalesce(F.nullif(cut_bytes(sentence, 120), F.lit("")), F.nullif(cut_bytes(signature, 80, "..."), F.lit("")), F.concat_ws(" ", kind, name))
