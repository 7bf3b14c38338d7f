"""Lexical search: weighted substring scores, BM25, edit distance, layers of fallback, text lines and snippets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.functions.scalar import fuzzy_threshold

#: Characters that a query loses, weights of the text columns.
DROPPED = "\"*():^{}"
COLUMN_WEIGHTS = {"name": 10.0, "qualified_name": 5.0, "signature": 3.0, "summary": 2.0, "file_path": 1.0}
TOKEN = r"[^0-9A-Za-z]+"


def query_terms(text: str) -> list[str]:
    cleaned = [re.sub("[" + re.escape(DROPPED) + "]", "", w) for w in text.lower().split()]
    return [w for w in cleaned if w]


def word_score(text: Column, words: list[str], each: int) -> Column:
    return reduce(lambda a, b: a + b, [F.when(text.contains(w), each).otherwise(0) for w in words], F.lit(0))


def symbol_score(query: str) -> Column:
    """Weighted substring score: the name counts most, then signature, summary and path; every keyword that holds a word
    counts three, the docstring one a word."""
    q, words = query.lower(), query_terms(query)
    name, path = F.lower("name"), F.lower("file_path")
    signature, summary = F.lower("signature"), F.lower("summary")
    out = F.when(name == q, 20).when(name.contains(q), 10).otherwise(0) + F.when(path.contains(q), 4).otherwise(0)
    out = out + word_score(name, words, 5) + word_score(path, words, 1)
    out = out + F.when(signature.contains(q), 8).otherwise(0) + word_score(signature, words, 2)
    out = out + F.when(summary.contains(q), 5).otherwise(0) + word_score(summary, words, 1)
    keywords = F.aggregate(F.transform("keywords", lambda k: word_score(F.lower(k), words, 3)), F.lit(0), lambda a, x: a + x)
    return out + F.coalesce(keywords, F.lit(0)) + word_score(F.lower(F.coalesce("docstring", F.lit(""))), words, 1)


def substring_search(symbols: DataFrame, query: str, k: int) -> DataFrame:
    """Rows with a positive score, best first; ties by path, line and id."""
    scored = symbols.withColumn("score", symbol_score(query)).filter("score > 0")
    return scored.orderBy(F.desc("score"), "file_path", "line", "symbol_id").limit(k)


def bm25(symbols: DataFrame, query: str, k: int, k1: float = 1.2, b: float = 0.75, weights: dict[str, float] = COLUMN_WEIGHTS, prefix: bool = False) -> DataFrame:
    """Best k rows by BM25 over weighted columns, any term matching; ties by path, line and id.

    Term frequencies of the query's terms alone are counted, within the row; only document counts and lengths, one row,
    are aggregated, so nothing is exploded or shuffled by term."""
    terms = query_terms(query)
    tokens = {c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), TOKEN), lambda x: x != "") for c in weights}
    rows = symbols
    for c, t in tokens.items():
        rows = rows.withColumn(f"_t_{c}", t)

    def hits(term: str):
        return (lambda x: x.startswith(term)) if prefix else (lambda x: x == term)

    length = reduce(lambda a, c: a + c, [F.size(f"_t_{c}") * w for c, w in weights.items()])
    rows = rows.withColumn("_len", length)
    for i, t in enumerate(terms):
        tf = [F.size(F.filter(f"_t_{c}", hits(t))) * w for c, w in weights.items()]
        rows = rows.withColumn(f"_tf{i}", reduce(lambda a, c: a + c, tf))
    rows = rows.drop(*[f"_t_{c}" for c in weights])
    stats = rows.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    rows = rows.filter(reduce(lambda a, c: a | c, [F.col(f"_tf{i}") > 0 for i in range(len(terms))])).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.ln(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        tf = F.col(f"_tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    out = rows.withColumn("score", F.round(score, 6)).drop("_n", "_avg", "_len", *[f"_{x}{i}" for x in ("tf", "df") for i in range(len(terms))])
    return out.orderBy(F.desc("score"), "file_path", "line", "symbol_id").limit(k)


def fuzzy_search(symbols: DataFrame, query: str, k: int) -> DataFrame:
    """Names within a few edits of the query; score (t - d + 1) / (t + 1) * 5."""
    q = query.lower()
    t = fuzzy_threshold(F.lit(len(q)))
    near = symbols.withColumn("distance", F.levenshtein(F.lower("name"), F.lit(q))).filter(F.col("distance") <= t)
    scored = near.withColumn("score", F.round((t - F.col("distance") + 1) / (t + 1) * 5, 6))
    return scored.orderBy(F.desc("score"), "file_path", "line", "symbol_id").limit(k)


def layered_search(symbols: DataFrame, query: str, k: int) -> DataFrame:
    """BM25 first, then substring, then fuzzy; a later layer fills what the earlier ones leave of k, before duplicates go.

    So fewer than k rows can come back.  A layer is read only if the ones before leave room, and gives at most k rows, so
    what passes from one to the next is a short list."""
    columns = ["symbol_id", "name", "file_path", "line"]
    found: dict[str, tuple] = {}
    for tier, search in enumerate((bm25, substring_search, fuzzy_search), 1):
        left = k - len(found)
        if left <= 0:
            break
        for place, r in enumerate(search(symbols, query, left).select(*columns).collect(), 1):
            found.setdefault(r["symbol_id"], (*r, tier, place))
    kinds = dict(symbols.dtypes)
    return symbols.sparkSession.createDataFrame(list(found.values()), ", ".join(f"{c} {kinds[c]}" for c in columns) + ", tier int, place int")


def lines(files: DataFrame) -> DataFrame:
    """One row a line, numbered from 1."""
    out = files.select("repo", "path", F.posexplode(F.split("content", "\n", -1)).alias("_i", "line"))
    return out.withColumn("line_no", F.col("_i") + 1).drop("_i")


def first_bytes(text: Column, most: int) -> Column:
    """The whole characters among the first ``most`` bytes; most texts are that many characters or fewer of one byte."""
    few = F.substring(text, 1, most)
    sizes = F.transform(F.split(few, ""), lambda c: F.octet_length(c))
    ends = F.aggregate(sizes, F.struct(F.lit(0).alias("b"), F.lit(0).alias("n")), lambda a, x: F.when(a["b"] + x <= most, F.struct((a["b"] + x).alias("b"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(most + 1).alias("b"), a["n"].alias("n"))), lambda a: a["n"])
    return F.when(F.octet_length(few) <= most, few).otherwise(F.substring(few, F.lit(1), ends))


def text_search(files: DataFrame, query: str, k: int) -> DataFrame:
    """First k lines that hold the query, in path order, trimmed and cut to 200 bytes (a character cut in two goes)."""
    hits = lines(files.filter(F.lower("content").contains(query.lower()))).filter(F.lower("line").contains(query.lower()))
    return hits.orderBy("path", "line_no").limit(k).withColumn("line", first_bytes(F.trim("line"), 200))


def snippets(files: DataFrame, query: str, context: int) -> DataFrame:
    """Windows of ``context`` lines around matches, merged where they touch; the first match line is kept."""
    hits = lines(files.filter(F.lower("content").contains(query.lower()))).withColumn("n", F.max("line_no").over(Window.partitionBy("path")))
    hits = hits.filter(F.lower("line").contains(query.lower()))
    spans = hits.select("path", "line_no", F.greatest(F.lit(1), F.col("line_no") - context).alias("start"), F.least(F.col("n"), F.col("line_no") + context).alias("end"))
    order = Window.partitionBy("path").orderBy("line_no")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.when(ahead.isNull() | (F.col("start") > ahead), 1).otherwise(0)).withColumn("_group", F.sum("_new").over(order))
    return spans.groupBy("path", "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("line_no").alias("match_line"), F.count(F.lit(1)).alias("matches")).drop("_group")
