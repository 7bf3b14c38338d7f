"""Search queries over symbols, entities and file text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline import corpus
from factline.catalog import query
from factline.functions.scalar import fuzzy_threshold, savings
from factline.operators import search

SCORE = """(CASE WHEN lower(name) = '{q}' THEN 20 WHEN lower(name) LIKE '%{q}%' THEN 10 ELSE 0 END + CASE WHEN lower(file_path) LIKE '%{q}%' THEN 4 ELSE 0 END
  + CASE WHEN lower(signature) LIKE '%{q}%' THEN 8 ELSE 0 END + CASE WHEN lower(summary) LIKE '%{q}%' THEN 5 ELSE 0 END {words})""".replace("{q}", "cold widget")
SCORE = SCORE.replace("{words}", " ".join(
    f"+ CASE WHEN lower({c}) LIKE '%{w}%' THEN {n} ELSE 0 END" for w in ("cold", "widget") for c, n in (("name", 5), ("file_path", 1), ("signature", 2), ("summary", 1), ("docstring", 1))
) + " + 3 * (len(list_filter(keywords, lambda x: contains(lower(x), 'cold'))) + len(list_filter(keywords, lambda x: contains(lower(x), 'widget'))))")
LENGTH = " + ".join(f"{w} * len(list_filter(string_split_regex(lower({c}), '[^0-9A-Za-z]+'), lambda x: x <> ''))" for c, w in search.COLUMN_WEIGHTS.items())


def bm25_sql(terms: tuple[str, ...], test: str = "x = '{t}'") -> str:
    """A common table expression ``bm``: the rows that hold a term, with their scores."""
    tf = {t: " + ".join(f"{w} * len(list_filter(string_split_regex(lower({c}), '[^0-9A-Za-z]+'), lambda x: {test.format(t=t)}))" for c, w in search.COLUMN_WEIGHTS.items()) for t in terms}
    score = " + ".join(f"ln(1 + (n - df_{t} + 0.5) / (df_{t} + 0.5)) * tf_{t} * 2.2 / (tf_{t} + 1.2 * (0.25 + 0.75 * l / a))" for t in terms)
    return f"""counted AS (SELECT *, {", ".join(f"{tf[t]} AS tf_{t}" for t in terms)}, ({LENGTH})::DOUBLE AS l FROM symbols),
      bm AS (SELECT symbol_id, name, file_path, line, round({score}, 6) AS score FROM counted
      CROSS JOIN (SELECT count(*)::DOUBLE AS n, avg(l) AS a, {", ".join(f"count(*) FILTER (WHERE tf_{t} > 0)::DOUBLE AS df_{t}" for t in terms)} FROM counted) WHERE {" OR ".join(f"tf_{t} > 0" for t in terms)})"""


BM25 = bm25_sql(("cold", "widget"))


@query("weighted_search", f"SELECT symbol_id, score::INT AS score FROM (SELECT *, {SCORE} AS score FROM symbols) WHERE score > 0 ORDER BY score DESC, file_path, line, symbol_id LIMIT 20", "symbols")
def weighted_search(spark, d):
    return search.substring_search(corpus.symbols(spark, d), "cold widget", 20).select("symbol_id", "score")


@query("bm25_search", f"WITH {BM25} SELECT symbol_id, score FROM bm ORDER BY score DESC, file_path, line, symbol_id LIMIT 20", "symbols")
def bm25_search(spark, d):
    return search.bm25(corpus.symbols(spark, d), "cold widget", 20).select("symbol_id", "score")


@query("prefix_search", f"WITH {bm25_sql(('widg',), "starts_with(x, '{t}')")} SELECT symbol_id, score FROM bm ORDER BY score DESC, file_path, line, symbol_id LIMIT 50", "symbols")
def prefix_search(spark, d):
    return search.bm25(corpus.symbols(spark, d), "widg", 50, prefix=True).select("symbol_id", "score")


@query("fuzzy_search", """SELECT symbol_id, levenshtein(lower(name), 'cold widgt')::INT AS distance, round((2 - levenshtein(lower(name), 'cold widgt') + 1) / 3 * 5, 6) AS score
    FROM symbols WHERE levenshtein(lower(name), 'cold widgt') <= 2 ORDER BY score DESC, file_path, line, symbol_id LIMIT 40""", "symbols")
def fuzzy_search(spark, d):
    return search.fuzzy_search(corpus.symbols(spark, d), "cold widgt", 40).select("symbol_id", "distance", "score")


@query("edit_distances", "SELECT DISTINCT p_name, levenshtein(p_name, 'hot gizmo')::INT AS distance, greatest(2, length(p_name) // 4)::INT AS threshold FROM part")
def edit_distances(spark, d):
    p = corpus.table(spark, d, "part")
    return p.select("p_name", F.levenshtein("p_name", F.lit("hot gizmo")).alias("distance"), fuzzy_threshold(F.length("p_name")).cast("int").alias("threshold")).distinct()


@query("layered_search", f"""WITH {BM25}, t1 AS (SELECT symbol_id, 1 AS tier, row_number() OVER (ORDER BY score DESC, file_path, line, symbol_id) AS place FROM bm QUALIFY place <= 500),
    s AS (SELECT symbol_id, row_number() OVER (ORDER BY score DESC, file_path, line, symbol_id) AS place FROM (SELECT *, {SCORE} AS score FROM symbols) WHERE score > 0),
    t2 AS (SELECT symbol_id, 2 AS tier, place FROM s WHERE place <= 500 AND place <= 500 - (SELECT count(*) FROM t1) AND symbol_id NOT IN (SELECT symbol_id FROM t1)),
    f AS (SELECT symbol_id, row_number() OVER (ORDER BY levenshtein(lower(name), 'cold widget'), file_path, line, symbol_id) AS place FROM symbols WHERE levenshtein(lower(name), 'cold widget') <= 2),
    t3 AS (SELECT symbol_id, 3 AS tier, place FROM f WHERE place <= 500 AND place <= 500 - (SELECT count(*) FROM t1) - (SELECT count(*) FROM t2)
      AND symbol_id NOT IN (SELECT symbol_id FROM t1 UNION ALL SELECT symbol_id FROM t2))
    SELECT symbol_id, tier, place::INT AS place FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)""", "symbols")
def layered_search(spark, d):
    return search.layered_search(corpus.symbols(spark, d), "cold widget", 500).select("symbol_id", "tier", "place")


SUBSTRING_COLUMNS = ("name", "qualified_name", "signature", "summary", "docstring", "file_path")


@query("substring_filter", "SELECT symbol_id FROM symbols WHERE " + " OR ".join(f"lower({c}) LIKE '%widget%'" for c in SUBSTRING_COLUMNS) + " ORDER BY file_path, line, symbol_id LIMIT 256", "symbols")
def substring_filter(spark, d):
    """The substring layer's rows before they are scored: the first 256 by place."""
    held = reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains("widget"), F.lit(False)) for c in SUBSTRING_COLUMNS])
    return corpus.symbols(spark, d).filter(held).orderBy("file_path", "line", "symbol_id").limit(256).select("symbol_id")


@query("text_search", r"""SELECT path, line_no::INT AS line_no, left(trim(line), 200) AS line FROM (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files)
    WHERE lower(line) LIKE '%licensed under%' ORDER BY path, line_no LIMIT 100""", "files")
def text_search(spark, d):
    return search.text_search(corpus.files(spark, d), "licensed under", 100).select("path", "line_no", "line")


@query("snippets", """WITH l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no, len(string_split(content, chr(10))) AS n FROM files),
    s AS (SELECT path, line_no, greatest(1, line_no - 2) AS s, least(n, line_no + 2) AS e FROM l WHERE lower(line) LIKE '%licensed%'),
    g AS (SELECT *, CASE WHEN s > max(e) OVER w OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    h AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY line_no) AS grp FROM g)
    SELECT path, min(s)::INT AS "start", max(e)::INT AS "end", min(line_no)::INT AS match_line, count(*)::BIGINT AS matches FROM h GROUP BY path, grp""", "files")
def snippets(spark, d):
    return search.snippets(corpus.files(spark, d), "licensed", 2)


@query("resource_symbols", """SELECT s.symbol_id FROM symbols s JOIN (SELECT DISTINCT file_path FROM symbols WHERE lower(file_path) LIKE '%brand#1%' ORDER BY file_path LIMIT 64) r ON s.file_path = r.file_path""", "symbols")
def resource_symbols(spark, d):
    s = corpus.symbols(spark, d)
    owners = s.select("file_path").filter(F.lower("file_path").contains("brand#1")).distinct().orderBy("file_path").limit(64)
    return s.join(F.broadcast(owners), "file_path").select("symbol_id")


BLOCK = 1000


@query("benchmark_hits", "SELECT item_id, count(*)::BIGINT AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def benchmark_hits(spark, d):
    docs = corpus.table(spark, d, "documents").select("doc_id", "text")
    items = corpus.table(spark, d, "benchmark").select("item_id", F.col("text").alias("wanted"))
    return holding(docs, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) for every document that contains an item's text.

    An item's inner words are whole words of any document that holds it, so a run of three of them, or one where there are
    fewer, finds candidates by equality; containment then decides.  Items without an inner word are asked for directly, in
    blocks of a thousand."""
    n = F.size(F.split("wanted", r"\s+"))
    items = items.withColumn("_kind", F.when(n >= 5, 3).when(n >= 3, 1).otherwise(0))
    sizes = {r["_kind"]: r["count"] for r in items.groupBy("_kind").count().collect()}
    out: DataFrame | None = None
    for length in (3, 1):
        if not sizes.get(length):
            continue
        some = items.filter(F.col("_kind") == length).withColumn("key", F.array_join(F.slice(F.split("wanted", r"\s+"), 2, length), " "))

        def runs_of(w: Column, length: int = length) -> Column:
            last = F.greatest(F.size(w) - (length - 1), F.lit(1))
            return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, length), " "))

        # an array of one array stands for a name: a text is split once, not once a run
        runs = F.array_distinct(F.flatten(F.transform(F.array(F.split("text", r"\s+")), lambda w: runs_of(w))))
        pairs = docs.select("doc_id", F.explode(runs).alias("key")).join(some.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
        hits = docs.join(pairs, "doc_id").join(some.select("item_id", "wanted"), "item_id").filter(F.contains("text", "wanted")).select("doc_id", "item_id")
        out = hits if out is None else out.unionByName(hits)
    blocks = -(-sizes.get(0, 0) // BLOCK)
    for block in range(blocks):
        some = items.filter((F.col("_kind") == 0) & (F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block))
        hits = docs.join(F.broadcast(some), F.contains("text", "wanted")).select("doc_id", "item_id")
        out = hits if out is None else out.unionByName(hits)
    return docs.join(items, F.lit(False)).select("doc_id", "item_id") if out is None else out


def _task_sql() -> str:
    from factline.plans.planning import BROAD, CLASSES, STOPWORDS

    def names(xs):
        return ", ".join(f"'{x}'" for x in xs)

    def rule(k, other, quote):
        shown = (lambda x: f"'{x}'") if quote else str
        return " ".join(f"WHEN regexp_matches(t, '{'|'.join(c[3])}') THEN {shown(c[k])}" for c in CLASSES) + f" ELSE {shown(other)} END"

    word = r"[A-Za-z_][A-Za-z0-9_:./\[\]-]*"
    broad = f"list_has_any(regexp_extract_all(t, '{word}'), [{names(BROAD)}])"
    held = r"""list_transform(regexp_extract_all(text, '"([^"]+)"|''([^'']+)''|`([^`]+)`'), lambda x: x[2:-2])"""
    terms = f"list_distinct(list_concat({held}, list_filter(regexp_extract_all(text, '{word}'), lambda x: length(x) >= 3 AND lower(x) NOT IN ({names(STOPWORDS)}))))"
    return f"""SELECT conv_id, turn, CASE WHEN {broad} THEN 'broad_unknown' {rule(0, "broad_unknown", True)} AS task_class, CASE WHEN {broad} THEN '' {rule(1, "", True)} AS direction,
      CASE WHEN {broad} THEN 1 {rule(2, 1, False)} AS depth, least(32, len({terms}))::INT AS n_terms FROM (SELECT conv_id, turn, text, lower(text) AS t FROM conversations WHERE role = 'user')"""


@query("interpreted_tasks", _task_sql())
def interpreted_tasks(spark, d):
    from factline.plans import planning as p

    c, t = corpus.table(spark, d, "conversations").filter("role = 'user'"), F.col("text")
    return c.select("conv_id", "turn", p.task_class(t).alias("task_class"), p.trace_direction(t).alias("direction"), p.expansion_depth(t).alias("depth"), F.size(p.task_terms(t)).alias("n_terms"))


@query("token_savings", """SELECT repo, sum(greatest(0, (strlen(content) - 800) // 4))::BIGINT AS saved, (sum(greatest(0, (strlen(content) - 800) // 4)) * 25 + 50)::BIGINT // 100 / 10000.0::DOUBLE AS avoided
    FROM files WHERE strlen(content) >= 800 GROUP BY repo""", "files")
def token_savings(spark, d):
    f = corpus.files(spark, d).withColumn("n", F.octet_length("content")).filter("n >= 800").withColumn("s", savings(F.col("n"), F.lit(800)))
    out = f.groupBy("repo").agg(F.sum("s").alias("saved"))
    return out.withColumn("avoided", F.floor((F.col("saved") * 25 + 50) / 100) / F.lit(10_000.0))


@query("lexical_union", """SELECT symbol_id, min(source)::INT AS source FROM (SELECT symbol_id, 1 AS source FROM symbols WHERE name LIKE 'red%' UNION ALL SELECT symbol_id, 2 FROM symbols WHERE file_path LIKE 'Brand#3/%') GROUP BY symbol_id""", "symbols")
def lexical_union(spark, d):
    s = corpus.symbols(spark, d)
    both = s.filter(F.col("name").startswith("red")).select("symbol_id", F.lit(1).alias("source")).unionByName(s.filter(F.col("file_path").startswith("Brand#3/")).select("symbol_id", F.lit(2).alias("source")))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("symbol_id").orderBy("source"))).filter("r = 1").select("symbol_id", "source")
