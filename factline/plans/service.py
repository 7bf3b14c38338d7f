"""Queries of the service kind: several requests at once, extraction, ingestion."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline import catalog, corpus
from factline.catalog import query

#: Fixed value: operations of one batch.
MOST_OPERATIONS = 10
#: Rows that one operation of a batch returns.
MOST_ROWS = 1000


class Answer(NamedTuple):
    """What one operation gave: rows and whether there are more, or its error."""

    name: str
    rows: list | None
    truncated: bool
    error: Exception | None


def batch(spark, sf_dir: str, names: list[str]) -> list[Answer]:
    """Run up to ten named queries side by side; each gives its rows or its own error."""
    if len(names) > MOST_OPERATIONS:
        raise ValueError(f"at most {MOST_OPERATIONS} operations")

    def one(name: str):
        try:
            rows = catalog.QUERIES[name](spark, sf_dir).limit(MOST_ROWS + 1).collect()
            return Answer(name, rows[:MOST_ROWS], len(rows) > MOST_ROWS, None)
        except Exception as error:  # noqa: BLE001  reported with its operation
            return Answer(name, None, False, error)

    with ThreadPoolExecutor(len(names) or 1) as pool:
        return list(pool.map(one, names))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly, over as many tasks as a shuffle has; no merging of small ones, since bytes don't tell the work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@query("page_links", """SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::INT AS n_links, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages""")
def page_links(spark, d):
    p = corpus.table(spark, d, "pages")
    return p.select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("n_links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(
    "extracted_symbols",
    """WITH p AS (SELECT p_partkey AS k, regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') AS n, ['py', 'ts', 'go'][p_partkey % 3 + 1] AS e FROM part),
    x AS (SELECT * FROM (VALUES ('py', 'class', 'C_', '', 1, 3, ''), ('py', 'method', 'C_', '.run', 2, 3, 'C_'), ('py', 'function', 'f_', '', 5, 6, ''), ('ts', 'class', 'C_', '', 1, 5, ''), ('ts', 'method', 'C_', '.run', 2, 4, 'C_'),
      ('ts', 'function', 'f_', '', 6, 6, ''), ('go', 'type', 'C_', '', 1, 2, ''), ('go', 'method', '', 'run', 3, 3, ''), ('go', 'function', 'f_', '', 5, 5, '')) v(e, kind, before, after, line, end_line, holder)),
    y AS (SELECT *, 'src/p' || k || '.' || e AS path, CASE WHEN before = '' THEN after ELSE before || n || after END AS q FROM p JOIN x USING (e))
    SELECT path, path || '::' || q || '#' || kind AS symbol_id, kind, line, end_line, CASE WHEN holder = '' THEN '' ELSE path || '::' || holder || n || '#class' END AS parent FROM y""",
)
def extracted_symbols(spark, d):
    """Symbols of Python, TypeScript and Go sources made from parts."""
    from factline.sources.python_source import symbols_of

    # few bytes a part but much work: a file of some MB would be one task
    p = corpus.table(spark, d, "part").select("p_partkey", "p_name", "p_size").transform(spread)
    name, size, kind = F.regexp_replace("p_name", "[^A-Za-z0-9]", "_"), F.col("p_size").cast("string"), F.col("p_partkey") % 3
    python = F.concat(F.lit("class C_"), name, F.lit(":\n    def run(self):\n        return "), size, F.lit("\n\ndef f_"), name, F.lit("():\n    pass\n"))
    script = F.concat(F.lit("class C_"), name, F.lit(" {\n  run() {\n    return "), size, F.lit("\n  }\n}\nfunction f_"), name, F.lit("() {}\n"))
    go = F.concat(F.lit("type C_"), name, F.lit(" struct {\n}\nfunc (c *C_"), name, F.lit(") run() {}\n\nfunc f_"), name, F.lit("() {}\n"))
    ending = F.when(kind == 0, ".py").when(kind == 1, ".ts").otherwise(".go")
    files = p.select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), ending).alias("path"), F.when(kind == 0, python).when(kind == 1, script).otherwise(go).alias("content"))
    return symbols_of(files).select("path", "symbol_id", "kind", "line", "end_line", "parent")


@query("session_turns", "SELECT conv_id, count(*)::BIGINT AS turns, count(*) FILTER (WHERE role = 'user')::BIGINT AS asked, max(length(text)) AS longest FROM conversations GROUP BY conv_id")
def session_turns(spark, d):
    g = corpus.table(spark, d, "conversations").groupBy("conv_id")
    return g.agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.max(F.char_length("text")).cast("long").alias("longest"))
