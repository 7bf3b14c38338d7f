"""Queries over facts: scans, filters, lookups, outlines, histograms, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factline import corpus
from factline.catalog import query
from factline.functions.scalar import basename, dirname, extension, matches_glob, stable_id
from factline.operators import relational as rel
from factline.sources import predicates


@query("list_repos", """SELECT repo, count(*)::BIGINT AS n_files, count(DISTINCT language)::BIGINT AS n_languages,
    string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM files GROUP BY repo""", "files")
def list_repos(spark, d):
    f = corpus.files(spark, d).groupBy("repo")
    return f.agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("language").alias("n_languages"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


@query("resolve_repo", "SELECT repo FROM (SELECT DISTINCT 'org/' || repo AS repo FROM files) WHERE repo = 'src7' OR repo LIKE '%/src7' OR repo LIKE '%-src7'", "files")
def resolve_repo(spark, d):
    repos = corpus.files(spark, d).select(F.concat(F.lit("org/"), "repo").alias("repo")).distinct()
    return rel.resolve_suffix(repos, "src7")


@query("scan_files", "SELECT path, language, sha256(content) AS hash, strlen(content)::BIGINT AS size_bytes FROM files WHERE repo = 'src3'", "files")
def scan_files(spark, d):
    f = corpus.files(spark, d).filter("repo = 'src3'")
    return f.select("path", "language", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size_bytes"))


@query("scan_symbols", "SELECT symbol_id, file_path, line FROM symbols WHERE language = 'Brand#7' ORDER BY file_path, line", "symbols")
def scan_symbols(spark, d):
    return corpus.symbols(spark, d).filter("language = 'Brand#7'").select("symbol_id", "file_path", "line").orderBy("file_path", "line")


@query("scan_entities", "SELECT id, kind, name FROM entities WHERE analyzer = 'event' AND kind = 'error'", "entities")
def scan_entities(spark, d):
    return rel.search_entities(corpus.entities(spark, d), analyzer="event", kind="error").select("id", "kind", "name")


@query("scan_edges", "SELECT edge_id, from_id, to_id FROM edges WHERE kind = 'defines'", "edges")
def scan_edges(spark, d):
    return corpus.edges(spark, d).filter("kind = 'defines'").select("edge_id", "from_id", "to_id")


@query("prioritized_files", """SELECT path, rank FROM (SELECT path, CASE WHEN path LIKE 'en/%' THEN 0 WHEN path LIKE 'de/%' THEN 1 WHEN path LIKE 'fr/%' THEN 2 ELSE 5 END AS rank
    FROM files) ORDER BY rank, path LIMIT 100""", "files")
def prioritized_files(spark, d):
    return predicates.prioritize(corpus.files(spark, d), 100, ("en", "de", "fr")).select("path", "rank")


@query("search_entities", """SELECT id, name, file_path, line, n > 50 AS truncated FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY file_path, line, id) AS r
    FROM entities WHERE lower(name) LIKE '%purchase%' AND analyzer = 'event' AND json_extract_string(metadata, '$.k') = '42') WHERE r <= 50""", "entities")
def search_entities(spark, d):
    found = rel.search_entities(corpus.entities(spark, d), text="purchase", analyzer="event", path="$.k", value="42")
    return rel.bounded(found.select("id", "name", "file_path", "line"), 50, "file_path", "line", "id")


@query("search_entities_default", "SELECT id, name FROM entities WHERE analyzer <> 'event' AND lower(name) LIKE '%0000012%'", "entities")
def search_entities_default(spark, d):
    return rel.search_entities(corpus.entities(spark, d), text="0000012", hidden=("event",)).select("id", "name")


@query("exact_operation", "SELECT id, json_extract_string(metadata, '$.k') AS operation FROM entities WHERE json_extract_string(metadata, '$.k') = '7'", "entities")
def exact_operation(spark, d):
    e = corpus.entities(spark, d).withColumn("operation", F.get_json_object("metadata", "$.k"))
    return e.filter("operation = '7'").select("id", "operation")


@query("exact_by_kinds", "SELECT id, kind FROM entities WHERE name = 'click_8' AND kind IN ('click', 'view', 'error')", "entities")
def exact_by_kinds(spark, d):
    return corpus.entities(spark, d).filter((F.col("name") == "click_8") & F.col("kind").isin("click", "view", "error")).select("id", "kind")


@query("exact_symbols", "SELECT symbol_id, line FROM symbols WHERE name = 'red widget' OR qualified_name = 'red widget'", "symbols")
def exact_symbols(spark, d):
    return rel.exact_symbols(corpus.symbols(spark, d), "red widget").select("symbol_id", "line")


@query("symbol_by_id", "SELECT symbol_id, name, kind FROM symbols WHERE line = 17 AND symbol_id LIKE '%#17'", "symbols")
def symbol_by_id(spark, d):
    return corpus.symbols(spark, d).filter((F.col("line") == 17) & F.col("symbol_id").endswith("#17")).select("symbol_id", "name", "kind")


@query("unique_symbols", "SELECT qualified_name, symbol_id FROM (SELECT *, count(*) OVER (PARTITION BY qualified_name) AS n FROM symbols) WHERE n = 1", "symbols")
def unique_symbols(spark, d):
    return rel.unique_by(corpus.symbols(spark, d), "qualified_name").select("qualified_name", "symbol_id")


@query("batch_lookup", "SELECT symbol_id, name FROM symbols WHERE line IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50)", "symbols")
def batch_lookup(spark, d):
    wanted = corpus.table(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("line")).distinct()
    return corpus.symbols(spark, d).join(wanted, "line", "left_semi").select("symbol_id", "name")


@query("existing_paths", "SELECT path FROM files WHERE path IN (SELECT lang || '/src1/doc_' || doc_id || '.txt' FROM documents)", "files")
def existing_paths(spark, d):
    asked = corpus.files(spark, d).select(F.concat("language", F.lit("/src1/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return corpus.files(spark, d).select("path").join(asked, "path", "left_semi")


@query("file_outline", "SELECT file_path, line, end_line, kind, qualified_name FROM symbols WHERE file_path = 'Brand#2/PROMO' ORDER BY line, symbol_id", "symbols")
def file_outline(spark, d):
    return corpus.symbols(spark, d).filter("file_path = 'Brand#2/PROMO'").orderBy("line", "symbol_id").select("file_path", "line", "end_line", "kind", "qualified_name")


@query("glob_files", "SELECT path FROM files WHERE regexp_full_match(path, 'en/[^/]*/doc_[^/]*7\\.txt')", "files")
def glob_files(spark, d):
    return corpus.files(spark, d).filter(matches_glob(F.col("path"), "en/**/doc_*7.txt")).select("path")


@query("ignored_files", """SELECT path FROM files WHERE NOT ((path LIKE 'fr/%' OR regexp_full_match(path, '.*/doc_[^/]*1\\.txt')) AND NOT regexp_full_match(path, '.*/doc_[^/]*01\\.txt'))""", "files")
def ignored_files(spark, d):
    f = corpus.files(spark, d)
    return f.filter(~predicates.ignored(F.col("path"), ["/fr/", "doc_*1.txt", "!doc_*01.txt"])).select("path")


@query("excluded_files", """SELECT path, CASE WHEN path LIKE '%../%' THEN 'traversal' WHEN strlen(content) > 20000 THEN 'too_large'
    WHEN contains(substr(content, 1, 8192), chr(0)) THEN 'binary_content' ELSE 'kept' END AS reason FROM files""", "files")
def excluded_files(spark, d):
    f = corpus.files(spark, d)
    return f.select("path", F.coalesce(predicates.exclusion(F.col("path"), F.col("content"), most=20000), F.lit("kept")).alias("reason"))


#: Names that files of customers get, by key: some of them secret.
NAMES = (".env", "server.PEM", "id_rsa.pub", "my_secret_notes.txt", "main.lua", "token.go", "api.token", "service-account-7.json", "environment.env", ".env.local", "keys.md")
SECRET_SQL = " OR ".join(f"regexp_full_match(name, '{p}')" for p in (
    r".*\.env", r"\.env\..*", r".*\.pem", r".*\.key", r".*\.p12", r".*\.pfx", r".*\.credentials", r".*\.keystore", r".*\.jks", r".*\.token", ".*secret.*", r"id_rsa(\..*)?", r"id_ed25519(\..*)?",
    "id_dsa", "id_ecdsa", r"\.htpasswd", r"\.netrc", r"\.npmrc", r"\.pypirc", r"credentials\.json", r"service-account.*\.json", r".*\.secrets"))


@query("secret_files", f"""SELECT path, {SECRET_SQL} AS secret FROM (SELECT 'conf/' || c_custkey || '/' || [{", ".join(f"'{n}'" for n in NAMES)}][c_custkey % {len(NAMES)} + 1] AS path, lower([{", ".join(f"'{n}'" for n in NAMES)}][c_custkey % {len(NAMES)} + 1]) AS name FROM customer)""")
def secret_files(spark, d):
    """Secret-name patterns on the last part of a path."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("c_custkey") % len(NAMES) + 1).cast("int"))
    c = corpus.table(spark, d, "customer").select(F.concat_ws("/", F.lit("conf"), F.col("c_custkey").cast("string"), name).alias("path"))
    return c.select("path", predicates.secret(F.col("path")).alias("secret"))


@query("metadata_projection", """SELECT id, coalesce(json_extract_string(metadata, '$.operation'), json_extract_string(metadata, '$.k'), '') AS operation FROM entities WHERE analyzer = 'event'""", "entities")
def metadata_projection(spark, d):
    e = corpus.entities(spark, d).filter("analyzer = 'event'")
    return e.select("id", F.coalesce(F.get_json_object("metadata", "$.operation"), F.get_json_object("metadata", "$.k"), F.lit("")).alias("operation"))


@query("current_seeds", "SELECT symbol_id FROM symbols WHERE file_path IN (SELECT file_path FROM symbols WHERE kind = 'promo') AND line IN (SELECT l_partkey FROM lineitem)", "symbols")
def current_seeds(spark, d):
    s = corpus.symbols(spark, d)
    alive = corpus.table(spark, d, "lineitem").select(F.col("l_partkey").alias("line"))
    return s.join(s.filter("kind = 'promo'").select("file_path"), "file_path", "left_semi").join(alive, "line", "left_semi").select("symbol_id")


@query("file_tree", """SELECT node, depth, directory, sum(1)::BIGINT AS n_files, sum(n)::BIGINT AS n_symbols FROM (
    SELECT array_to_string(p[1:i], '/') AS node, i::INT AS depth, i < len(p) AS directory, n FROM (
      SELECT string_split(f.path, '/') AS p, coalesce(s.n, 0) AS n, unnest(generate_series(1, least(len(string_split(f.path, '/')), 2))) AS i
      FROM files f LEFT JOIN (SELECT lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, length(text) % 7 AS n FROM documents WHERE doc_id % 2 = 0) s ON f.path = s.path
      WHERE f.path LIKE 'en/%')) GROUP BY ALL""", "files")
def file_tree(spark, d):
    f = corpus.files(spark, d)
    counts = f.filter("doc_id % 2 = 0").select("path", (F.char_length("content") % 7).alias("n_symbols"))
    return rel.tree(f, counts, prefix="en", depth=2).withColumn("n_symbols", F.col("n_symbols").cast("long"))


@query("language_histogram", "SELECT language, count(*)::BIGINT AS n FROM files WHERE language <> '' GROUP BY language", "files")
def language_histogram(spark, d):
    return corpus.files(spark, d).filter("language <> ''").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("kind_histogram", "SELECT kind, count(*)::BIGINT AS n FROM symbols GROUP BY kind", "symbols")
def kind_histogram(spark, d):
    return corpus.symbols(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("directory_histogram", "SELECT regexp_replace(path, '/[^/]*$', '') AS directory, count(*)::BIGINT AS n_files FROM files GROUP BY 1", "files")
def directory_histogram(spark, d):
    return rel.directories(corpus.files(spark, d))


@query("symbol_counts", "SELECT file_path, count(*)::BIGINT AS n_symbols FROM symbols GROUP BY file_path", "symbols")
def symbol_counts(spark, d):
    return corpus.symbols(spark, d).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_symbols"))


@query("file_count", "SELECT count(*)::BIGINT AS n_files FROM files", "files")
def file_count(spark, d):
    return corpus.files(spark, d).agg(F.count(F.lit(1)).alias("n_files"))


@query("repo_outline", """SELECT r.repo, r.n_files, coalesce(b.n_large, 0)::BIGINT AS n_large FROM (SELECT repo, count(*)::BIGINT AS n_files FROM files GROUP BY repo) r
    LEFT JOIN (SELECT repo, count(*) AS n_large FROM files WHERE length(content) > 5000 GROUP BY repo) b ON r.repo = b.repo""", "files")
def repo_outline(spark, d):
    return corpus.files(spark, d).groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.char_length("content") > 5000).alias("n_large"))


@query("distinct_families", """SELECT l_suppkey AS resource, count(DISTINCT l_partkey)::BIGINT AS n_apis FROM lineitem GROUP BY l_suppkey
    HAVING count(DISTINCT l_partkey) >= 3 AND count(DISTINCT l_shipdate) > 1""")
def distinct_families(spark, d):
    out = corpus.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("resource")).agg(F.count_distinct("l_partkey").alias("n_apis"), F.count_distinct("l_shipdate").alias("_d"))
    return out.filter("n_apis >= 3 AND _d > 1").drop("_d")


@query("provider_fingerprint", """SELECT resource, CASE WHEN a > 0 THEN 'first' WHEN b >= 2 THEN 'second' ELSE '' END AS framework FROM (
    SELECT l_suppkey AS resource, count(*) FILTER (WHERE p_name = 'red widget') AS a, count(DISTINCT p_name) FILTER (WHERE p_name IN ('hot ring', 'old rod', 'blue ring')) AS b
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)""")
def provider_fingerprint(spark, d):
    l, p = corpus.table(spark, d, "lineitem"), corpus.table(spark, d, "part")
    name = F.col("p_name")
    out = l.join(p, l["l_partkey"] == p["p_partkey"]).groupBy(F.col("l_suppkey").alias("resource"))
    out = out.agg(F.count_if(name == "red widget").alias("a"), F.count_distinct(F.when(name.isin("hot ring", "old rod", "blue ring"), name)).alias("b"))
    return out.select("resource", F.when(F.col("a") > 0, "first").when(F.col("b") >= 2, "second").otherwise("").alias("framework"))


@query("duplicate_names", "SELECT name, count(*)::BIGINT AS n FROM resources GROUP BY name HAVING count(*) > 1", "resources")
def duplicate_names(spark, d):
    return corpus.resources(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("workspace_overview", """SELECT name, count(*)::BIGINT AS n, count(*) FILTER (WHERE enabled)::BIGINT AS n_enabled, count(*) FILTER (WHERE NOT enabled)::BIGINT AS n_disabled,
    max(weight) AS top_weight FROM resources GROUP BY name""", "resources")
def workspace_overview(spark, d):
    return corpus.resources(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if("enabled").alias("n_enabled"), F.count_if(~F.col("enabled")).alias("n_disabled"), F.max("weight").alias("top_weight"))


@query("final_states", "SELECT user_id, arg_max(event_type, event_id) AS state, min(event_id) FILTER (WHERE event_type = 'click') AS first_start FROM events GROUP BY user_id")
def final_states(spark, d):
    e = corpus.table(spark, d, "events").groupBy("user_id")
    return e.agg(F.max_by("event_type", "event_id").alias("state"), F.min(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("first_start"))


@query("semantic_coverage", """SELECT count(*)::BIGINT AS n, count(o.c)::BIGINT AS covered, (count(*) - count(o.c))::BIGINT AS uncovered FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS c FROM orders) o ON c_custkey = o.c""")
def semantic_coverage(spark, d):
    c, o = corpus.table(spark, d, "customer"), corpus.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("c")).distinct()
    return c.join(o, "c_custkey", "left").agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("covered"), F.count_if(F.col("c").isNull()).alias("uncovered"))


@query("evidence_labels", "SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'mixed' END AS label FROM lineitem GROUP BY l_orderkey")
def evidence_labels(spark, d):
    g = corpus.table(spark, d, "lineitem").groupBy("l_orderkey")
    return g.agg(F.when(F.count_distinct("l_returnflag") == 1, F.min("l_returnflag")).otherwise("mixed").alias("label"))


@query("merged_sets", "SELECT l_orderkey, string_agg(DISTINCT l_linestatus || l_returnflag, ',' ORDER BY l_linestatus || l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey")
def merged_sets(spark, d):
    g = corpus.table(spark, d, "lineitem").groupBy("l_orderkey")
    return g.agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_linestatus", "l_returnflag"))), ",").alias("flags"))


@query("bounded_outline", """SELECT symbol_id, n > 5 AS group_truncated FROM (SELECT symbol_id, row_number() OVER (PARTITION BY file_path ORDER BY line, symbol_id) AS r, count(*) OVER (PARTITION BY file_path) AS n FROM symbols) WHERE r <= 5""", "symbols")
def bounded_outline(spark, d):
    return rel.per_group(corpus.symbols(spark, d), ["file_path"], 5, "line", "symbol_id").select("symbol_id", "group_truncated")


@query("fair_outline", """SELECT symbol_id, n > cap AS group_truncated FROM (SELECT symbol_id, row_number() OVER (PARTITION BY file_path ORDER BY line, symbol_id) AS r, count(*) OVER (PARTITION BY file_path) AS n,
    (SELECT greatest(1, least(20, 300 // count(DISTINCT file_path))) FROM symbols) AS cap FROM symbols) WHERE r <= cap""", "symbols")
def fair_outline(spark, d):
    return rel.fair_share(corpus.symbols(spark, d), "file_path", 20, 300, "line", "symbol_id").select("symbol_id", "group_truncated")


@query("overload_ordinals", """SELECT line, CASE WHEN count(*) OVER (PARTITION BY qualified_name) > 1 THEN qualified_name || '~' || row_number() OVER (PARTITION BY qualified_name ORDER BY line) ELSE qualified_name END AS unique_id FROM symbols""", "symbols")
def overload_ordinals(spark, d):
    return rel.ordinals(corpus.symbols(spark, d), "qualified_name", "line").select("line", "unique_id")


@query("stable_ids", "SELECT doc_id, 'file/' || substr(sha256(repo || chr(0) || path), 1, 24) AS id FROM files", "files")
def stable_ids(spark, d):
    return corpus.files(spark, d).select("doc_id", stable_id("file", F.col("repo"), F.col("path")).alias("id"))


@query("path_parts", "SELECT doc_id, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS base, '.txt' AS ext FROM files", "files")
def path_parts(spark, d):
    p = F.col("path")
    return corpus.files(spark, d).select("doc_id", dirname(p).alias("dir"), basename(p).alias("base"), extension(p).alias("ext"))


@query("set_added", "SELECT path FROM v2 WHERE path NOT IN (SELECT path FROM v1)", "files snapshots")
def set_added(spark, d):
    a, b = corpus.snapshots(spark, d)
    return b.select("path").exceptAll(a.select("path"))


@query("set_common", "SELECT path FROM v2 INTERSECT SELECT path FROM v1", "files snapshots")
def set_common(spark, d):
    a, b = corpus.snapshots(spark, d)
    return b.select("path").intersect(a.select("path"))


@query("set_union_first", """SELECT name, source FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source) AS r FROM (SELECT DISTINCT name, 1 AS source FROM symbols WHERE kind = 'promo'
    UNION ALL SELECT DISTINCT name, 2 FROM symbols WHERE kind = 'small')) WHERE r = 1""", "symbols")
def set_union_first(spark, d):
    s = corpus.symbols(spark, d)
    both = s.filter("kind = 'promo'").select("name", F.lit(1).alias("source")).distinct().unionByName(s.filter("kind = 'small'").select("name", F.lit(2).alias("source")).distinct())
    return both.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("source"))).filter("r = 1").drop("r")


@query("snapshot_equality", "SELECT count(*) = 0 AS equal FROM ((SELECT * FROM v1 EXCEPT SELECT * FROM v2) UNION ALL (SELECT * FROM v2 EXCEPT SELECT * FROM v1))", "files snapshots")
def snapshot_equality(spark, d):
    a, b = corpus.snapshots(spark, d)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count(F.lit(1)) == 0).alias("equal"))
