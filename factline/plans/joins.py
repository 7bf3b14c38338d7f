"""Join queries: containment, ownership, resolution, authority, changes, write-backs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factline import corpus
from factline.catalog import query
from factline.operators import joins


@query("innermost_symbol", """WITH b AS (SELECT doc_id, i::BIGINT AS s, i + 9 AS e, 'ten_' || i AS id FROM (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))), 10)) AS i FROM documents)
    UNION ALL SELECT doc_id, i, i + 3, 'four_' || i FROM (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))), 4)) AS i FROM documents)),
    l AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))), 3)) AS line FROM documents)
    SELECT l.doc_id, l.line::INT AS line, arg_min(b.id, (b.e - b.s, b.s, b.id)) AS id FROM l JOIN b ON l.doc_id = b.doc_id AND l.line BETWEEN b.s AND b.e GROUP BY ALL""")
def innermost_symbol(spark, d):
    docs = corpus.table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"))
    spans = None
    for name, step in (("ten_", 10), ("four_", 4)):
        part = docs.select("doc_id", F.explode(F.sequence(F.lit(1), "n", F.lit(step))).alias("start")).withColumn("end", F.col("start") + step - 1)
        part = part.withColumn("id", F.concat(F.lit(name), F.col("start").cast("string")))
        spans = part if spans is None else spans.unionByName(part)
    points = docs.select("doc_id", F.explode(F.sequence(F.lit(1), "n", F.lit(3))).alias("line"))
    return joins.innermost(points, spans, ["doc_id"], "line", "start", "end", "id", ["line"])


@query("owning_resource", """SELECT path, arg_max(p, length(p)) AS owner FROM files JOIN (SELECT DISTINCT language AS p FROM files UNION SELECT DISTINCT language || '/' || repo FROM files WHERE doc_id % 3 = 0) r
    ON path = p OR starts_with(path, p || '/') GROUP BY path""", "files")
def owning_resource(spark, d):
    f = corpus.files(spark, d)
    owners = f.select(F.col("language").alias("owner")).distinct().unionByName(f.filter("doc_id % 3 = 0").select(F.concat_ws("/", "language", "repo").alias("owner")).distinct())
    return joins.longest_prefix(f.select("path"), owners.withColumn("label", F.col("owner")), "path", "owner", "label").select("path", "owner")


@query("unique_match", """SELECT l_orderkey, l_linenumber, CASE WHEN c.n = 1 THEN c.one END AS target, coalesce(c.n, 0)::BIGINT AS candidates FROM (SELECT l_orderkey, l_linenumber, p_name || '@' || l_suppkey % 5 AS k FROM lineitem JOIN part ON l_partkey = p_partkey) s
    LEFT JOIN (SELECT p_name || '@' || p_size % 50 AS k, count(*) AS n, min(p_partkey) AS one FROM part GROUP BY 1) c ON s.k = c.k""")
def unique_match(spark, d):
    l, p = corpus.table(spark, d, "lineitem"), corpus.table(spark, d, "part")
    sites = l.join(p, l["l_partkey"] == p["p_partkey"]).select("l_orderkey", "l_linenumber", F.concat("p_name", F.lit("@"), (F.col("l_suppkey") % 5).cast("string")).alias("key"))
    targets = p.select(F.concat("p_name", F.lit("@"), (F.col("p_size") % 50).cast("string")).alias("key"), F.col("p_partkey").alias("target"))
    return joins.only_match(sites, targets, ["key"], "l_orderkey", "target").select("l_orderkey", "l_linenumber", "target", "candidates")


@query("ambiguous_resources", "SELECT r.resource_path, CASE WHEN count(*) OVER (PARTITION BY name) = 1 THEN name END AS resolved FROM resources r", "resources")
def ambiguous_resources(spark, d):
    r = corpus.resources(spark, d)
    return r.select("resource_path", F.when(F.count(F.lit(1)).over(Window.partitionBy("name")) == 1, F.col("name")).alias("resolved"))


@query("module_resolution", """SELECT page_id, m.path FROM (SELECT page_id, unnest([u, u || '/index', u || '/1']) AS c FROM (SELECT page_id, regexp_replace(split_part(url, '://', 2), '[?#].*$', '') AS u FROM pages)) x
    JOIN (SELECT DISTINCT regexp_replace(split_part(url, '://', 2), '[?#].*$', '') AS path FROM pages) m ON x.c = m.path""")
def module_resolution(spark, d):
    u = corpus.table(spark, d, "pages").select("page_id", F.regexp_replace(F.split("url", "://")[1], r"[?#].*$", "").alias("u"))
    tries = u.select("page_id", F.explode(F.array(F.col("u"), F.concat("u", F.lit("/index")), F.concat("u", F.lit("/1")))).alias("path"))
    return tries.join(u.select(F.col("u").alias("path")).distinct(), "path").select("page_id", "path")


@query("package_resolution", """SELECT a.doc_id, count(*)::BIGINT AS n FROM files a JOIN files b ON a.language = b.language AND a.repo = b.repo AND a.doc_id <> b.doc_id GROUP BY a.doc_id""", "files")
def package_resolution(spark, d):
    """Files of the same directory: counted by directory, so no pair is made."""
    f = corpus.files(spark, d)
    counts = f.groupBy("language", "repo").agg((F.count(F.lit(1)) - 1).alias("n"))
    return f.select("doc_id", "language", "repo").join(counts, ["language", "repo"]).filter("n > 0").select("doc_id", "n")


@query("export_resolution", """SELECT event_id, CASE WHEN n = 1 THEN one END AS target FROM (SELECT event_id, 'k' || json_extract_string(props, '$.k') || '_' || user_id AS k FROM events) e
    LEFT JOIN (SELECT 'k' || json_extract_string(props, '$.k') || '_' || (user_id + 1) AS k, count(*) AS n, min(event_id) AS one FROM events GROUP BY 1) x ON e.k = x.k""")
def export_resolution(spark, d):
    e = corpus.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    name = lambda u: F.concat(F.lit("k"), "k", F.lit("_"), u.cast("string"))
    sites = e.select("event_id", name(F.col("user_id")).alias("key"))
    return joins.only_match(sites, e.select(name(F.col("user_id") + 1).alias("key"), F.col("event_id").alias("target")), ["key"], "event_id", "target").select("event_id", "target")


SIDE = "CASE WHEN l_returnflag = 'A' THEN 'client' WHEN l_returnflag = 'R' THEN 'server' WHEN l_linestatus = 'O' THEN 'shared' ELSE 'unknown' END"


@query("event_flows", f"""WITH t AS (SELECT l_partkey, {SIDE} AS side, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), h AS (SELECT l_partkey, {SIDE} AS side, count(*) AS n FROM lineitem WHERE l_linenumber = 2 GROUP BY ALL)
    SELECT t.l_partkey, t.side AS from_side, h.side AS to_side, (t.n * h.n)::BIGINT AS n_edges FROM t JOIN h ON t.l_partkey = h.l_partkey
    WHERE (t.side = 'client' AND h.side IN ('client', 'shared')) OR (t.side = 'server' AND h.side IN ('server', 'shared')) OR (t.side = 'shared' AND h.side = 'shared')""")
def event_flows(spark, d):
    l = corpus.table(spark, d, "lineitem").withColumn("side", _side())
    of = lambda n, name: l.filter(F.col("l_linenumber") == n).groupBy("l_partkey", F.col("side").alias(name)).agg(F.count(F.lit(1)).alias(f"n_{name}"))
    pairs = of(1, "from_side").join(of(2, "to_side"), "l_partkey").filter(joins.sides_fit(F.col("from_side"), F.col("to_side")))
    return pairs.select("l_partkey", "from_side", "to_side", (F.col("n_from_side") * F.col("n_to_side")).alias("n_edges"))


def _side():
    return F.when(F.col("l_returnflag") == "A", "client").when(F.col("l_returnflag") == "R", "server").when(F.col("l_linestatus") == "O", "shared").otherwise("unknown")


@query("side_matrix", """SELECT c.s AS caller, p.s AS provider, (c.s = 'client' AND p.s IN ('client', 'shared')) OR (c.s = 'server' AND p.s IN ('server', 'shared')) OR (c.s = 'shared' AND p.s = 'shared') AS fits
    FROM (SELECT unnest(['client', 'server', 'shared', 'unknown']) AS s) c, (SELECT unnest(['client', 'server', 'shared', 'unknown']) AS s) p""")
def side_matrix(spark, d):
    sides = F.array(*map(F.lit, ("client", "server", "shared", "unknown")))
    both = spark.range(1).select(F.explode(sides).alias("caller")).select("caller", F.explode(sides).alias("provider"))
    return both.withColumn("fits", joins.sides_fit(F.col("caller"), F.col("provider")))


@query("local_and_callback_sides", """SELECT c.s AS expected, p.s AS actual, CASE WHEN c.s = 'unknown' OR p.s = 'unknown' THEN c.s = p.s ELSE c.s = p.s OR c.s = 'shared' OR p.s = 'shared' END AS local,
    (c.s = 'client' AND p.s IN ('server', 'shared')) OR (c.s = 'server' AND p.s IN ('client', 'shared')) AS callback
    FROM (SELECT unnest(['client', 'server', 'shared', 'unknown']) AS s) c, (SELECT unnest(['client', 'server', 'shared', 'unknown']) AS s) p""")
def local_and_callback_sides(spark, d):
    sides = F.array(*map(F.lit, ("client", "server", "shared", "unknown")))
    both = spark.range(1).select(F.explode(sides).alias("expected")).select("expected", F.explode(sides).alias("actual"))
    e, a = F.col("expected"), F.col("actual")
    return both.withColumn("local", joins.sides_local(e, a)).withColumn("callback", joins.sides_callback(e, a))


@query("provider_authority", f"""WITH calls AS (SELECT l_orderkey, l_linenumber, n_name AS target, {SIDE} AS side FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    reg AS (SELECT n_name AS target, count(*) AS registered FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0 GROUP BY 1),
    prov AS (SELECT n_name AS target, CASE WHEN s_suppkey % 2 = 0 THEN 'server' ELSE 'shared' END AS pside, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0 GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(registered, 0) > 1 THEN 'local_ambiguous' WHEN registered = 1 THEN CASE WHEN fitting = 1 THEN 'local_verified' WHEN fitting > 1 THEN 'local_ambiguous' ELSE 'local_api_missing' END ELSE 'external_unverified' END AS status
    FROM calls LEFT JOIN reg USING (target) LEFT JOIN (SELECT target, s.side, sum(n) AS fitting FROM prov JOIN (SELECT unnest(['client', 'server', 'shared']) AS side) s
      ON (s.side = 'client' AND pside = 'shared') OR (s.side = 'server' AND pside IN ('server', 'shared')) OR (s.side = 'shared' AND pside = 'shared') GROUP BY ALL) f ON calls.target = f.target AND calls.side = f.side""")
def provider_authority(spark, d):
    t = lambda n: corpus.table(spark, d, n)
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("target"))
    calls = t("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "target", _side().alias("side"))
    known = s.filter("s_suppkey % 4 <> 0").withColumn("pside", F.when(F.col("s_suppkey") % 2 == 0, "server").otherwise("shared"))
    registered = known.groupBy("target").agg(F.count(F.lit(1)).alias("registered"))
    offered = known.withColumn("side", F.explode(F.array(*map(F.lit, ("client", "server", "shared"))))).filter(joins.sides_fit(F.col("side"), F.col("pside")))
    fitting = offered.groupBy("target", "side").agg(F.count(F.lit(1)).alias("fitting"))
    out = calls.join(registered, "target", "left").join(fitting, ["target", "side"], "left")
    status = joins.authority(F.coalesce("registered", F.lit(0)), F.coalesce("fitting", F.lit(0)), F.lit(True))
    return out.select("l_orderkey", "l_linenumber", status.alias("status"))


@query("factory_calls", """SELECT a.event_id, CASE WHEN count(b.event_id) = 1 THEN min(b.event_id) END AS factory FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'signup' AND b.ts <= a.ts
    WHERE a.event_type = 'click' GROUP BY a.event_id""")
def factory_calls(spark, d):
    e = corpus.table(spark, d, "events")
    later = e.filter("event_type = 'click'").select("user_id", "ts", "event_id")
    earlier = e.filter("event_type = 'signup'").select("user_id", "ts", F.lpad(F.col("event_id").cast("string"), 20, "0").alias("factory"))
    out = joins.only_earlier(later, earlier, ["user_id"], "ts", "event_id", "factory")
    return out.select(F.col("event_id").cast("long").alias("event_id"), F.col("factory").cast("long").alias("factory"))


@query("change_detection", """SELECT path, status FROM (SELECT coalesce(v1.path, v2.path) AS path, CASE WHEN v1.path IS NULL THEN 'added' WHEN v2.path IS NULL THEN 'deleted' WHEN v1.hash <> v2.hash THEN 'changed' END AS status
    FROM v1 FULL JOIN v2 ON v1.path = v2.path) WHERE status IS NOT NULL""", "files snapshots")
def change_detection(spark, d):
    return joins.changes(*corpus.snapshots(spark, d))


@query("upsert_files", """SELECT path, hash FROM v2 UNION ALL SELECT path, hash FROM v1 WHERE path NOT IN (SELECT path FROM v2)""", "files snapshots")
def upsert_files(spark, d):
    from factline.sinks.tables import upserted

    a, b = corpus.snapshots(spark, d)
    return upserted(a, b, ["path"])


@query("delete_prefix", "SELECT path FROM files WHERE NOT (path = 'en/src1' OR starts_with(path, 'en/src1/'))", "files")
def delete_prefix(spark, d):
    from factline.sinks.tables import without_prefix

    return without_prefix(corpus.files(spark, d).select("path"), "en/src1")


@query("orphans", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphans(spark, d):
    alive = corpus.table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return corpus.table(spark, d, "orders").join(alive, "o_custkey", "left_anti").select("o_orderkey")
