"""Hand-made cases: ambiguity, absence, ties, bounds."""

import pytest
from pyspark.sql import functions as F

from factline import corpus
from factline.functions import scalar, summaries
from factline.operators import evaluation, graph, joins, packing, ranking, relational, resolve, search
from factline.sinks import tables
from factline.sources import predicates


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("*.py", "a/b/x.py", True), ("src/*.py", "src/a/x.py", False), ("src/**/*.py", "src/x.py", True), ("src/**/*.py", "src/a/b/x.py", True), ("**/t_?.go", "t_1.go", True), ("a/{b,c}/*.ts", "a/c/z.ts", True), ("[ab].c", "b.c", True), ("[!ab].c", "b.c", False), ("a.b", "aXb", False)],
)
def test_globs(spark, pattern, path, hit):
    assert one(spark, scalar.matches_glob(F.lit(path), pattern)) is hit


def test_ignore_rules_last_match_wins(spark):
    rules = ["*.log", "build/", "/top.txt", "!keep.log"]
    df = spark.createDataFrame([(p,) for p in ("x.log", "a/x.log", "a/keep.log", "build/x.c", "a/build/x.c", "top.txt", "a/top.txt")], "path string")
    kept = values(df.filter(~predicates.ignored(F.col("path"), rules)), "path")
    assert kept == [("a/keep.log",), ("a/top.txt",)]


def test_exclusion_gives_the_first_reason(spark):
    df = spark.createDataFrame([("../x.py", "a"), ("a/.env", "a"), ("a.png", "a"), ("a.py", "a\0"), ("a.py", "aaaa"), ("b.py", "a")], "path string, content string")
    got = [r[0] for r in df.select(predicates.exclusion(F.col("path"), F.col("content"), most=3)).collect()]
    assert got == ["traversal", "secret", "binary_extension", "binary_content", "too_large", None]


def test_stable_id(spark):
    import hashlib

    want = "p/" + hashlib.sha256(b"a\0b").hexdigest()[:24]
    assert one(spark, scalar.stable_id("p", F.lit("a"), F.lit("b"))) == want


def test_sides_and_languages(spark):
    assert one(spark, scalar.side(F.lit(" Client "))) == "client" and one(spark, scalar.side(F.lit("moon"))) == "unknown"
    assert one(spark, scalar.language(F.lit("a/b.TSX"))) == "tsx" and one(spark, scalar.language(F.lit("a/b.txt"))) == ""


def test_innermost_prefers_the_smallest_then_the_first(spark):
    spans = spark.createDataFrame([("f", 1, 200, "class"), ("f", 5, 9, "method"), ("f", 5, 9, "other"), ("g", 1, 9, "g")], "file string, start int, end int, id string")
    points = spark.createDataFrame([("f", 6), ("f", 150), ("f", 300)], "file string, line int")
    assert values(joins.innermost(points, spans, ["file"], "line", "start", "end", "id", ["line"]), "line", "id") == [(6, "method"), (150, "class")]


def test_longest_prefix_stops_at_slashes(spark):
    owners = spark.createDataFrame([("r", "R"), ("r/sub", "S")], "p string, name string")
    paths = spark.createDataFrame([("r/sub/x",), ("r/y",), ("rx/y",)], "path string")
    assert values(joins.longest_prefix(paths, owners, "path", "p", "name"), "path", "name") == [("r/sub/x", "S"), ("r/y", "R")]


def test_only_one_match_resolves(spark):
    sites = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "site int, key string")
    targets = spark.createDataFrame([("a", "A"), ("b", "B1"), ("b", "B2")], "key string, target string")
    assert values(joins.only_match(sites, targets, ["key"], "site", "target").na.fill("-"), "site", "target", "candidates") == [(1, "A", 1), (2, "-", 2), (3, "-", 0)]


def test_changes(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    b = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    assert values(joins.changes(a, b), "path", "status") == [("b", "changed"), ("c", "deleted"), ("d", "added")]


def test_backward_match_needs_a_single_earlier_row(spark):
    later = spark.createDataFrame([("k", 5, "x"), ("k", 9, "y"), ("m", 1, "z")], "k string, t int, row string")
    earlier = spark.createDataFrame([("k", 4, "f1"), ("k", 8, "f2"), ("m", 2, "g")], "k string, t int, item string")
    got = values(joins.only_earlier(later, earlier, ["k"], "t", "row", "item").na.fill("-"), "row", "item", "earlier")
    assert got == [("x", "f1", 1), ("y", "-", 2), ("z", "-", 0)]


@pytest.mark.parametrize(("registered", "fitting", "registry", "status"), [(2, 1, True, "local_ambiguous"), (1, 1, True, "local_verified"), (1, 2, True, "local_ambiguous"), (1, 0, True, "local_api_missing"), (0, 5, True, "external_unverified"), (0, 1, False, "local_verified"), (0, 0, False, "external_unverified")])
def test_authority(spark, registered, fitting, registry, status):
    assert one(spark, joins.authority(F.lit(registered), F.lit(fitting), F.lit(registry))) == status


def edge_table(spark, pairs):
    return spark.createDataFrame([(f"{k}:{a}:{b}", a, b, k, False, 1.0) for a, b, k in pairs], "edge_id string, from_id string, to_id string, kind string, dynamic boolean, confidence double")


def at(e):
    return lambda ids, direction: e


def test_cycles_end(spark):
    e = edge_table(spark, [("a", "b", "calls"), ("b", "a", "calls")])
    assert values(graph.walk(at(e), ["a"], 3), "edge_id", "depth", "truncated") == [("calls:a:b", 1, False), ("calls:b:a", 2, False)]


def test_a_call_outranks_references_within_the_bound(spark):
    e = edge_table(spark, [("a", f"r{i}", "references") for i in range(9)] + [("a", "z", "calls"), ("z", "y", "calls")])
    got = graph.walk(at(e), ["a"], 2, k=2, by_rank=True)
    assert values(got, "edge_id", "truncated")[0] == ("calls:a:z", True) and got.count() == 2
    assert values(graph.walk(at(e), ["a"], 1, k=2), "edge_id") == [("calls:a:z",), ("references:a:r0",)]


def test_a_walk_both_ways_meets_an_edge_from_either_end(spark):
    e = edge_table(spark, [("a", "b", "calls"), ("c", "a", "calls")])
    assert values(graph.walk(at(e), ["a"], 2, "both"), "edge_id", "depth") == [("calls:a:b", 1), ("calls:a:b", 2), ("calls:c:a", 1), ("calls:c:a", 2)]
    assert graph.walk(at(e), ["nowhere"], 2).count() == 0


def test_seeds_share_the_budget(spark):
    e = edge_table(spark, [(f"s{i}", f"t{i}-{j}", "calls") for i in range(4) for j in range(120)])
    got = graph.expanded(at(e), [f"s{i}" for i in range(4)], 2, "outgoing").groupBy("seed").count()
    assert values(got, "seed", "count") == [(0, 100), (1, 100), (2, 56)]


def test_endpoints_must_exist(spark):
    found = corpus.edges_at(spark, "/root/testdata/sf0.001")(["o5"], "both")
    assert found.count() > 1 and found.filter("from_id = 'o5' or to_id = 'o5'").count() == found.count()


def test_fuzzy_thresholds(spark):
    assert [one(spark, scalar.fuzzy_threshold(F.lit(n))) for n in (4, 8, 12)] == [2, 2, 3]


def symbol_rows(spark, names):
    return spark.createDataFrame([(f"s{i}", "f", n, n, "function", "py", i, i, n, "", [n, "lid"], None) for i, n in enumerate(names)], "symbol_id string, file_path string, name string, qualified_name string, kind string, language string, line int, end_line int, signature string, summary string, keywords array<string>, docstring string")


def test_keywords_and_docstrings_count(spark):
    s = symbol_rows(spark, ["x"]).withColumn("docstring", F.lit("A lid."))
    assert values(search.substring_search(s, "lid", 5), "score") == [(4,)]


def test_lines_are_cut_by_bytes(spark):
    assert one(spark, search.first_bytes(F.lit("é" * 150), 200)) == "é" * 100
    assert one(spark, search.first_bytes(F.lit("a" + "é" * 150), 200)) == "a" + "é" * 99
    assert one(spark, search.first_bytes(F.lit("b" * 300), 200)) == "b" * 200


def test_items_of_any_length_are_found(spark):
    from factline.plans.search import holding

    docs = spark.createDataFrame([(1, "one two three four fivefold six"), (2, "none of it"), (3, None)], "doc_id long, text string")
    items = ["two three four five", "three four", "fold", "one two three four fivefold", "o three f", "seven eight", "two  three four"]
    got = holding(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumnRenamed("text", "wanted"))
    assert values(got, "item_id", "doc_id") == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1)]


def test_larger_k_keeps_the_smaller(spark):
    s = symbol_rows(spark, ["open file", "open", "close file", "opening", "opem", "file open"] * 3)
    small = [r["symbol_id"] for r in search.bm25(s, "open", 3).collect()]
    assert [r["symbol_id"] for r in search.bm25(s, "open", 6).collect()][:3] == small


def test_layers_fill_what_is_left(spark):
    s = symbol_rows(spark, ["open", "reopen it", "opem"])
    assert values(search.layered_search(s, "open", 5), "tier", "symbol_id") == [(1, "s0"), (2, "s1"), (3, "s2")]


def test_snippets_merge(spark):
    text = "\n".join("hit" if n in (3, 5, 20) else "-" for n in range(1, 31))
    f = spark.createDataFrame([("r", "p", text)], "repo string, path string, content string")
    assert values(search.snippets(f, "hit", 2), "start", "end", "match_line") == [(1, 7, 3), (18, 22, 20)]


def test_query_terms():
    assert search.query_terms('Foo:"bar"* (baz)^ {} ') == ["foobar", "baz"]


EVIDENCE = "candidate string, evidence_id string, reason string, authority string, distance int, dynamic boolean"


def test_discounts_of_evidence(spark):
    rows = [("c", "e1", "exact_symbol_match", "", 0, False), ("c", "e2", "direct_callee", "", 1, False), ("c", "e3", "direct_callee", "", 1, False)]
    e = ranking.scored_evidence(spark.createDataFrame(rows, EVIDENCE))
    assert values(e, "evidence_id", "value") == [("e1", 5500), ("e2", 3180), ("e3", 3180)]
    # parts of the second in fifths, of the third in fiftieths, and 300 + 63 for corroboration
    assert values(ranking.candidate_scores(e), "score", "n_evidence") == [(5500 + (540 + 140 - 44) + (54 + 14 - 4) + 363, 3)]


def test_scores_of_verified_evidence(spark):
    rows = [("c", "e1", "exact_symbol_match", "verified", 0, False), ("c", "e2", "direct_callee", "verified", 1, False)]
    e = ranking.scored_evidence(spark.createDataFrame(rows, EVIDENCE), "localized_change")
    assert values(ranking.candidate_scores(e), "score") == [(7054,)]
    facts = spark.createDataFrame([("c", False, "f", ["r"], ["t"])], "candidate string, has_symbol boolean, file string, resources array<string>, targets array<string>")
    assert values(ranking.candidate_scores(e, facts, "f", "t"), "score") == [(7054 + 280 + 180 - 260,)]


def test_the_direction_of_a_trace_weighs(spark):
    rows = [("c", "e1", "direct_callee", "", 1, False), ("c", "e2", "direct_caller", "", 1, False)]
    e = spark.createDataFrame(rows, EVIDENCE)
    value = lambda *a: [v for _, v in values(ranking.scored_evidence(e, "relationship_trace", *a), "evidence_id", "value")]
    assert value() == [3240, 3240] and value("incoming") == [2880, 3240] and value("outgoing") == [3240, 2880] and value("outgoing", True) == [3240, 3240]


def test_terms_and_quotes(spark):
    from factline.plans import planning

    text = F.lit("fix ox-core/server.lua `a'b` exports['qb-core']")
    assert one(spark, planning.quoted(text)) == ["a'b", "qb-core"]
    assert one(spark, planning.task_terms(text)) == ["a'b", "qb-core", "ox-core/server.lua", "exports["]


@pytest.mark.parametrize(("reason", "distance", "tier"), [("direct_reference", 2, "peripheral"), ("direct_semantic", 1, "supporting"), ("direct_callee", 3, "supporting"), ("weak_exact_match", 2, "primary")])
def test_tiers(spark, reason, distance, tier):
    assert one(spark, ranking.tier(F.array(F.lit(reason)), F.lit(distance), F.lit(3), broad=False)) == tier


@pytest.mark.parametrize(("kind", "out", "into"), [("derived_from", "same_symbol", "same_symbol"), ("provided_by", "framework_provider", "framework_provider"), ("calls", "direct_callee", "direct_caller"), ("framework_object_call", "framework_provider", "framework_provider"), ("handles", "direct_semantic", "direct_semantic")])
def test_reasons_of_edges(spark, kind, out, into):
    assert [one(spark, ranking.edge_reason(F.lit(kind), F.lit(x))) for x in (True, False)] == [out, into]


def test_critical_supports_share_a_third(spark):
    rows = [("q", 1912, c, 1, 1, s, t) for c, s, t in (("a", 900, 100), ("b", 800, 900))]
    schema = "request string, budget long, candidate string, stage int, support int, score long, tokens long"
    got = packing.reserves(spark.createDataFrame(rows, schema))
    usable = (1912 - 256) // 3
    assert values(got, "candidate", "allocation", "reserve") == [("a", 100, 100 + usable // 2), ("b", usable // 2, 100 + usable // 2)]


def test_diversity():
    c = [{"id": i, "tier": t, "file": f, "resource": r} for i, t, f, r in ((1, "primary", "a", "x"), (2, "supporting", "a", "x"), (3, "supporting", "b", "x"), (4, "supporting", "c", "y"))]
    assert [x["id"] for x in ranking.diversity_order(c, 3)] == [1, 4, 3]


def test_packing_keeps_its_ceiling_and_grows_with_the_budget(spark):
    rows = [("q", b, f"c{i}", i % 4, i % 3, 100 + i * 7, 40 + i * 31) for b in (512,) for i in range(20)]
    schema = "request string, budget long, candidate string, stage int, support int, score long, tokens long"
    used = []
    for budget in (512, 2000, 8000):
        got = packing.pack(spark.createDataFrame([(r, budget, *x) for r, _, *x in rows], schema)).collect()
        used.append(max(r["used"] for r in got))
        assert used[-1] <= budget - min(max(budget // 20, 256), 1024)
    assert used == sorted(used)


def test_packages_keep_their_serialised_ceiling(spark):
    import json

    rows = [("q", b, f"c{i}", i % 4, i % 3, 100 + i, 400, "\n".join(f"line {i} {j}" for j in range(150))) for b in (600,) for i in range(12)]
    schema = "request string, budget long, candidate string, stage int, support int, score long, tokens long, text string"
    shown = []
    for budget in (600, 3000, 20_000):
        r = packing.assemble(spark.createDataFrame([(q, budget, *x) for q, _, *x in rows], schema)).first()
        package = json.loads(r["package"])
        assert r["tokens"] <= budget and len(package["sections"]) + len(package["omitted"]) <= 12
        shown.append(len(package["sections"]))
    assert shown == sorted(shown) and shown[-1] == 12 and r["complete"]


def test_skipping_greedy(spark):
    df = spark.createDataFrame([("r", 1, 60), ("r", 2, 50), ("r", 3, 40)], "request string, n int, size long")
    assert values(packing.fits_skipping(df, "request", ["n"], "size", 100), "n", "used") == [(1, 100), (3, 100)]


def test_slices_and_truncation():
    text = "\n".join(f"line {i} of the text" for i in range(200))
    cut = packing.slice_to_tokens(text, 100, packing.count_tokens)
    assert packing.count_tokens(cut) <= 100 and cut.startswith("line 0") and cut.endswith("line 199 of the text")
    short = scalar.smart_truncate(text, 500)
    assert len(short.encode()) <= 500 and "lines omitted" in short
    assert packing.slice_to_tokens("x" * 1000, 10, packing.count_tokens) == "x" * 40


def test_fair_share_and_ordinals(spark):
    df = spark.createDataFrame([("f", i) for i in range(9)] + [("g", 1)], "file string, line int")
    assert len(relational.fair_share(df, "file", 20, 6, "line").collect()) == 4
    got = values(relational.ordinals(df.withColumn("id", F.col("file")), "id", "line"), "unique_id")
    assert ("f~1",) in got and ("g",) in got


def test_repos_resolve_by_unique_suffix(spark):
    df = spark.createDataFrame([("a/x",), ("b/x",), ("b/y",), ("y",)], "repo string")
    assert values(relational.resolve_suffix(df, "x"), "repo") == []
    assert values(relational.resolve_suffix(df, "y"), "repo") == [("y",)]


def test_upserts_deletes_and_guards(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "path string, v int")
    assert values(tables.upserted(old, new, ["path"]), "path", "v") == [("a", 1), ("b", 3), ("c", 4)]
    df = spark.createDataFrame([("d",), ("d/x",), ("dx/y",)], "path string")
    assert values(tables.without_prefix(df, "d/"), "path") == [("dx/y",)]
    entities = spark.createDataFrame([("1", "own", "k", "f"), ("2", "own", "k", "g")], "id string, analyzer string, kind string, file_path string")
    left, edges = tables.without_file(entities, spark.createDataFrame([("1", "2"), ("2", "2")], "from_id string, to_id string"), "f")
    assert values(left, "id") == [("2",)] and values(edges, "from_id", "to_id") == [("2", "2")]
    assert tables.checked(entities, "own").count() == 2
    with pytest.raises(Exception, match="another analyzer"):
        tables.checked(entities, "other").collect()
    where = f"file://{tmp_path}/facts"
    tables.swap(spark, old, where)
    tables.swap(spark, new, where)
    assert values(spark.read.parquet(where), "path") == [("b",), ("c",)]
    tables.replace_partition(old, where + "2", "path")
    tables.replace_partition(spark.createDataFrame([(9, "a")], "v int, path string"), where + "2", "path")
    assert values(spark.read.parquet(where + "2"), "path", "v") == [("a", 9), ("b", 2)]
    assert tables.markdown(old).startswith("| path | v |")


def test_summaries(spark):
    pick = lambda d, s: one(spark, summaries.summary(F.lit(d), F.lit(s), F.lit("function"), F.lit("f")))
    assert pick("Opens it. And more.", "def f()") == "Opens it."
    assert pick("", "def f()") == "def f()" and pick("", "") == "function f"
    assert one(spark, summaries.clean_comment(F.lit("/** Opens.\n * Closes. */"))) == "Opens.\nCloses."


def test_paths_are_normalized_at_any_depth(spark):
    cases = {"a/./b": "a/b", "a/b/c/d/e/f/../../../../../x": "a/x", "../a/../b": "../b", "a/../../b": "../b", "/a//b/": "a/b", "": ""}
    assert {k: one(spark, resolve.normalized(F.lit(k))) for k in cases} == cases


def test_a_failed_swap_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.swap(spark, spark.range(3), path)
    with pytest.raises(Exception):
        tables.swap(spark, spark.range(9).select(F.raise_error(F.lit("no")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]
    tables.swap(spark, spark.range(4), path)
    assert spark.read.parquet(path).count() == 4


def test_reports_tell_what_they_leave_out(spark, tmp_path):
    df = spark.range(5).withColumn("t", F.lit("a|b"))
    assert "More than" not in tables.markdown(df) and "More than 4 rows" in tables.markdown(df, 4)
    tables.write_report(df, str(tmp_path), 4)
    assert spark.read.json(str(tmp_path / "json")).count() == 5


RUN = dict(task="t", category="c", tier="s", mode="phase7", budget=100, repeat=1, required_total=2, required_found=2, tokens=40, baseline=100, scoped_baseline=0, reads=1, rounds=1, ms=5, status="sufficient", precision=0.5, top5=1.0, top10=1.0, fabricated=False, leaked=False, varies=False, error="")
RUN["class"] = "supported_deterministic"


def run_table(spark, *changes):
    kinds = {int: "long", str: "string", float: "double", bool: "boolean"}
    return spark.createDataFrame([tuple((RUN | c).values()) for c in changes], ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in RUN.items()))


def test_reports_of_runs(spark):
    runs = run_table(spark, {}, {"budget": 200, "required_found": 1, "tokens": 60}, {"repeat": 2, "error": "timeout"}, {"repeat": 2, "tokens": 130, "precision": None}, {"mode": "phase7_no_early_stop", "tokens": 55, "reads": 0})
    got = evaluation.report(runs).first()
    assert (got["results"], got["tasks"], got["passed_retrieval"], got["false_sufficiency"], got["runtime_errors"], got["budget_violations"], got["empty_retrieval"]) == (4, 1, 1, 1, 2, 1, 1)
    assert (got["false_sufficiency_max_budget"], got["false_sufficiency_supported"], got["early_stop_tokens"], got["early_stop_reads"]) == (1, 1, 15, 0)
    assert (got["median_saving"], got["median_supported_saving"], got["median_scoped_saving"]) == (0.5, 0.4, 0.0)
    gates = evaluation.gates(runs).first()
    assert not gates["false_sufficiency_zero"] and gates["panoramic_baseline_zero"] and not gates["supported_recall_at_least_95"]
    assert [tuple(r) for r in evaluation.acceptance(runs).collect()] == [("supported_deterministic", 1, 0)]


def test_reports_of_nothing_and_of_other_modes(spark):
    nothing = run_table(spark, {}).limit(0)
    got = evaluation.report(nothing).first()
    assert (got["results"], got["median_recall"], got["early_stop_tokens"]) == (0, 0.0, 0)
    assert not evaluation.gates(nothing).first()["false_sufficiency_below_5"] and evaluation.summaries(nothing).count() == 0
    assert evaluation.report(run_table(spark, {"mode": "manual"}, {"mode": "primitive"})).first()["results"] == 2


def test_kinds_without_needs_have_full_recall(spark):
    need = spark.createDataFrame([("a", "file", 1), ("a", "file", 2)], "task string, kind string, item int")
    got = evaluation.kind_recall(need, need.filter("item = 1").select("task", "item"), spark.createDataFrame([("a",), ("b",)], "task string"), ("file", "symbol"))
    assert values(got, "task", "kind", "recall") == [("a", "file", 0.5), ("a", "symbol", 1.0), ("b", "file", 1.0), ("b", "symbol", 1.0)]
