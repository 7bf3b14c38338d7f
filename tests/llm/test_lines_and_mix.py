import collections
import hashlib

import duckdb

from factline.llm import line_dedup, mixing, queries

BLANK = " \t\n\x0b\x0c\r"
D = "/root/testdata/sf0.001"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute_lines(rows, min_chars, min_docs):
    held = collections.defaultdict(set)
    low = -(2**63)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(low if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and (low if i is None else i) < max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_against_brute_force(odd, odd_rows):
    got = line_dedup.drop_repeated_lines(odd, min_chars=40, min_docs=3)
    rows = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect())
    assert rows == sorted((str(i), a, b, t) for i, a, b, t in brute_lines([r[:2] for r in odd_rows], 40, 3))
    assert sum(r[2] for r in rows) > 5
    assert got.columns[-3:] == ["text", "n_lines", "n_dropped"]


def test_lines_of_an_empty_table(empty):
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def run_sql(name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{D}/documents.parquet'")
    return con.sql(queries.ORACLE_SQL[name]).fetchall()


def test_lines_against_sql(spark):
    got = {tuple(r) for r in queries.op5_line_dedup(spark, D).collect()}
    assert got == set(run_sql("op5_line_dedup"))


def shares(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing the excess until no source is above its most."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[n] for n in full)
        total = sum(w[n] for n in names if n not in full) or 1
        new = {n for n in names if n not in full and rest * w[n] / total > most * sizes[n]}
        if not new:
            return {n: float(most * sizes[n]) if n in full else rest * w[n] / total for n in names}
        full |= new


def check_mix(rows, sources):
    sizes = collections.Counter()
    for r, s in zip(rows, sources):
        sizes[s] += r["size"]
    want = shares(dict(sizes))
    taken, largest = collections.Counter(), collections.Counter()
    for r, s in zip(rows, sources):
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1


def test_mix_on_documents(spark, docs):
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    rows = queries.op2_mixing(spark, D).collect()
    check_mix(rows, [source[r["doc_id"]] for r in rows])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op2_mixing(spark, D).collect()))
    again = {(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in run_sql("op2_mixing")}
    assert {(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in rows} == again


def test_mix_of_odd_rows(odd, odd_rows, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows)
    check_mix(rows, [r["source"] for r in rows])
    assert mixing.mix(empty).count() == 0


def test_mix_caps_small_sources_and_repeats_epochs(spark):
    rows = [(i, "w " * 10, "big") for i in range(300)] + [(1000 + i, "w " * 10, s) for s in "xyz" for i in range(2)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    check_mix(got, [r["source"] for r in got])
    assert {r["taken"] for r in got if r["source"] == "x"} == {30}


def test_many_buckets_sum_alike(spark, docs, monkeypatch):
    whole = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "BUCKET", 2)
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()} == whole


def test_sha_of_kept_lines(spark, texts):
    got = {r["doc_id"]: r["kept_sha256"] for r in queries.op5_line_dedup(spark, D).collect()}
    for i, _, _, t in brute_lines(list(texts.items()), 40, 5):
        assert got[i] == hashlib.sha256(t.encode()).hexdigest()
