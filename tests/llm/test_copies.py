import hashlib
import random

import numpy as np
import pytest
import xxhash

from factline.llm import components, order_minhash, queries, simhash, substring_dedup, suffix_array

D = "/root/testdata/sf0.001"


def union(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("trial", range(60))
def test_suffix_array_against_sorting(trial):
    r = np.random.default_rng(trial)
    n, k = int(r.integers(1, 150)), int(r.integers(1, 5))
    t = r.integers(0, k, n).astype(np.int16)
    if trial % 3 == 0:
        t = np.tile(t[: max(1, n // 4)], 5)
    got = suffix_array.suffix_array(t, k, 10**6)
    assert got.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    lcp = suffix_array.common_prefixes(t, got, 1000)
    for a, b in zip(got, got[1:]):
        n = 0
        while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        assert lcp[b] == n


def brute_repeats(rows, width=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], (r[1] or "").encode())):
        b = (t or "").encode()
        off = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                off[s : s + width] = True
            seen.add(w)
        spans = int((off[1:] & ~off[:-1]).sum()) + int(len(off) > 0 and off[0])
        out.append((str(i), len(b), int(off.sum()), spans, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~off].tobytes()).hexdigest()))
    return sorted(out)


def test_repeats_against_brute_force(spark, texts):
    got = sorted((str(r[0]), *r[1:]) for r in map(tuple, queries.op7_substring_dedup(spark, D).collect()))
    assert got == brute_repeats(list(texts.items()))


def test_repeats_of_odd_rows(odd, odd_rows, empty, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 20_000)
    monkeypatch.setattr(substring_dedup, "SHARD", 9_000)
    monkeypatch.setattr(substring_dedup, "SORTED", 5_000)
    rows = [(str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in substring_dedup.drop_repeats(odd).collect()]
    assert sorted(rows) == brute_repeats([r[:2] for r in odd_rows])
    assert substring_dedup.drop_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [0, 3, 32])
def test_repeats_of_planted_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_BLOCKS", hot)
    monkeypatch.setattr(substring_dedup, "BLOCK", 3_000)
    monkeypatch.setattr(substring_dedup, "SHARD", 2_000)
    r = random.Random(4)
    noise = lambda n: "".join(r.choice("abcdefgh \x00") for _ in range(n))
    passage, period = noise(260), "xyz" * 90
    rows = [(i, noise(r.randint(0, 150)) + (passage[i : 230 + i] if i % 2 else period) + noise(r.randint(0, 99))) for i in range(40)] + [(90, "z" * 400), (91, passage[:99]), (92, passage[:100])]
    got = substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in got) == brute_repeats(rows)


def brute_print(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=2):
    prints = [brute_print(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= radius]
    root = union(len(rows), pairs)
    ids = {}
    for (i, _), r in zip(rows, root):
        ids[r] = min([x for x in (ids.get(r), i) if x is not None], default=None)
    return sorted((str(i), f"{p:016x}", str(ids[r])) for (i, _), p, r in zip(rows, prints, root))


def test_groups_against_brute_force(spark, texts, odd, odd_rows, empty):
    got = sorted((str(r[0]), r[1], str(r[2])) for r in queries.op9_simhash(spark, D).collect())
    assert got == brute_groups(list(texts.items()))
    rows = sorted((str(r["doc_id"]), f"{r['fingerprint'] & (1 << 64) - 1:016x}", str(r["component_id"])) for r in simhash.near_groups(odd).collect())
    assert rows == brute_groups([r[:2] for r in odd_rows])
    assert simhash.near_groups(empty).count() == 0 and simhash.near_copies(empty).count() == 0
    assert simhash.near_copies(odd).count() == len(odd_rows)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_forests_against_pairs(radius):
    r = np.random.default_rng(radius)
    p = []
    for b in r.integers(0, 2**63, 60, dtype=np.uint64):
        for _ in range(4):
            x = int(b)
            for _ in range(r.integers(0, 4)):
                x ^= 1 << int(r.integers(0, 64))
            p.append(x)
    p = np.unique(np.array(p, dtype=np.uint64))
    near = [(a, b) for a in range(len(p)) for b in range(a) if int(p[a] ^ p[b]).bit_count() <= radius]
    assert simhash.forest_of_one(p, radius).tolist() == union(len(p), near)
    bucket = np.arange(len(p)) // 20
    inside = [(a, b) for a, b in near if bucket[a] == bucket[b]]
    assert simhash.forest_of_many(p, bucket, radius, 20).tolist() == union(len(p), inside)


def test_large_buckets_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    r = random.Random(2)
    prints = sorted({(0xABCDEF << 30) ^ sum(1 << r.randrange(0, 14) for _ in range(3)) for _ in range(150)})
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), 2).collect()
    at = {p: i for i, p in enumerate(prints)}
    want = union(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert union(len(prints), [(at[e["u"]], at[e["v"]]) for e in edges]) == want


def test_components_of_random_graphs(spark):
    r = random.Random(8)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = union(400, [e for e in edges if e[0] != e[1]])
    assert got == {n: root[n] for e in edges if e[0] != e[1] for n in e}


def test_near_copies_are_found_and_others_left(spark):
    from samples import prose

    rows = []
    for i in range(40):
        words = prose(1000 + i, 200).split()
        rows.append((10 * i, " ".join(words)))
        edited = list(words)
        edited[50 + i % 60] = "changed"
        rows.append((10 * i + 1, " ".join(edited)))
        rows.append((10 * i + 2, " ".join(words[100:] + prose(5000 + i, 150).split())))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[10 * i + 1] == 10 * i and got[10 * i + 2] == 10 * i + 2 for i in range(40))


def spark_hash(*values):
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little") if isinstance(v, int) else v
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h


def brute_signature(text):
    import re

    w, k = re.findall(r"[^\x20\x09-\x0D]+", text or ""), order_minhash.K
    if not w:
        return ""
    if len(w) < k or len(text) > order_minhash.SPARSE * len(w):
        w, k = list(text), order_minhash.K_CHARS
    seen, packed = {}, []
    for p in range(max(1, len(w) - k + 1)):
        h = spark_hash(*w[p : p + k])
        o = seen[h] = seen.get(h, -1) + 1
        if o:
            h = xxhash.xxh64_intdigest(o.to_bytes(4, "little"), seed=spark_hash(h))
        packed.append((h % order_minhash.BINS, h >> 64 - order_minhash.HASH_BITS, p))
    out = []
    for b in range(order_minhash.BINS):
        two = sorted(x for x in packed if x[0] == b)[:2]
        if two:
            values = [x[0] << order_minhash.HASH_BITS | x[1] for x in sorted(two, key=lambda x: x[2])]
            out.append(f"{b}:{spark_hash(*values):016X}"[: len(f"{b}:") + 8])
    return " ".join(out)


def brute_likeness(a, b):
    a, b = (dict(x.split(":") for x in brute_signature(t).split()) for t in (a, b))
    return sum(a.get(k) == v for k, v in b.items()) / len({*a, *b}) if a or b else 1.0


def test_runs_are_found_by_levels(spark):
    bounds = list(range(-50, 60_000, 7))
    values = [-50, -49, 0, 6, 59_989, 59_990, 70_000, 31_337]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", order_minhash._run_of(bounds, order_minhash.F.col("v")).alias("r")).collect()
    assert {r["v"]: r["r"] for r in got} == {v: sum(b <= v for b in bounds) - 1 for v in values}


def test_texts_without_blanks_change_in_part(spark):
    r = random.Random(1)
    text = "".join(r.choice("天地玄黄宇宙洪荒日月盈昃") for _ in range(3000))
    rows = [(1, text), (2, "short one"), (3, "short ones")]
    got = {x["doc_id"]: x for x in order_minhash.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 0 < got[1]["near_edited"] < 1 and got[2]["near_next"] > 0


def test_signatures_against_brute_force(spark, odd, odd_rows, texts):
    from pyspark.sql import functions as F

    both = [(t or "",) for t in [*texts.values(), *(r[1] for r in odd_rows)]]
    got = order_minhash.signature(spark.createDataFrame(both, "t string"), "t", "s").select("t", F.array_join("s", " ").alias("s")).collect()
    for r in got:
        assert r["s"] == brute_signature(r["t"])


def test_edited_texts(spark, texts, odd, odd_rows, empty):
    rows = queries.op8_order_minhash(spark, D).orderBy("doc_id").collect()
    order = sorted(texts)
    for k, r in enumerate(rows):
        t, nxt = texts[order[k]], texts[order[(k + 1) % len(order)]]
        c = len(t) // 4
        edited = t[: len(t) - c] + nxt[:c]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == brute_signature(t) and r["edited_fingerprint"] == brute_signature(edited)
        assert abs(r["near_next"] - brute_likeness(t, nxt)) < 1e-12 and abs(r["near_edited"] - brute_likeness(t, edited)) < 1e-12
    assert sum(r["near_edited"] for r in rows) / len(rows) > 0.25
    out = order_minhash.compare_edited(odd).collect()
    assert len(out) == len(odd_rows)
    assert order_minhash.compare_edited(empty).count() == 0


def test_runs_close_with_the_next_row(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "RUN", 60)
    rows = [(3 * i, f"text number {i} of all") for i in range(20)] + [(9, "another of nine")]
    got = order_minhash.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    order = sorted(rows)
    assert sorted((r["doc_id"], r["text"], r["_next"]) for r in got) == sorted((*order[k], order[(k + 1) % len(order)][1]) for k in range(len(order)))
