import random

from factline.llm import simhash


def words(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def test_a_repeated_refrain_does_not_part_near_copies(spark):
    r = random.Random(5)
    rows = []
    for k, (n, long, times) in enumerate([(300, 8, 16)] * 6 + [(1000, 6, 70)] * 6 + [(3000, 8, 60)] * 3):
        body, refrain = words(r, n), words(r, long)
        rows += [(2 * k, " ".join(body)), (2 * k + 1, " ".join(body + refrain * times))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(docs).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
    assert {x["doc_id"] for x in simhash.first_of_copies(docs).collect()} == {i for i, _ in rows if i % 2 == 0}


def test_similarity_is_decided_exactly(spark):
    r = random.Random(6)
    rows = []
    for k in range(120):
        a, b = words(r, 900), words(r, 900)
        same = 801 if k % 2 else 790  # of 896 shingles each: 797 shared is 0.801, 786 shared is 0.781
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(a[:same] + b[same:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(docs).collect()}
    assert got == {i: i - i % 2 if i // 2 % 2 else i for i, _ in rows}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {}
    for seed in sorted(sets):
        front = [] if seed in root else [seed]
        while front:
            a = front.pop()
            if a not in root:
                root[a] = seed
                front += [b for b in sets if b not in root and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return root


def test_every_removal_has_a_chain_of_links(spark, docs, texts, monkeypatch):
    want = brute(texts)
    got = lambda: {x["doc_id"]: x["component_id"] for x in simhash.near_copies(docs).collect()}
    assert got() == want
    assert {x["doc_id"] for x in simhash.first_of_copies(docs).collect()} == set(want.values())
    monkeypatch.setattr(simhash, "EXACT_PART", 2)
    assert got() == want
