import random

import numpy as np
import pytest

from quarrylens.llm import minhash_dedup as M

DOCS = "doc_id long, text string, lead long, component_id string, key int"


def brute(rows, k):
    """component of each doc_id by comparing all texts."""
    sets = [(i, M.shingles((t or "").encode().lower().split(), k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}, [len(s) for _, s in sets]


def corpus(seed):
    r = random.Random(seed)
    base = [[f"w{r.randrange(400)}" for _ in range(r.randrange(30, 90))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = list(r.choice(base))
        for _ in range(r.randrange(5)):
            words[r.randrange(len(words))] = f"e{r.randrange(30)}"
        rows.append((i, " ".join(words)))
    rows += [(200, "one"), (201, "ONE"), (202, "two"), (203, ""), (204, None), (205, " \n"), (206, "Éa b c"), (207, "éa b c"), (208, "x " * 20000), (209, "X " * 15000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_components_against_brute_force(spark, k):
    rows = corpus(k)
    docs = spark.createDataFrame([(i, t, 0, "c", 0) for i, t in rows], DOCS)
    got = {r.doc_id: r for r in M.near_duplicates(docs, shingle_words=k).collect()}
    want, sizes = brute(rows, k)
    assert {i: r.component_id for i, r in got.items()} == want
    assert [got[i].n_shingles for i, _ in rows] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_null_and_repeated_ids(spark):
    a, b, c = ("alpha beta gamma delta " * 5 + x for x in ("one two", "three four five six seven", "one two"))
    rows = [(5, a), (5, "quite other words stand here"), (9, "quite other words stand here"), (None, a), (None, None), (7, c), (7, c), (8, b + " more and more words to be apart")]
    got = sorted(tuple(r) for r in M.near_duplicates(spark.createDataFrame([(i, t, 0, "", 0) for i, t in rows], DOCS), shingle_words=2).select("doc_id", "component_id", "kept").na.fill(-1).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (5, 5, True), (5, 5, True), (7, 5, False), (7, 5, False), (8, 8, True), (9, 5, False)]


def test_empty(spark):
    assert M.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_signature_is_superminhash():
    """Each slot holds the least rank-and-fraction over the elements' own permutations."""
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (1, 2, 7, 40, 400)]
    got = M.superminhash(np.concatenate(sets), np.repeat(np.arange(5), [len(x) for x in sets]), 5, 20)
    for want_of, row in zip(sets, got):
        want = [1 << 64] * 20
        for e in want_of.tolist():
            places = list(range(20))
            for rank in range(20):
                draw = int(M._mix(np.array([(e + (rank + 1) * int(M._A)) % (1 << 64)], np.uint64))[0])
                k = rank + ((draw & 0xFFFFFFFF) * (20 - rank) >> 32)
                slot = places[k]
                places[k] = places[rank]
                want[slot] = min(want[slot], rank << 32 | draw >> 32)
        assert row.tolist() == want


def test_bitmaps_rule_out_without_loss(spark):
    r = random.Random(6)
    rows = []
    for _ in range(300):
        a = [r.randrange(1 << 63) for _ in range(r.randrange(1, 300))]
        b = set(r.sample(a, r.randrange(len(a) + 1))) | {r.randrange(1 << 63) for _ in range(r.randrange(40))}
        a = set(a)
        linked = bool(b) and 100 * len(a & b) >= 80 * len(a | b)
        if b:
            rows.append((len(a), len(b), M.parity_bits(np.array(sorted(a), np.uint64)).tolist(), M.parity_bits(np.array(sorted(b), np.uint64)).tolist(), linked))
    df = spark.createDataFrame(rows, "n long, m long, x array<long>, y array<long>, linked boolean")
    got = df.selectExpr("linked", M.may_be_similar("n", "m", "x", "y", 80) + " as may").collect()
    assert all(g.may for g in got if g.linked) and sum(not g.may for g in got) > 50 and any(g.linked for g in got)


def test_components_of_chains(spark):
    r = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(100, 150), (150, 120), (200, 201)]
    r.shuffle(links)
    got = {x.node: x.root for x in M.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {120: 100, 150: 100, 201: 200}


@pytest.mark.parametrize("hub_links", [0, 3])
def test_components_with_hubs(spark, monkeypatch, hub_links):
    monkeypatch.setattr(M, "HUB_LINKS", hub_links)
    monkeypatch.setattr(M, "HUB_SHARE", 50)
    links = [(0, i) for i in range(1, 200)] + [(i, i + 1000) for i in range(50, 90)] + [(500, i) for i in range(501, 700)] + [(1060, 650)]
    got = {x.node: x.root for x in M.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {n: 0 for link in links for n in link if n}
