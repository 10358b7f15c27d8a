import random

import pytest

from quarrylens.llm import line_dedup as L

DOCS = "doc_id long, text string, line_no string, dropped int, tag int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, min_words=3, near=8):
    lines = [(i, n, x.encode().lower().split()) for i, t in sorted(rows) for n, x in enumerate(t.split("\n"))]
    out = {}
    for k, (i, n, w) in enumerate(lines):
        if len(w) >= min_words and any(w == v or min(len(w), len(v)) >= near and distance(w, v) <= 1 for _, _, v in lines[:k]):
            out.setdefault(i, []).append(n)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    base = [[f"w{r.randrange(9)}" for _ in range(r.randrange(1, 20))] for _ in range(12)]

    def line():
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            at = r.randrange(len(w) + 1)
            kind = r.randrange(3)
            if kind == 0:
                w.insert(at, f"w{r.randrange(9)}")
            elif w and kind == 1:
                del w[at % len(w)]
            elif w:
                w[at % len(w)] = f"w{r.randrange(9)}"
        text = "  ".join(w) if r.random() < 0.2 else " ".join(w)
        return text.upper() if r.random() < 0.2 else text

    rows = [(i, "\n".join(line() for _ in range(r.randrange(12)))) for i in range(40)]
    got = {x.doc_id: x for x in L.dedup_lines(spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], DOCS)).collect()}
    want = brute(rows)
    assert {i: list(x.dropped) for i, x in got.items() if x.dropped} == want
    for i, t in rows:
        parts = t.split("\n")
        assert got[i].n_lines == len(parts) and got[i].text == "\n".join(p for n, p in enumerate(parts) if n not in want.get(i, []))


def test_screen_misses_no_pair():
    r = random.Random(3)
    for _ in range(3000):
        a = [bytes([97 + r.randrange(3)]) for _ in range(r.randrange(2, 40))]
        b = list(a)
        at, kind = r.randrange(len(b)), r.randrange(3)
        if kind == 0:
            b.insert(at, b"z")
        elif kind == 1:
            b[at] = b"z"
        elif len(b) > 2:
            del b[at]
        assert set(L.screen_keys(a)) & set(L.screen_keys(b))


def test_variants_meet_exactly_at_distance_one():
    r = random.Random(4)
    for _ in range(3000):
        a = [bytes([97 + r.randrange(2)]) for _ in range(r.randrange(2, 8))]
        b = [bytes([97 + r.randrange(2)]) for _ in range(r.randrange(2, 8))]
        x, y = L.variant_keys(a), L.variant_keys(b)
        meet = x[0] == y[0] or x[0] in y[1] or y[0] in x[1] or bool(set(x[2].tolist()) & set(y[2].tolist()))
        assert meet == L.within_one(a, b) == (distance(a, b) <= 1)


def test_defined_cases(spark):
    same = "one two three four"
    rows = [(1, same), (None, same), (2, None), (3, ""), (4, f"{same}\n\n{same}"), (5, same + "\nx"), (5, same + "\nx"), (6, "a b\na b"), (7, "long " * 30_000)]
    got = L.dedup_lines(spark.createDataFrame([(i, t, "", 0, 0) for i, t in rows], DOCS)).collect()
    assert len(got) == len(rows)
    kept = sorted((str(r.doc_id), r.text, r.n_lines) for r in got if r.doc_id != 7 and r.doc_id != 2)
    assert kept == sorted([("None", same, 1), ("1", "", 1), ("3", "", 1), ("4", "", 3), ("5", "x", 2), ("5", "x", 2), ("6", "a b\na b", 2)])
    assert [r.text for r in got if r.doc_id == 2] == [None]
    assert L.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        L.dedup_lines(spark.createDataFrame([], DOCS), near_words=1)
