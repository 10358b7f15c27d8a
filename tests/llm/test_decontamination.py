import random

import pytest

from quarrylens.llm import decontamination as D


def sub_distance(pattern, text):
    """Least edit distance of pattern to any part of text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_against_brute_force():
    r = random.Random(1)
    for _ in range(1500):
        pattern = "".join(r.choice("abc ") for _ in range(r.randrange(1, 90)))
        text = "".join(r.choice("abc ") for _ in range(r.randrange(60)))
        if r.random() < 0.5:
            cut = list(pattern)
            for _ in range(r.randrange(6)):
                cut[r.randrange(len(cut))] = r.choice("abcd")
            text += "".join(cut)
        k = r.randrange(8)
        assert D.Pattern(pattern, k).within(text) == (sub_distance(pattern, text) <= k)


BENCH = [(1, "The quick brown fox jumps over the lazy dog and runs away from the angry farmer"), (2, "  "), (3, None), (None, "no id at all here"), (4, "Short one"), (5, "The quick brown fox jumps over the lazy dog and runs away from the angry farmer"), (6, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich und zurück")]
DOCS = "doc_id long, text string, items string, contaminated int"


@pytest.mark.parametrize("blocks", [{}, {"block_chars": 60, "span_chars": 200}, {"block_chars": 60, "blocks_a_pass": 2}])
def test_matches_against_brute_force(spark, blocks):
    r = random.Random(2)
    rows = []
    for i in range(80):
        words = [r.choice(["alpha", "beta", "the", "quick", "dog"]) for _ in range(r.randrange(40))]
        if r.random() < 0.7:
            item = list(r.choice([b for _, b in BENCH if b and b.strip()]))
            for _ in range(r.randrange(7)):
                at = r.randrange(len(item))
                item[at : at + 1] = r.choice([[], ["q"], [item[at], "z"]])
            words.insert(r.randrange(len(words) + 1), "".join(item).replace(" ", r.choice([" ", "\n", "  "])).upper() if r.random() < 0.3 else "".join(item))
        rows.append((i, " ".join(words), "", 0))
    rows += [(100, None, "", 0), (101, "", "", 0), (None, BENCH[0][1], "", 0), (102, "x " * 100_000 + BENCH[5 - 1][1], "", 0), (3, rows[3][1], "", 0)]
    got = D.find_benchmark_items(spark.createDataFrame(rows, DOCS), spark.createDataFrame(BENCH, "item_id long, text string"), **blocks)
    steps = got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert steps == 1  # one Python step a stage, however many blocks
    assert got.columns == ["doc_id", "text", "items", "contaminated", "_items", "_contaminated"]
    out = got.collect()
    assert len(out) == len(rows)
    for x in out:
        if x.doc_id == 102:
            assert x._items == [4]
            continue
        text = D.plain(x.text)
        want = []
        for i, b in BENCH:
            p = D.plain(b)
            if i is not None and p and text and sub_distance(p, text) <= len(p) * 5 // 100:
                want.append(i)
        assert x._items == sorted(want) and x._contaminated == bool(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "", 0)], DOCS)
    assert [r._items for r in D.find_benchmark_items(docs, spark.createDataFrame([], "item_id long, text string")).collect()] == [[]]
    assert D.find_benchmark_items(docs.where("false"), spark.createDataFrame(BENCH, "item_id long, text string")).count() == 0


def test_pieces_cover_the_item():
    for m in range(1, 60):
        for k in range(min(m, 6)):
            parts = D.pieces(m, k)
            assert len(parts) == k + 1 and parts[0][0] == 0 and parts[-1][1] == m and all(a[1] == b[0] and a[0] < a[1] for a, b in zip(parts, parts[1:]))
