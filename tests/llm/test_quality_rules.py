import math
import random
from collections import Counter

import numpy as np

from quarrylens.llm import quality_rules as Q


def brute_repeat(words):
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_repeated_words_against_brute_force():
    r = random.Random(2)
    for _ in range(300):
        words = [r.choice("abc") for _ in range(r.randrange(40))]
        assert Q.repeated_words(words) == brute_repeat(words)


def test_base_facts():
    assert Q.base_facts(None) == Q.base_facts("") == (0, 0, 0, 0, 0)
    assert Q.base_facts("a b\x0bc\n\n\na b\x0bc\n# <x> y") == (8, 12, 3, 1, 0)


LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, score string, kept int"


def test_scores_against_brute_force(spark):
    r = random.Random(4)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(30))
    rows = [(i, text("abcde"), "s", 1) for i in range(30)] + [(100 + i, text("#$%&"), "s", 1) for i in range(10)]
    rows += [(None, None, None, None), (500, "", "", 0), (501, "ab", "", 0), (7, rows[7][1], "twin", 2), (600, "long " * 30000, "", 0)]
    labels = [(i, 1, 0) for i in range(0, 30, 2)] + [(100, 0, 0), (2, 1, 1), (4, 1, None), (None, 1, 0)]
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = Q.quality_rules(docs, table, n=3, buckets=256, threshold=-0.2)
    assert got.columns == [*docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_score", "_kept"]
    trusted = {i for i in range(0, 30, 2)} - {2}
    good, raw = np.zeros(256), np.zeros(256)
    grams = [np.concatenate([np.zeros(0, int), *Q.grams(t or "", 3, 256)]) for _, t, _, _ in rows]
    for (i, *_), g in zip(rows, grams):
        raw += np.bincount(g, minlength=256)
        if i in trusted:
            good += np.bincount(g, minlength=256)
    ratio = [math.log((a + 1) / (good.sum() + 256)) - math.log((b + 1) / (raw.sum() + 256)) for a, b in zip(good, raw)]
    found = {(x.doc_id, x.text): x for x in got.collect()}
    assert len(found) == len(rows) - 1  # the twin differs in other columns only
    for (i, t, *_), g in zip(rows, grams):
        score = sum(ratio[k] for k in g) / len(g) if len(g) else 0.0
        x = found[i, t]
        words = (t or "").split()
        failed = len(words) < 10 or 100 * brute_repeat(words) > 20 * len(words)
        assert abs(x._score - score) < 1e-9 and x.base_failed == failed and x._kept == (not failed and score >= -0.2)
    mean = lambda a, b: np.mean([found[i, t]._score for i, t, *_ in rows if i is not None and a <= i < b])
    assert mean(100, 110) < mean(0, 30) - 0.3


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert Q.quality_rules(none, spark.createDataFrame([], LABELS)).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g h i j k", "", 0)], DOCS)
    assert [r._score for r in Q.quality_rules(one, spark.createDataFrame([], LABELS)).collect()] == [0.0]


def test_long_text_is_counted_in_slices(monkeypatch):
    text = "".join(random.Random(9).choice("abc é") for _ in range(3000))
    whole = np.sort(np.concatenate(list(Q.grams(text, 4, 1024))))
    monkeypatch.setattr(Q, "_SLICE", 100)
    assert (np.sort(np.concatenate(list(Q.grams(text, 4, 1024)))) == whole).all()


def test_counts_wait_in_bounded_memory(spark, monkeypatch):
    r = random.Random(10)
    texts = ["".join(r.choice("abc é") for _ in range(r.randrange(900))) for _ in range(60)] + [None, "", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 3)], LABELS)
    monkeypatch.setattr(Q, "_SLICE", 100)
    good, raw = Q.count_grams(docs, labels, id_col="doc_id", text_col="text", n=4, buckets=1024)
    monkeypatch.undo()
    count = lambda some: np.bincount(np.concatenate([np.zeros(0, int), *(g for t in some for g in Q.grams(t or "", 4, 1024))]), minlength=1024)
    assert (raw == count(texts)).all() and (good == count(texts[:60:3])).all()
