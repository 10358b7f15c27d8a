import itertools
import random
from fractions import Fraction

import numpy as np

from quarrylens.llm import source_mixing as X

DOCS = "doc_id long, text string, source string, size int, taken string, target string"


def test_targets():
    got = X.targets({"a": 100, "b": 100, None: 100})
    assert got == {"a": Fraction(200), "b": Fraction(500, 3), None: Fraction(250, 3)}
    assert sum(got.values()) == 450
    assert X.targets({}) == {} and X.targets({"a": 0}) == {"a": 0}
    for seed in range(50):
        r = random.Random(seed)
        sizes = {f"s{i}": r.randrange(50) for i in range(r.randrange(1, 9))}
        t = X.targets(sizes)
        assert all(t[s] <= 2 * n for s, n in sizes.items()) and sum(t.values()) == Fraction(3 * sum(sizes.values()), 2)


def test_budget_is_met_as_near_as_lengths_allow():
    for seed in range(300):
        r = random.Random(seed)
        lengths = np.array(sorted(r.sample(range(1, 30), r.randrange(1, 5))))
        counts = np.array([r.randrange(1, 4) for _ in lengths])
        budget = r.randrange(0, int((lengths * counts).sum()) + 5)
        take = X.fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        total = int((lengths * take).sum())
        best = max(s for k in itertools.product(*(range(c + 1) for c in counts)) if (s := int((lengths * np.array(k)).sum())) <= max(budget, 0))
        assert total == best and total <= budget


def test_greedy_step_before_the_programme():
    lengths, counts = np.array([3, 1000, 70_001]), np.array([50_000, 900, 40])
    assert abs(int((lengths * X.fit_budget(lengths, counts, 2_345_678, dp_words=2000)).sum()) - 2_345_678) <= 2


def rows():
    r = random.Random(7)
    out = [(i, "w " * r.randrange(0, 40), r.choice(["a", "b", "c", None, "é"]), 1, "x", "y") for i in range(400)]
    out += [(1000 + i, "same text here", "hot", 1, "", "") for i in range(300)] + [(5, None, "a", 0, "", ""), (None, "null id", "b", 0, "", ""), (7, "twin", "b", 0, "", ""), (7, "twin", "b", 0, "", ""), (8, "z " * 50_000, "long", 0, "", "")]
    return out


def test_mix(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    got = X.mix_sources(docs).collect()
    assert len(got) == len(rows())
    names = ["doc_id", "text", "source", "size", "taken", "target"]
    assert got[0].__fields__ == [*names, "_size", "source_size", "_target", "_taken"]
    sizes = {}
    for r in got:
        assert r._size == len((r.text or "").split()) and r._taken in (0, r._size, 2 * r._size)
        sizes[r.source] = sizes.get(r.source, 0) + r._size
    want = X.targets(sizes)
    for s, n in sizes.items():
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {n} and {r._target for r in mine} == {float(want[s])}
        near = sum(r._taken for r in mine)
        assert near <= want[s] + 1 and want[s] - near <= (50_000 if s == "long" else 3)
    again = X.mix_sources(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r._taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_empty(spark):
    assert X.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    assert [r._taken for r in X.mix_sources(spark.createDataFrame([(1, None, None, 0, "", "")], DOCS)).collect()] == [0]


def test_no_greedy_choice_stands_in_the_way():
    lengths = np.array([100_000, 71_000, 70_000])
    assert X.fit_budget(lengths, np.array([1, 1, 1]), 150_000).tolist() == [0, 1, 1]
    assert (X.fit_budget(np.array([80_000, 100_000]), np.array([2, 2]), 170_000) * [80_000, 100_000]).sum() == 160_000
    assert (X.fit_budget(np.array([100_003, 99_991]), np.array([5, 5]), 350_000) * [100_003, 99_991]).sum() == 300_009
    for seed in range(300):
        r = random.Random(seed)
        lengths = np.array(sorted(r.sample(range(50, 400), r.randrange(2, 6)))) * r.choice([1, 6])
        counts = np.array([r.randrange(1, 4) for _ in lengths])
        total = int((lengths * counts).sum())
        budget = r.randrange(0, total)
        best = max(s for k in itertools.product(*(range(c + 1) for c in counts)) if (s := int((lengths * np.array(k)).sum())) <= budget)
        take = X.fit_budget(lengths, counts, budget, dp_words=100)
        got = int((lengths * take).sum())
        assert (take <= counts).all() and (take >= 0).all() and got <= budget
        assert got == best or budget > X.LONGEST_TIMES * lengths.max() and best - got <= lengths.min() // 10


def test_coarse_units_leave_little():
    for seed in range(50):
        r = random.Random(seed)
        lengths = np.array(sorted(r.sample(range(1000, 40_000), 30)))
        counts = np.array([r.randrange(1, 5) for _ in lengths])
        budget = r.randrange(int((lengths * counts).sum()))
        got = int((lengths * X.fit_budget(lengths, counts, budget, dp_words=100, most_sums=3000)).sum())
        assert 0 <= budget - got <= 1000


def test_more_slices_give_the_same_words(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), DOCS)
    words = lambda: {r[0]: r[1] for r in X.mix_sources(docs).groupBy("source").sum("_taken").collect()}
    want = words()
    monkeypatch.setattr(X, "SLICE_ROWS", 5)
    monkeypatch.setattr(X, "MOST_SENT", 2)
    assert words() == want
