import random

import pytest

from quarrylens.operators import textindex as X


@pytest.mark.parametrize("small_chars", [0, 1_000_000])
def test_names_in_texts_against_brute_force(spark, small_chars):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randrange(1, 7)))
    names = [word() for _ in range(120)] + ["", None, "AB", "ab", "a", "zzz"]
    texts = [(i, "".join(r.choice("abcdé ABC") for _ in range(r.randrange(60)))) for i in range(80)] + [(200, None), (201, ""), (5, "twice abc"), (None, "no id abc")]
    got = X.contained(spark.createDataFrame(texts, "doc long, body string"), spark.createDataFrame([(n,) for n in names], "name string"), "doc", "body", "name", small_chars).collect()
    want = sorted((str(i), n) for i, t in texts if t is not None for n in {x.lower() for x in names if x} if n in t.lower())
    assert sorted((str(x.id), x.name) for x in got) == want
    empty = spark.createDataFrame([], "doc long, body string")
    assert X.contained(empty, spark.createDataFrame([("a",)], "name string"), "doc", "body", "name").count() == 0


def test_no_nested_loop(spark):
    """Many names against texts join on keys: no pair of a name and a text is formed but for a shared trigram."""
    texts = spark.range(200).selectExpr("id as doc", "concat('text number ', id * 7919, ' of many') as body")
    names = spark.range(10_000).selectExpr("concat('number ', id) as name")
    out = X.contained(texts, names, "doc", "body", "name", 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.count() == sum(f"number {n}" in f"text number {i * 7919} of many" for i in range(200) for n in range(10_000))
