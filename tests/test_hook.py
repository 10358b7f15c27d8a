import uuid

import pytest

from quarrylens.operators import hook as H
from quarrylens.operators import retrieval as R
from quarrylens.sources.scratch import scratch_path


def counting(folder, fails=0, dies_on=None):
    """A model that notes each call in a folder; its first calls for a text fail, and one text kills the task."""

    def call(texts):
        import os

        if dies_on in texts:
            raise OSError("the model's machine is gone")
        for t in texts:
            tried = [x for x in os.listdir(folder) if x.startswith(f"{t}-")]
            if len(tried) < fails:
                for x in texts:
                    open(f"{folder}/{x}-{uuid.uuid4().hex}", "w").close()
                raise H.Retriable()
        for t in texts:
            open(f"{folder}/{t}+{uuid.uuid4().hex}", "w").close()
        return [t.upper() for t in texts]

    return call


def calls_of(folder, mark="+"):
    out = {}
    for p in folder.iterdir():
        if mark in p.name:
            out[p.name.split(mark)[0]] = out.get(p.name.split(mark)[0], 0) + 1
    return out


ROWS = "id long, text string"


def test_each_text_is_asked_about_once(spark, tmp_path):
    folder, store = tmp_path / "calls", scratch_path(spark, "store-test")
    folder.mkdir()
    names = [f"t{i}" for i in range(30)]
    rows = [(i, names[0] if i % 3 == 0 else names[i % 30]) for i in range(120)] + [(500, None)]  # one text holds a third of the rows
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    run = lambda d, version="1", **kw: {r.id: r.answer for r in H.call_once(d, "text", counting(str(folder), **kw), store, version, batch=4).collect()}
    want = {i: t and t.upper() for i, t in rows}
    assert run(df) == want and set(calls_of(folder).values()) == {1}
    assert run(df) == want and set(calls_of(folder).values()) == {1}  # nothing is asked again
    more = spark.createDataFrame([(1, "t1"), (2, "new")], ROWS)
    assert run(more) == {1: "T1", 2: "NEW"} and calls_of(folder)["new"] == 1 and calls_of(folder)["t1"] == 1
    assert run(more, "2")[1] == "T1" and calls_of(folder)["t1"] == 2  # another version of the model


def test_finished_rounds_outlive_a_failure(spark, tmp_path):
    folder, store = tmp_path / "calls", scratch_path(spark, "store-test")
    folder.mkdir()
    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], ROWS)
    with pytest.raises(Exception, match="machine is gone"):
        H.call_once(df, "text", counting(str(folder), dies_on="t7"), store, "1", batch=1, rounds=8)
    kept = {r.answer.lower() for r in H.read_store(spark, store, "1").collect()}
    before = calls_of(folder)
    got = H.call_once(df, "text", counting(str(folder)), store, "1", batch=1, rounds=8).collect()
    after = calls_of(folder)
    assert {r.text: r.answer for r in got} == {f"t{i}": f"T{i}" for i in range(40)}
    assert all(after[t] == before[t] for t in kept)  # what was kept is not asked again


def test_waits_and_last_attempt(spark, tmp_path):
    assert H.waits(6) == [1, 2, 4, 8, 10]
    folder, slept = tmp_path / "calls", []
    folder.mkdir()
    assert H.answered(counting(str(folder), fails=2), ["a"], 4, slept.append) == ["A"] and slept == [1, 2]
    assert H.answered(counting(str(folder), fails=9), ["b", "c"], 3, slept.append) == [None, None]
    with pytest.raises(ValueError):
        H.answered(lambda texts: [], ["a"], 2, slept.append)
    quiet = lambda seconds: None
    out = H.call_once(spark.createDataFrame([(1, "d")], ROWS), "text", counting(str(folder), fails=9), scratch_path(spark, "store-test"), "1", attempts=2, sleep=quiet)
    assert out.first().answer is None and H.call_once(spark.createDataFrame([], ROWS), "text", counting(str(folder)), scratch_path(spark, "store-test"), "1").count() == 0


def test_fallback_answers(spark):
    requests = spark.createDataFrame([("a",), ("b",)], "request string")
    recalled = spark.createDataFrame([("a", 1, "m", 5, "f", "F", "x" * 120), ("a", 0, " ", 4, "f", "G", None), ("z", 0, "n", 1, "f", "H", "")], "request string, pos int, module_name string, id long, file_path string, func_name string, summary string")
    got = {r.request: r for r in R.fallback(requests, recalled).collect()}
    assert set(got) == {"a", "b"} and got["a"].related_modules == ["m"] and [f.id for f in got["a"].related_functions] == [4, 5] and got["a"].related_functions[1].summary == "x" * 100 + "..."
    assert not got["a"].knowledge_missing and got["b"].knowledge_missing and got["b"].related_functions == got["b"].risk_points == [] and got["a"].analysis != got["b"].analysis
