import random

import pytest
from pyspark.sql import functions as F

from quarrylens.streaming import stateful as R

from .conftest import SF

CALLS = "event_id long, model string, at long, tokens long, failed boolean"


def test_limiter_counts_only_accepted_tokens():
    limit = R.RateLimit(60, 2, 100)
    assert [limit.step(0, 90), limit.step(1, 20), limit.step(2, 1)] == [True, False, False]  # the refused second call used a place
    assert limit.step(60, 20) is True  # the first request has left the window


def test_limiter_corner_settings():
    assert R.RateLimit(60, 0, 0).step(0, 10**9)
    assert not R.RateLimit(60, 0, 100).step(0, 1)  # no request is ever allowed
    assert R.RateLimit(60, 5, 100).step(0, 100) and not R.RateLimit(60, 5, 100).step(0, 101)


def test_breaker_opens_and_closes():
    b = R.Breaker(30, 3)
    assert [b.step(t, True) for t in (0, 1, 2)] == [True] * 3
    assert not b.step(31, False) and b.step(32, False)
    b = R.Breaker(30, 2)
    b.step(0, True), b.step(1, False), b.step(2, True)
    assert b.step(3, True) and not b.step(4, False)
    b = R.Breaker(30, 2)
    b.step(0, True)
    assert b.step(31, True) and b.step(32, False)  # the first failure's count had expired


@pytest.fixture(scope="module")
def calls(spark):
    r = random.Random(5)
    return spark.createDataFrame([(i, r.choice("abc"), i // 3, r.randrange(50), r.random() < 0.5) for i in range(600)], CALLS)


def test_streams_agree_with_batches(spark, calls, tmp_path):
    for i in range(3):  # time order over the files
        calls.where(f"event_id between {i * 200} and {i * 200 + 199}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    for name, op, batch in (
        ("limit", lambda s: R.stream_rate_limit(s, 60, 5, 120), R.rate_limited(calls, 60, 5, 120)),
        ("breaker", lambda s: R.stream_breaker(s, 30, 3), R.broken_circuits(calls, 30, 3)),
    ):
        q = op(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start(str(tmp_path / name))
        q.awaitTermination(120)
        assert not q.isActive
        got = {tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect()}
        assert got == {tuple(r) for r in batch.collect()} and len(got) == 600


POOL = "pool string, event_id long, at long, tokens long, forced string, high_quality boolean, faults map<string,string>"
MODELS = [("b", 2.0, 100, 5, 300), ("a", 1.0, 50, 3, 120), ("c", 3.0, 0, 0, 0)]  # name, price, context, rpm, tpm


def chosen(spark, rows, models=MODELS, **kw):
    out = R.scheduled(spark.createDataFrame(rows, POOL), models, 60, 30, 2, **kw).collect()
    return {r.event_id: (r.model, r.switched, r.error) for r in out}


def test_scheduler_by_case(spark):
    call = lambda i, at, tokens=1, forced=None, high=False, faults=None, pool="p": (pool, i, at, tokens, forced, high, faults)
    assert chosen(spark, [call(0, 0), call(1, 1, 60), call(2, 2, 999), call(3, 3, forced="b"), call(4, 4, forced="z"), call(5, 5, high=True)], floor=2.5) == {
        0: ("a", 0, ""), 1: ("b", 0, ""), 2: ("c", 0, ""), 3: ("b", 0, ""), 4: (None, 0, "unknown"), 5: ("c", 0, ""),
    }
    every = lambda kind: {m: kind for m in "abc"}
    got = chosen(spark, [call(0, 0, faults=every("retriable")), call(1, 1, faults={"a": "business"}), call(2, 2, faults={"a": "auth"}), call(3, 3), call(4, 62)])
    assert got == {0: (None, 3, "failed"), 1: (None, 0, "rejected"), 2: ("b", 1, ""), 3: ("b", 0, ""), 4: ("a", 0, "")}  # auth opens at once, until its time is over
    assert chosen(spark, [call(0, 0, faults=every("retriable"))], switches=0) == {0: (None, 1, "failed")}
    assert chosen(spark, [call(0, 0)], [("a", 1.0, 0, 0, 10)]) == {0: (None, 0, "failed")} and chosen(spark, [call(0, 0)], []) == {0: (None, 0, "none")}
    assert chosen(spark, [call(i, 0, pool=f"p{i}") for i in range(9)]) == {i: ("a", 0, "") for i in range(9)}  # pools have histories of their own


def history(rows):
    """Another way to the same: everything is counted anew from the list of what happened before."""
    asked, spent, events, out = [], [], [], {}
    cheapest = sorted(MODELS, key=lambda m: m[1])
    for pool, i, at, tokens, forced, high, faults in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        faults = faults or {}
        if forced:
            out[i] = (None, 0, "unknown") if forced not in "abc" else (None, 0, "failed") if forced in faults else (forced, 0, "")
            continue
        names = [m for m in cheapest if (not m[2] or not tokens or m[2] >= tokens) and (not high or m[1] >= 1.5)]
        switched, answer = 0, None
        for name, _, _, rpm, tpm in names:
            if switched > 2 or answer:
                break
            count, until, shut = 0, 0, -1
            for p, m, t, what in events:  # replay of the breaker
                if (p, m) == (pool, name):
                    if what == "auth":
                        shut = t + 30
                        continue
                    count = 0 if t >= until else count
                    if what == "good":
                        count = 0
                    else:
                        until = until if count else t + 30
                        count += 1
                        if count == 2:
                            shut, count = t + 30, 0
            if at < shut:
                continue
            if rpm or tpm:
                if sum((p, m) == (pool, name) and t > at - 60 for p, m, t in asked) >= rpm:
                    continue
                asked.append((pool, name, at))
                if sum(n for p, m, t, n in spent if (p, m) == (pool, name) and t > at - 60) + tokens > tpm:
                    continue
                spent.append((pool, name, at, tokens))
            fault = faults.get(name)
            if fault == "business":
                answer = (None, switched, "rejected")
            elif fault:
                events.append((pool, name, at, fault))
                switched += 1
            else:
                events.append((pool, name, at, "good"))
                answer = (name, switched, "")
        out[i] = answer or (None, switched, "failed" if names else "none")
    return out


def test_scheduler_against_a_replay(spark):
    r = random.Random(12)
    rows = [
        (r.choice("xyz"), i, i // 2, r.choice([0, 1, 20, 60, 200]), r.choice([None] * 9 + ["b", "q"]), r.random() < 0.2, {m: r.choice(["retriable", "retriable", "auth", "business"]) for m in "abc" if r.random() < 0.3} or None)
        for i in range(500)
    ]
    assert chosen(spark, rows, floor=1.5) == history(rows)


def test_auth_opens_the_breaker(spark):
    calls = spark.createDataFrame([(0, "m", 0, 0, True, True), (1, "m", 1, 0, False, False), (2, "m", 31, 0, False, False)], f"{CALLS}, auth boolean")
    assert {r.event_id: r.passed for r in R.broken_circuits(calls, 30, 3).collect()} == {0: True, 1: False, 2: True}


def test_vector_changes_are_applied_in_batches(spark, tmp_path):
    changes = "id long, version long, label string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], changes).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = R.sync_vectors(spark.readStream.schema(changes).parquet(str(tmp_path / "in")), lambda df, n: seen.extend(df.collect()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r.label) for r in seen) == [(1, "b"), (2, "c")]


def test_stream_sessions_end_after_the_gap(spark, tmp_path):
    spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:00:50'), ('a', timestamp'2024-01-01 01:00:00'), ('b', timestamp'2024-01-01 00:00:10') as t(key, ts)").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = R.stream_sessions(s, 60, "0 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert {(r.key, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2), ("b", 1)}


def test_retries(spark):
    m = spark.createDataFrame([("bad", True, 9), ("good", True, 0), ("odd", False, 0)], "type string, handled boolean, failures long")
    assert {tuple(r) for r in R.retries(m).collect()} == {("bad", 4, 3, True), ("good", 1, 0, False)}


def test_stream_triggers_take_each_key_once(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = R.stream_triggers(s, "user_id", "ts", "40 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("user_id").distinct().count()
