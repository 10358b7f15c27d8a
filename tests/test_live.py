import json
import random

import pytest
from pyspark.sql import functions as F

from quarrylens.streaming import live as L
from quarrylens.streaming import stateful as R

SECOND = 1_000_000


@pytest.fixture(scope="module")
def streaming(spark):
    before = spark.conf.get(L.STATE_STORE[0])
    spark.conf.set(*L.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(L.STATE_STORE[0], before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def through_a_stream(spark, tmp_path, rows, schema, machine, parts=3, end=True):
    """All that a machine says of rows that come in several files, out of order by a little, with a stop and a start from the checkpoint in between."""
    rows = sorted(rows, key=lambda x: x[1])
    shuffled = [rows[i : i + 7] for i in range(0, len(rows), 7)]
    r = random.Random(1)
    for block in shuffled:
        r.shuffle(block)
    flat = [x for block in shuffled for x in block]
    size = -(-len(flat) // parts)
    if end:  # a last event far off lets the watermark pass all others
        flat.append((-1, max(x[1] for x in rows) + 10**6 * SECOND, 10**9, *[None] * (len(rows[0]) - 3)))
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for i in range(0, len(flat), size):
        spark.createDataFrame(flat[i : i + size], schema).coalesce(1).write.parquet(f"{source}/{i:05}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        q = machine(stream).writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        q.awaitTermination(240)
        assert q.exception() is None and not q.isActive
    return spark.read.parquet(out).where(f"{schema.split()[0]} <> -1")


TASKS = "task_id long, at long, event_id long, status long"


def test_task_stream_agrees_with_batch_after_restarts(streaming, tmp_path):
    r = random.Random(2)
    rows = [(r.randrange(12), r.randrange(400) * SECOND + 17 * i, i, r.choice([0, 1, 2, 3, 3, 3, 3])) for i in range(150)]
    got = through_a_stream(streaming, tmp_path, rows, TASKS, lambda s: L.stream_tasks(s, 5 * SECOND, 3, "60 seconds")).collect()
    events = streaming.createDataFrame(rows, TASKS)
    calls = {(x.task_id, x["at"], x.kind, x.attempt) for x in L.task_calls(events, 5 * SECOND, 3).collect()}
    assert {(x.task_id, x["at"], x.kind, x.attempt) for x in got if x.kind != "state"} == calls and {k for _, _, k, _ in calls} == {"retry", "terminal"}
    # final states are those of the batch query
    n = lambda s: F.count_if(F.col("status") == s)
    want = events.groupBy("task_id").agg(F.when(n(2) > 0, "success").when(n(3) > 3, "failed").when(n(1) > 0, "running").otherwise("pending").alias("state"), F.max(F.when(F.col("status").isin(2, 3), F.col("at"))).alias("finished"))
    last = {}
    for x in sorted((x for x in got if x.kind != "retry"), key=lambda x: x["at"]):
        last[x.task_id] = (x.state, x.finished)
    assert last == {x.task_id: (x.state, x.finished) for x in want.collect()}
    assert sum(x.kind != "retry" for x in got) == len(rows)


def replayed(rows, delay, most=3):
    """Retries and terminal calls of each task by going through its history second by second."""
    out = set()
    for task in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == task), key=lambda x: (x[1], x[2]))
        failures = 0
        for i, (_, at, _, status) in enumerate(mine):
            if status != 3:
                continue
            failures += 1
            if any(x[3] == 2 for x in mine[:i]):
                continue
            if failures == most + 1:
                out.add((task, at, "terminal", failures))
            later = mine[: i + 1] + [x for x in mine[i + 1 :] if x[1] <= at + delay]
            if failures <= most and not any(x[3] == 2 for x in later) and sum(x[3] == 3 for x in later) <= most:
                out.add((task, at + delay, "retry", failures))
    return out


def test_task_calls_against_a_replay(spark):
    r = random.Random(3)
    rows = [(r.randrange(40), r.randrange(60), i, r.choice([0, 1, 2, 3, 3, 3])) for i in range(400)]
    assert {(x.task_id, x["at"], x.kind, x.attempt) for x in L.task_calls(spark.createDataFrame(rows, TASKS), 9).collect()} == replayed(rows, 9)


SESSIONS = "key long, at long, event_id long, kind string, value string"


def test_lookups_of_live_expired_and_refreshed_sessions(streaming, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(8), r.randrange(600) * SECOND, i, r.choice(["write", "read", "read", "delete"]), f"v{i}") for i in range(160)]
    got = through_a_stream(streaming, tmp_path, rows, SESSIONS, lambda s: L.stream_lookups(s, 60 * SECOND, "120 seconds"))
    want = {tuple(x) for x in L.session_lookups(streaming.createDataFrame(rows, SESSIONS), 60 * SECOND).collect()}
    assert {tuple(x) for x in got.collect()} == want and {x[2] for x in want} == {True, False}
    store, by_hand = {}, set()
    for key, at, i, kind, value in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        if kind == "read":
            found = store.get(key)
            live = found is not None and at < found[0] + 60 * SECOND
            by_hand.add((key, i, live, found[1] if live else None))
        elif kind == "write":
            store[key] = (at, value)
        else:
            store.pop(key, None)
    assert by_hand == want


CHAT = "session long, at long, event_id long, repo long, role string, text string"


def test_chat_turns_agree_with_batch(streaming, tmp_path):
    r = random.Random(5)
    rows = [(i % 5, (100 + i) * SECOND, i, 7 if r.random() < 0.1 else (i % 5) % 3, "assistant" if (i // 5) % 2 else "user", r.choice(["hi", "a longer text of a message", "é\nz", None]) if i % 9 else "x" * 30) for i in range(220)]
    owners = streaming.createDataFrame([(0, 0), (1, 1), (4, 2)], "session long, repo long")  # session 4 belongs to another repository than its messages say
    got = through_a_stream(streaming, tmp_path, rows, CHAT, lambda s: L.stream_chat(s, owners, L.tail_summary(50), 6, 4, "60 seconds")).collect()
    want = {tuple(x) for x in L.chat_memory(streaming.createDataFrame(rows, CHAT), owners, 50, 6, 4).collect()}
    assert len(got) == len(rows)
    last = {}
    for x in sorted(got, key=lambda x: x.event_id):
        refused, state = last.get(x.session, (0, (0, 0, None, "")))
        last[x.session] = (refused + 1, state) if x.refused else (refused, (x.kept, x.rolled, x.title, x.summary))
    assert {(k, refused, *state) for k, (refused, state) in last.items()} == want
    assert all(x.refused for x in got if x.session == 4)
    assert max(x.rolled or 0 for x in got) > 20


def push(i, at, repo, branch="main", after=None):
    body = {"object_kind": "push", "ref": f"refs/heads/{branch}", "before": "0", "after": after or f"c{i}", "project": {"git_http_url": f"https://h/{repo}.git"}}
    return json.dumps({"event_id": i, "at": at * SECOND, "body": json.dumps(body)})


def test_ingest_is_idempotent(spark, tmp_path):
    source, sink, check = (tmp_path / x for x in ("in", "sink", "checkpoint"))
    source.mkdir()
    repos = spark.createDataFrame([(1, "git@h:one.git"), (2, "https://h/two")], "repo_id long, url string")
    run = lambda: L.stream_ingest(spark, str(source), repos, str(sink), str(check)).awaitTermination(120)
    state = lambda: sorted((x.task_id, x.event_id, x.repo_id, x.branch) for x in L.read_tasks(spark, str(sink)).collect())
    (source / "a.json").write_text("\n".join([push(1, 0, "one"), push(2, 1, "one", after="c1"), push(3, 2, "two", "b"), push(4, 3, "none"), push(5, 4, "one", after="0" * 40), '{"event_id":6,"at":7,"body":"{"}']))
    run()
    first = state()
    assert len(first) == 2 and {x[1] for x in first} <= {1, 2, 3} and {x[2:] for x in first} == {(1, "main"), (2, "b")}
    (source / "b.json").write_text("\n".join([push(7, 5, "one", after="c1"), push(8, 6, "two", "b", "c9")]))
    run()
    second = state()
    assert len(second) == 3 and set(first) < set(second)  # event 7 asks for a task that is there
    commits = sorted((int(p.name), p) for p in (check / "commits").iterdir() if p.name.isdigit())
    commits[-1][1].unlink()  # as if the driver had died before it could commit
    (check / "commits" / f".{commits[-1][0]}.crc").unlink(missing_ok=True)
    run()
    assert state() == second


def test_stream_breaker_opens_on_auth(spark, tmp_path):
    schema = "event_id long, model string, at long, tokens long, failed boolean, auth boolean"
    r = random.Random(6)
    calls = spark.createDataFrame([(i, r.choice("ab"), i, 0, r.random() < 0.5, r.random() < 0.3) for i in range(300)], schema)
    for i in range(3):
        calls.where(f"event_id between {i * 100} and {i * 100 + 99}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = R.stream_breaker(stream, 10, 3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert {tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()} == {tuple(x) for x in R.broken_circuits(calls, 10, 3).collect()}
