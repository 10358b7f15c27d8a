"""Live state machines: task lifecycle, session store, chat turns, webhook ingest.

Each machine is a fold over one key's events in the order of (at, event_id).  On a stream,
events wait in a map of their times until the watermark has passed them, so a stream whose
events come out of order within its delay, in any micro-batches, and across restarts, gives what
the batch form of the same rule gives.  Deadlines (a retry, the end of a kept state) are events
of the machine's own, at their time.  A key's state is small: nothing of its past events but
what the rule needs, and it is dropped ``keep_us`` after the last event where that is set.

Streams need the RocksDB state store (``STATE_STORE``), which transformWithState relies on.
Times are microseconds; an event later than the watermark is dropped by Spark.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylens.functions import scalars as S
from quarrylens.operators.sessions import KEEP, TITLE, TRIGGER

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: (state or None, event) -> (state or None, rows, deadlines).  An event is a dict with at and
#: event_id; a deadline is a dict with at, and comes back as an event without event_id.
Step = Callable[[dict | None, dict], tuple[dict | None, list[tuple], list[dict]]]


class InOrder(StatefulProcessor):
    """Hands a key's events to a step in the order of (at, event_id), once the watermark has passed them."""

    def __init__(self, step: Step, columns: list[str], out: list[str], keep_us: int | None = None):
        self.step, self.columns, self.out, self.keep_us = step, columns, out, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.pushed = handle, 0
        self.waiting = handle.getMapState("waiting", "ms long", "events string")
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            by_time: dict[int, list[dict]] = {}
            for values in frame[self.columns].astype(object).itertuples(index=False):
                event = {c: None if pd.isna(v) else v.item() if hasattr(v, "item") else v for c, v in zip(self.columns, values)}
                by_time.setdefault(-(-event["at"] // 1000), []).append(event)
            for ms, events in by_time.items():
                self._wait(ms, events)
        yield self._rows(key, [])

    def _wait(self, ms: int, events: list[dict]) -> None:
        held = json.loads(self.waiting.getValue((ms,))[0]) if self.waiting.containsKey((ms,)) else []
        self.waiting.updateValue((ms,), (json.dumps(held + events),))
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.containsKey((expiredTimerInfo.getExpiryTimeInMs(),)):
            return  # its events went with those of an earlier timer
        passed = timerValues.getCurrentWatermarkInMs()
        queue: list[tuple] = []
        for ms in [k[0] for k in self.waiting.keys() if k[0] <= passed]:
            for event in json.loads(self.waiting.getValue((ms,))[0]):
                heapq.heappush(queue, self._ranked(event))
            self.waiting.removeKey((ms,))
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        out: list[tuple] = []
        while queue:
            event = heapq.heappop(queue)[-1]
            if event.get("forget"):
                if state is not None and state["last"] + self.keep_us <= event["at"]:
                    state = None
                continue
            state, rows, deadlines = self.step(state, event)
            out += rows
            if state is not None and "event_id" in event:
                state["last"] = event["at"]
                if self.keep_us is not None:
                    deadlines = [*deadlines, {"at": event["at"] + self.keep_us, "forget": True}]
            for deadline in deadlines:
                if (due := -(-deadline["at"] // 1000)) <= passed:
                    heapq.heappush(queue, self._ranked(deadline))
                else:
                    self._wait(due, [deadline])
        if state is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
        yield self._rows(key, out)

    def _ranked(self, event: dict) -> tuple:
        """Events by time and id; a deadline comes after what happens at its time."""
        self.pushed += 1
        return event["at"], "event_id" not in event, event.get("event_id", 0), self.pushed, event

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *row) for row in rows], columns=self.out, dtype=object)

    def close(self) -> None:
        pass


def run_in_order(events: DataFrame, key: str, columns: list[str], step: Step, schema: str, late: str, keep_us: int | None = None) -> DataFrame:
    """A machine on a stream of events (key, at in microseconds, event_id, the columns); the key leads the rows of the schema."""
    spark = events.sparkSession
    if spark.conf.get(STATE_STORE[0]) != STATE_STORE[1]:
        raise ValueError(f"set {STATE_STORE[0]} to {STATE_STORE[1]}")
    names = [f.split()[0] for f in schema.split(", ")]
    timed = events.select(key, "at", "event_id", *columns, F.timestamp_micros("at").alias("time_")).withWatermark("time_", late)
    return timed.groupBy(key).transformWithStateInPandas(InOrder(step, ["at", "event_id", *columns], names, keep_us), schema, "append", "eventTime")


# Tasks: pending, running, success, failed after more than ``most`` failures.

TASK_OUT = "task_id long, at long, kind string, attempt long, state string, finished long"


def task_step(delay_us: int, most: int) -> Step:
    def step(state: dict | None, event: dict) -> tuple[dict, list[tuple], list[dict]]:
        s = state or {"ran": False, "won": False, "failures": 0, "finished": None}
        at = event["at"]
        if "retry" in event:
            due = not s["won"] and s["failures"] <= most
            return s, [(at, "retry", event["retry"], _task_state(s, most), s["finished"])] * due, []
        deadlines, kind, attempt = [], "state", s["failures"]
        if event["status"] == 1:
            s["ran"] = True
        elif event["status"] == 2:
            s["won"] = True
        elif event["status"] == 3:
            s["failures"] += 1
            attempt = s["failures"]
            if attempt <= most:
                deadlines = [{"at": at + delay_us, "retry": attempt}] * (not s["won"])
            elif attempt == most + 1 and not s["won"]:
                kind = "terminal"
        if event["status"] in (2, 3):
            s["finished"] = max(s["finished"] or at, at)
        return s, [(at, kind, attempt, _task_state(s, most), s["finished"])], deadlines

    return step


def _task_state(s: dict, most: int) -> str:
    return "success" if s["won"] else "failed" if s["failures"] > most else "running" if s["ran"] else "pending"


def stream_tasks(events: DataFrame, delay_us: int, most: int = 3, late: str = "0 seconds", keep_us: int | None = None) -> DataFrame:
    """Of task events (task_id, at, event_id, status): the state after each, a retry ``delay_us`` after each of ``most`` failures unless the task is over, one terminal row."""
    return run_in_order(events, "task_id", ["status"], task_step(delay_us, most), TASK_OUT, late, keep_us)


def task_calls(events: DataFrame, delay_us: int, most: int = 3) -> DataFrame:
    """The retries and terminal calls of stream_tasks, as a batch: task_id, at, kind, attempt."""
    order = Window.partitionBy("task_id").orderBy("at", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    failed, won = F.col("status") == 3, F.col("status") == 2
    numbered = events.withColumn("attempt", F.count_if(failed).over(so_far)).withColumn("over", F.count_if(won).over(so_far) > 0)
    ends = numbered.groupBy("task_id").agg(F.min(F.when(won, F.col("at"))).alias("won_at"), F.min(F.when(failed & (F.col("attempt") == most + 1), F.col("at"))).alias("lost_at"))
    due = F.col("at") + delay_us
    # what happens at the time of a retry comes before it
    idle = (F.coalesce("won_at", due + 1) > due) & (F.coalesce("lost_at", due + 1) > due)
    failures = numbered.where(failed & ~F.col("over")).join(ends.hint("merge"), "task_id")
    retry = failures.where((F.col("attempt") <= most) & idle).select("task_id", due.alias("at"), F.lit("retry").alias("kind"), "attempt")
    return retry.union(failures.where(F.col("attempt") == most + 1).select("task_id", "at", F.lit("terminal"), "attempt"))


# Sessions: a value that lives for a time after each write.

LOOKUP_OUT = "key long, event_id long, live boolean, value string"


def session_step(ttl_us: int) -> Step:
    def step(state: dict | None, event: dict) -> tuple[dict | None, list[tuple], list[dict]]:
        live = state is not None and event["at"] < state["until"]
        if event["kind"] == "read":  # finds, or evicts
            return (state if live else None), [(event["event_id"], live, state["value"] if live else None)], []
        if event["kind"] == "delete":
            return None, [], []
        return {"value": event["value"], "until": event["at"] + ttl_us}, [], []

    return step


def stream_lookups(events: DataFrame, ttl_us: int, late: str = "0 seconds") -> DataFrame:
    """Of session events (key, at, event_id, kind write, read or delete, value): what each read finds.  A write lives for ttl_us; state of dead sessions is dropped at their end."""
    return run_in_order(events, "key", ["kind", "value"], session_step(ttl_us), LOOKUP_OUT, late, ttl_us)


def session_lookups(events: DataFrame, ttl_us: int) -> DataFrame:
    """stream_lookups as a batch."""
    before = Window.partitionBy("key").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") != "read", F.struct("kind", "at", "value")), ignorenulls=True).over(before)
    found = events.withColumn("last", last).where("kind = 'read'")
    live = F.coalesce((F.col("last.kind") == "write") & (F.col("at") < F.col("last.at") + ttl_us), F.lit(False))
    return found.select("key", "event_id", live.alias("live"), F.when(live, F.col("last.value")).alias("value"))


# Chats: messages of a session, rolled up into a summary.

CHAT_OUT = "session long, event_id long, refused boolean, kept long, rolled long, title string, summary string"


def chat_step(trigger: int, keep: int, summarize: Callable[[str, str], str]) -> Step:
    def step(state: dict | None, event: dict) -> tuple[dict, list[tuple], list[dict]]:
        owner = event["owner"] if event["owner"] is not None else state["repo"] if state else None
        if owner is not None and owner != event["repo"]:
            return state, [(event["event_id"], True, None, None, None, None)], []
        s = state or {"repo": event["repo"], "title": None, "summary": "", "rolled": 0, "messages": []}
        role, text = event["role"], event["text"] or ""
        if s["title"] is None and role == "user":
            s["title"] = text if len(text) <= TITLE else text[:TITLE] + "..."
        s["messages"].append([role, text])
        if role == "assistant" and len(s["messages"]) > trigger:  # a turn is over
            gone, s["messages"] = s["messages"][:-keep], s["messages"][-keep:]
            summary = summarize(s["summary"], "".join(f"{a}: {b}\n" for a, b in gone))
            s["summary"], s["rolled"] = summary or s["summary"], s["rolled"] + len(gone)
        return s, [(event["event_id"], False, len(s["messages"]), s["rolled"], s["title"], s["summary"])], []

    return step


def stream_chat(messages: DataFrame, owners: DataFrame, summarize: Callable[[str, str], str], trigger: int = TRIGGER, keep: int = KEEP, late: str = "0 seconds", keep_us: int | None = None) -> DataFrame:
    """Of chat messages (session, at, event_id, repo, role, text): the session after each, or that it was refused.

    owners: session and repo of the sessions that exist, joined as a static table; a session that
    is new belongs to the repository of its first message.  A message from another repository is
    refused.  After an assistant's message a session of over ``trigger`` messages keeps the last
    ``keep``, and summarize makes a summary of the old one and the rest; an empty one is no change.
    """
    owned = messages.join(owners.select("session", F.col("repo").alias("owner")), "session", "left")
    return run_in_order(owned, "session", ["repo", "owner", "role", "text"], chat_step(trigger, keep, summarize), CHAT_OUT, late, keep_us)


def tail_summary(most: int) -> Callable[[str, str], str]:
    """A summarizer that keeps the last ``most`` characters: it stands in for a model in tests and in the batch form."""
    return lambda old, said: (old + said)[-most:]


def chat_memory(messages: DataFrame, owners: DataFrame, most: int, trigger: int = TRIGGER, keep: int = KEEP) -> DataFrame:
    """Sessions as stream_chat leaves them with tail_summary(most), as a batch: session, refused, kept, rolled, title, summary.

    Messages count from 1 in order.  A roll-up takes all but keep of those of finished turns, so
    how many are gone follows from where assistants' messages stand.
    """
    owned = messages.join(owners.select("session", F.col("repo").alias("owner")), "session", "left")
    first = owned.groupBy("session").agg(F.min_by("repo", F.struct("at", "event_id")).alias("first_repo"))
    owned = owned.join(first, "session").withColumn("refused", F.col("repo") != F.coalesce("owner", "first_repo"))
    order = Window.partitionBy("session").orderBy("at", "event_id")
    good = owned.where("not refused").withColumn("nth", F.row_number().over(order))
    facts = good.groupBy("session").agg(F.max("nth").alias("n"), F.min_by("text", F.when(F.col("role") == "user", F.col("nth"))).alias("asked"))
    facts = facts.join(_rolled(good, trigger, keep).hint("merge"), "session", "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    # a message takes three characters at least, so the end of what is gone lies in its last few messages
    told = good.select("session", "nth", "role", "text").join(facts.select("session", "gone"), "session").where("nth <= gone and nth > gone - %d" % (most // 3 + 1))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "role", "text"))), lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["text"], F.lit("")), F.lit("\n"))), "")
    summary = told.groupBy("session").agg(F.right(said, F.lit(most)).alias("summary"))
    refused = owned.groupBy("session").agg(F.count_if("refused").alias("refused"))
    out = refused.join(facts, "session", "left").join(summary, "session", "left")
    return out.select(
        "session", "refused", F.coalesce(F.col("n") - F.col("gone"), F.lit(0)).cast("long").alias("kept"), F.coalesce("gone", F.lit(0)).cast("long").alias("rolled"),
        S.truncate(F.col("asked"), TITLE).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"),
    )


def _rolled(messages: DataFrame, trigger: int, keep: int) -> DataFrame:
    """session and gone, how many of its messages the roll-ups have taken: a fold over sorted numbers that holds one at a time."""
    ends = messages.where("role = 'assistant'").select("session", "nth").repartition("session").sortWithinPartitions("session", "nth")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, gone = None, 0
        for frame in frames:
            out = []
            for s, nth in zip(frame["session"], frame["nth"]):
                if s != session:
                    if gone:
                        out.append((session, gone))
                    session, gone = s, 0
                if nth - gone > trigger:
                    gone = nth - keep
            yield pd.DataFrame(out, columns=["session", "gone"])
        if gone:
            yield pd.DataFrame([(session, gone)], columns=["session", "gone"])

    return ends.mapInPandas(run, "session long, gone long")


# Webhooks: payload files in, task rows out.

PUSH_FILE = "event_id long, at long, body string"


def push_tasks(pushes: DataFrame, repos: DataFrame) -> DataFrame:
    """task_id, event_id, at, repo_id and branch of the pushes (event_id, at, body) that ask for a task: branches of registered repositories (repo_id, url) that are not deleted."""
    told = pushes.select("event_id", "at", S.push_event(F.col("body")).alias("e")).where("e.error = '' and not e.tag and not e.deleted")
    keyed = told.withColumn("key", S.normalize_url(F.col("e.repo_url"))).join(repos.select("repo_id", S.normalize_url(F.col("url")).alias("key")), "key")
    return keyed.select(S.webhook_task_id(F.col("e.repo_url"), F.col("e.branch"), F.col("e.after")).alias("task_id"), "event_id", "at", "repo_id", F.col("e.branch").alias("branch"))


def stream_ingest(spark, folder: str, repos: DataFrame, sink: str, checkpoint: str, late: str = "1 hour", files: int | None = None):
    """Start a stream from JSON files of pushes to a table of tasks, each task id once within the watermark.

    A micro-batch writes its own partition of the sink and replaces it whole: one that is
    repeated after a failure leaves the rows it left before.
    """
    source = spark.readStream.schema(PUSH_FILE).option("maxFilesPerTrigger", files or 1000).json(folder)
    tasks = push_tasks(source, repos).withColumn("time_", F.timestamp_micros("at")).withWatermark("time_", late).dropDuplicatesWithinWatermark(["task_id"]).drop("time_")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return tasks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_tasks(spark, sink: str) -> DataFrame:
    """The tasks that streams have written."""
    return spark.read.schema("task_id string, event_id long, at long, repo_id long, branch string, batch long").parquet(sink).drop("batch")
