"""Stateful operators: rate limit, circuit breaker, retry, sessions.

The rules are folds over one key's events in time order: plain classes with ``step``.  The
batch operators run a fold over each key's sorted events; the streaming operators keep the
same object's state in ``applyInPandasWithState``, one micro-batch at a time, so both agree.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class RateLimit:
    """Sliding-window limit on requests and tokens.  Only what is let through fills the token window, but a request refused for its tokens has used a place."""

    def __init__(self, window: int, rpm: int, tpm: int, state: tuple | None = None):
        self.window, self.rpm, self.tpm = window, rpm, tpm
        requests, tokens = state or ((), ())
        self.requests, self.tokens = deque(requests), deque(tokens)
        self.used = sum(n for _, n in self.tokens)

    def step(self, at: int, tokens: int) -> bool:
        if self.rpm <= 0 and self.tpm <= 0:
            return True
        while self.requests and self.requests[0] <= at - self.window:
            self.requests.popleft()
        if len(self.requests) >= self.rpm:
            return False
        self.requests.append(at)
        while self.tokens and self.tokens[0][0] <= at - self.window:
            self.used -= self.tokens.popleft()[1]
        if self.used + tokens > self.tpm:
            return False
        self.tokens.append((at, tokens))
        self.used += tokens
        return True

    def state(self) -> tuple:
        return list(self.requests), [list(x) for x in self.tokens]


class Breaker:
    """Opens for ttl seconds after threshold failures within ttl of the first; a success clears the count; nothing is half open."""

    def __init__(self, ttl: int, threshold: int, state: tuple | None = None):
        self.ttl, self.threshold = max(ttl, 1), max(threshold, 1)
        self.count, self.count_until, self.open_until = state or (0, 0, 0)

    def is_open(self, at: int) -> bool:
        return at < self.open_until

    def open(self, at: int) -> None:
        """Open at once, as after an error that no repetition mends."""
        self.open_until = at + self.ttl

    def step(self, at: int, failed: bool) -> bool:
        """Was the call let through?  Its outcome counts only if so."""
        if self.is_open(at):
            return False
        if at >= self.count_until:
            self.count = 0
        if not failed:
            self.count = 0
        else:
            if not self.count:
                self.count_until = at + self.ttl
            self.count += 1
            if self.count >= self.threshold:
                self.open_until, self.count = at + self.ttl, 0
        return True

    def state(self) -> tuple:
        return self.count, self.count_until, self.open_until


def rate_limited(calls: DataFrame, window: int, rpm: int, tpm: int) -> DataFrame:
    """calls (event_id, model, at, tokens) with allowed.

    A model's calls are one ordered history: the fold needs them in order, in pieces that
    Spark sorts and hands over batch by batch, so no model is held in memory whole.
    """
    ordered = calls.select("model", "at", "event_id", "tokens").repartition("model").sortWithinPartitions("model", "at", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, limit = None, None
        for frame in frames:
            allowed = []
            for m, at, tokens in zip(frame["model"], frame["at"], frame["tokens"]):
                if limit is None or m != model:
                    model, limit = m, RateLimit(window, rpm, tpm)
                allowed.append(limit.step(int(at), int(tokens)))
            yield frame[["event_id", "model"]].assign(allowed=allowed)

    return ordered.mapInPandas(run, "event_id long, model string, allowed boolean")


def broken_circuits(calls: DataFrame, ttl: int, threshold: int) -> DataFrame:
    """calls (event_id, model, at, failed, and auth if some failures are of that kind) with passed: false while the model's circuit is open."""
    ordered = calls.select("model", "at", "event_id", "failed", F.col("auth") if "auth" in calls.columns else F.lit(False).alias("auth")).repartition("model").sortWithinPartitions("model", "at", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, breaker = None, None
        for frame in frames:
            passed = []
            for m, at, failed, auth in zip(frame["model"], frame["at"], frame["failed"], frame["auth"]):
                if breaker is None or m != model:
                    model, breaker = m, Breaker(ttl, threshold)
                passed.append(breaker.step(int(at), bool(failed) and not auth))
                if passed[-1] and failed and auth:
                    breaker.open(int(at))
            yield frame[["event_id", "model"]].assign(passed=passed)

    return ordered.mapInPandas(run, "event_id long, model string, passed boolean")


def scheduled(
    calls: DataFrame,
    models: list[tuple[str, float, int, int, int]],
    window: int,
    ttl: int,
    threshold: int,
    switches: int = 2,
    floor: float = 0.0,
) -> DataFrame:
    """What answers each call: event_id, model, switched (attempts that failed before it), error.

    calls: pool, event_id, at, tokens, forced (a model's name or null), high_quality, and faults, a
    map of models to the error that they give this call (retriable, auth or business).
    models: name, average price, context, rpm and tpm of those enabled.

    A forced model is called alone, whatever its state.  Otherwise models whose context fits (and
    whose price reaches ``floor``, for calls of high quality) are tried from the cheapest; one
    that is open or limited is passed over; a retriable error counts for the breaker, an auth
    error opens it at once, and both cost a switch, of which there are ``switches``; a business
    error ends the call.  error: '', unknown (forced model), none (no candidate), rejected
    (business), or failed (nothing left to try).

    Calls of one pool depend on those before them: each pool is an ordered history of its own,
    sorted by Spark and read in pieces.
    """
    cheapest = sorted(models, key=lambda m: m[1])
    ordered = calls.select("pool", "at", "event_id", "tokens", "forced", "high_quality", F.map_entries("faults").alias("faults")).repartition("pool").sortWithinPartitions("pool", "at", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, state = None, {}
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if not state or row.pool != pool:
                    pool, state = row.pool, {m[0]: (RateLimit(window, m[3], m[4]), Breaker(ttl, threshold)) for m in cheapest}
                out.append((row.event_id, *_scheduled(row, cheapest, state, switches, floor)))
            yield pd.DataFrame(out, columns=["event_id", "model", "switched", "error"])

    return ordered.mapInPandas(run, "event_id long, model string, switched int, error string")


def _scheduled(call, models: list[tuple], state: dict, switches: int, floor: float) -> tuple[str | None, int, str]:
    faults = {x["key"]: x["value"] for x in call.faults} if call.faults is not None else {}
    if call.forced:
        if call.forced not in state:
            return None, 0, "unknown"
        return (None, 0, "failed") if call.forced in faults else (call.forced, 0, "")
    tokens, at, switched = int(call.tokens), int(call.at), 0
    fitting = [m[0] for m in models if not (tokens > 0 and 0 < m[2] < tokens) and not (call.high_quality and m[1] < floor)]
    for name in fitting:
        limit, breaker = state[name]
        if switched > switches:
            break
        if breaker.is_open(at) or not limit.step(at, tokens):
            continue
        fault = faults.get(name)
        if fault == "business":
            return None, switched, "rejected"
        if fault == "auth":
            breaker.open(at)
        else:
            breaker.step(at, fault is not None)
        if fault is None:
            return name, switched, ""
        switched += 1
    return None, switched, "failed" if fitting else "none"


def dispatched(messages: DataFrame, handlers: dict[str, str]) -> DataFrame:
    """Messages of known types, with the handler that takes them; unknown types are dropped."""
    known = F.create_map(*(F.lit(x) for kv in handlers.items() for x in kv))
    return messages.withColumn("handler", F.try_element_at(known, F.col("type"))).where("handler is not null")


def sync_vectors(changes: DataFrame, apply, checkpoint: str):
    """Start a stream that hands each micro-batch of vector changes (id, version, ...) to apply, the last version of each id once.

    A batch that is repeated after a failure brings the same rows, so apply must be an upsert.
    """
    def each(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), "version").alias("row")).select("row.*")
        apply(last, number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def stream_sessions(events: DataFrame, gap_seconds: int, late: str) -> DataFrame:
    """Sessions of each key that end after a gap, on a stream: key, start, end, n; the state of a session is dropped once it has ended."""
    w = F.session_window("ts", f"{gap_seconds} seconds")
    closed = events.withWatermark("ts", late).groupBy("key", w.alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return closed.select("key", "start", "end", "n")


def stream_rate_limit(calls: DataFrame, window: int, rpm: int, tpm: int) -> DataFrame:
    """rate_limited on a stream: state holds the window's requests and tokens."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        requests, at, tokens = state.get if state.exists else ([], [], [])
        limit = RateLimit(window, rpm, tpm, (requests, list(zip(at, tokens))))
        events = pd.concat(list(frames)).sort_values(["at", "event_id"])
        allowed = [limit.step(int(a), int(n)) for a, n in zip(events["at"], events["tokens"])]
        state.update((list(limit.requests), [x[0] for x in limit.tokens], [x[1] for x in limit.tokens]))
        yield events[["event_id", "model"]].assign(allowed=allowed)

    return calls.groupBy("model").applyInPandasWithState(
        run, "event_id long, model string, allowed boolean", "requests array<long>, at array<long>, tokens array<long>", "append", GroupStateTimeout.NoTimeout
    )


def stream_breaker(calls: DataFrame, ttl: int, threshold: int) -> DataFrame:
    """broken_circuits on a stream."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(ttl, threshold, state.get if state.exists else None)
        events = pd.concat(list(frames)).sort_values(["at", "event_id"])
        passed = []
        for at, failed, auth in zip(events["at"], events["failed"], events["auth"]):
            passed.append(breaker.step(int(at), bool(failed) and not auth))
            if passed[-1] and failed and auth:
                breaker.open(int(at))
        state.update(breaker.state())
        yield events[["event_id", "model"]].assign(passed=passed)

    if "auth" not in calls.columns:
        calls = calls.withColumn("auth", F.lit(False))
    return calls.groupBy("model").applyInPandasWithState(run, "event_id long, model string, passed boolean", "n long, until long, open_until long", "append", GroupStateTimeout.NoTimeout)


def retries(messages: DataFrame, most: int = 3) -> DataFrame:
    """What becomes of messages (type, handled, failures): runs, retries and a terminal call; unknown types are dropped."""
    known = messages.where("handled")
    runs = F.least(F.col("failures") + 1, F.lit(most + 1))
    return known.select("type", runs.alias("runs"), F.least("failures", F.lit(most)).alias("retries"), (F.col("failures") > most).alias("terminal"))


def stream_triggers(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
