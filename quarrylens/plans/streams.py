"""Queues, limits, breakers, sessions and ingest, as batches over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import scalars as S
from quarrylens.operators import sessions as C
from quarrylens.plans.registry import query
from quarrylens.plans.windows import _TEN, _sessions
from quarrylens.sources.adapters import MODELS
from quarrylens.streaming import live as V
from quarrylens.streaming import stateful as R


@query("sm04_retry", "WITH $tasks, f AS (SELECT task_id, count(*) FILTER (status = 3) AS failures FROM tasks GROUP BY task_id) SELECT CAST(task_id AS VARCHAR) AS type, least(failures + 1, 4) AS runs, least(failures, 3) AS retries, failures > 3 AS terminal FROM f")
def _(t):
    f = t.tasks.groupBy("task_id").agg(F.count_if(F.col("status") == 3).alias("failures"))
    return R.retries(f.select(F.col("task_id").cast("string").alias("type"), F.lit(True).alias("handled"), "failures"))


@query("sm06_task_state", "WITH $tasks SELECT task_id, CASE WHEN count(*) FILTER (status = 2) > 0 THEN 'success' WHEN count(*) FILTER (status = 3) > 3 THEN 'failed' WHEN count(*) FILTER (status = 1) > 0 THEN 'running' ELSE 'pending' END AS state, max(us) FILTER (status IN (2, 3)) AS finished FROM tasks GROUP BY task_id")
def _(t):
    n = lambda s: F.count_if(F.col("status") == s)
    state = F.when(n(2) > 0, "success").when(n(3) > 3, "failed").when(n(1) > 0, "running").otherwise("pending")
    return t.tasks.groupBy("task_id").agg(state.alias("state"), F.max(F.when(F.col("status").isin(2, 3), F.col("us"))).alias("finished"))


_HOUR = 3_600_000_000


@query("sm06_task_calls", f"""WITH $tasks, n AS (SELECT task_id, us, event_id, status, count(*) FILTER (status = 3) OVER w AS attempt, count(*) FILTER (status = 2) OVER w > 0 AS done FROM tasks WINDOW w AS (PARTITION BY task_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT task_id, min(us) FILTER (status = 2) AS won, min(us) FILTER (status = 3 AND attempt = 4) AS lost FROM n GROUP BY task_id),
f AS (SELECT n.*, us + {_HOUR} AS due, won, lost FROM n JOIN e USING (task_id) WHERE status = 3 AND NOT done)
SELECT task_id, due AS "at", 'retry' AS kind, attempt FROM f WHERE attempt <= 3 AND coalesce(won, due + 1) > due AND coalesce(lost, due + 1) > due UNION ALL SELECT task_id, us, 'terminal', attempt FROM f WHERE attempt = 4""")
def _(t):
    """Retries and terminal calls of tasks; streaming.live.stream_tasks says the same of a stream."""
    return V.task_calls(t.tasks.select("task_id", F.col("us").alias("at"), "event_id", "status"), _HOUR)


@query("sm13_session_lookups", f"""WITH $tasks, k AS (SELECT task_id AS key, us, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' WHEN event_type = 'error' THEN 'delete' ELSE 'read' END AS kind, event_type || event_id AS value FROM tasks),
l AS (SELECT *, last_value(CASE WHEN kind <> 'read' THEN {{'kind': kind, 'us': us, 'value': value}} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM k),
r AS (SELECT key, event_id, coalesce(p.kind = 'write' AND us < p.us + 24 * {_HOUR}, false) AS live, p FROM l WHERE kind = 'read') SELECT key, event_id, live, CASE WHEN live THEN p.value END AS value FROM r""")
def _(t):
    """What reads of a session store find, whose entries live for a day after a write; streaming.live.stream_lookups says the same of a stream."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "write").when(F.col("event_type") == "error", "delete").otherwise("read")
    events = t.tasks.select(F.col("task_id").alias("key"), F.col("us").alias("at"), "event_id", kind.alias("kind"), F.concat("event_type", F.col("event_id").cast("string")).alias("value"))
    return V.session_lookups(events, 24 * _HOUR)


@query("sm15_chat_memory", """WITH $chat, m AS (SELECT conv_id AS session, turn, role, text, CASE WHEN turn % 7 = 6 THEN 9 ELSE conv_id % 5 END AS repo, CASE WHEN conv_id % 11 = 0 THEN 99 WHEN conv_id % 3 = 0 THEN conv_id % 5 END AS owner FROM chat),
o AS (SELECT *, repo <> coalesce(owner, first_value(repo) OVER (PARTITION BY session ORDER BY turn)) AS refused FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) AS nth FROM o WHERE NOT refused),
f AS (SELECT session, max(nth) AS n, first(text ORDER BY nth) FILTER (role = 'user') AS asked, list_reduce(list_prepend(CAST(0 AS BIGINT), coalesce(list(nth ORDER BY nth) FILTER (role = 'assistant'), [])), lambda a, b: CASE WHEN b - a > 4 THEN b - 2 ELSE a END) AS gone FROM g GROUP BY session),
s AS (SELECT session, right(string_agg(role || ': ' || text || chr(10), '' ORDER BY nth), 80) AS summary FROM g JOIN f USING (session) WHERE nth <= gone GROUP BY session)
SELECT session, count(*) FILTER (refused) AS refused, coalesce(any_value(n - gone), 0) AS kept, coalesce(any_value(gone), 0) AS rolled, any_value(CASE WHEN length(asked) > 20 THEN left(asked, 20) || '...' ELSE asked END) AS title, coalesce(any_value(summary), '') AS summary
FROM o LEFT JOIN f USING (session) LEFT JOIN s USING (session) GROUP BY session""")
def _(t):
    """Messages, summary and title of sessions, those of other repositories refused; streaming.live.stream_chat says the same of a stream."""
    repo = F.when(F.col("turn") % 7 == 6, 9).otherwise(F.col("conv_id") % 5).cast("long")
    messages = t.chat.select(F.col("conv_id").alias("session"), F.col("turn").alias("at"), F.col("turn").alias("event_id"), repo.alias("repo"), "role", "text")
    own = F.when(F.col("conv_id") % 11 == 0, 99).when(F.col("conv_id") % 3 == 0, F.col("conv_id") % 5).cast("long")
    owners = t.chat.select(F.col("conv_id").alias("session"), own.alias("repo")).where("repo is not null").distinct()
    return V.chat_memory(messages, owners, 80, trigger=4, keep=2)


@query("sm07_dedupe_trigger", "WITH $tasks SELECT task_id, min(event_id) AS event_id, count(*) - 1 AS returned_existing FROM tasks GROUP BY task_id")
def _(t):
    return t.tasks.groupBy("task_id").agg(F.min("event_id").alias("event_id"), (F.count("*") - 1).alias("returned_existing"))


@query("sm09_rate_limit")
def _(t):
    return R.rate_limited(t.calls, 86400, 60, 30_000)


@query("sm10_breaker")
def _(t):
    return R.broken_circuits(t.calls, 86400, 3)


@query("sm11_scheduler")
def _(t):
    value, kind = F.col("value"), F.col("event_type")
    fault = F.when(kind == "error", "auth").when(value > 90, "business").otherwise("retriable")
    faults = F.when((kind == "error") | (value > 50), F.create_map(F.lit("beta"), fault, F.lit("gamma"), F.when(value > 80, fault).otherwise("retriable")))
    calls = t.tasks.select(
        F.col("task_id").alias("pool"), "event_id", F.floor(F.col("us") / 1_000_000).alias("at"), F.floor(value * 1000).alias("tokens"),
        F.when(kind == "signup", F.when(value > 95, "nobody").otherwise("alpha")).alias("forced"), (kind == "purchase").alias("high_quality"), faults.alias("faults"),
    )
    models = [(n, (i + o) / 2, c, r, k) for n, i, o, c, r, k, on in MODELS if on]
    return R.scheduled(calls, models, 86400, 86400, 3, floor=0.001)


@query("sm03_dispatch", "SELECT event_id, 'handle_' || event_type AS handler FROM events WHERE event_type IN ('view', 'click')")
def _(t):
    messages = t.raw("events").select("event_id", F.col("event_type").alias("type"))
    return R.dispatched(messages, {"view": "handle_view", "click": "handle_click"}).select("event_id", "handler")


_SESSIONS = """l AS (SELECT task_id, us, event_id, CASE WHEN us - lag(us) OVER w >= {gap} * CAST(1000000 AS BIGINT) OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM tasks WINDOW w AS (PARTITION BY task_id ORDER BY us, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY us, event_id) AS session_no FROM l) SELECT task_id, CAST(session_no AS BIGINT) AS session_no, min(us) AS start, max(us) AS "end", count(*) AS n FROM n GROUP BY task_id, session_no"""


@query("sm12_session_ttl", f"WITH $tasks, {_SESSIONS.format(gap=7 * 86400)}")
def _(t):
    return C.merge_sessions(t.tasks, "task_id", "us", 7 * 86400)


@query("sm13_impact_cache", f"WITH $tasks, {_SESSIONS.format(gap=3600)}")
def _(t):
    return C.merge_sessions(t.tasks, "task_id", "us", 3600)


@query("sm14_token_expiry", "SELECT user_id, count(*) AS live FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-25' GROUP BY user_id")
def _(t):
    return t.raw("events").where("ts + interval 7 days > timestamp_ntz'2024-01-25'").groupBy("user_id").agg(F.count("*").alias("live"))


@query("sm15_chat_turn", f"WITH $chat, {_TEN}, k AS (SELECT session, count(*) AS n FROM s GROUP BY session) SELECT session, n, CASE WHEN n > 20 THEN n - 12 ELSE 0 END AS rolled, CASE WHEN n > 20 THEN 12 ELSE n END AS kept FROM k")
def _(t):
    split = C.rollup_split(_sessions(t))
    return split.groupBy("session").agg(F.count("*").alias("n"), F.count_if("overflow").alias("rolled"), F.count_if(~F.col("overflow")).alias("kept"))


@query("sm16_webhook_ingest", r"""WITH p AS (SELECT event_id, 'https://git.example.com/r' || user_id || '.git' AS url, CASE event_type WHEN 'view' THEN 'refs/tags/v1' ELSE 'refs/heads/main' END AS ref,
CASE event_type WHEN 'error' THEN '0000000000' ELSE json_extract_string(props, '$.k') END AS after FROM events),
r AS (SELECT DISTINCT 'git@git.example.com:r' || user_id AS url FROM events WHERE user_id < 40),
k AS (SELECT event_id, regexp_replace(regexp_replace(p.url, '\.git$', ''), '^https://', '') AS key, 'webhook-' || left(sha1(p.url || '|main|' || after), 16) AS task_id FROM p WHERE NOT starts_with(ref, 'refs/tags/') AND NOT regexp_matches(after, '^0+$'))
SELECT task_id, min(event_id) AS event_id FROM k JOIN (SELECT replace(replace(url, 'git@', ''), ':', '/') AS key FROM r) USING (key) GROUP BY task_id""")
def _(t):
    e = t.raw("events")
    url = F.concat(F.lit("https://git.example.com/r"), F.col("user_id").cast("string"), F.lit(".git"))
    kind = F.col("event_type")
    after = F.when(kind == "error", "0000000000").otherwise(F.get_json_object("props", "$.k"))
    pushes = e.select("event_id", url.alias("url"), F.when(kind == "view", "refs/tags/v1").otherwise("refs/heads/main").alias("ref"), after.alias("after"))
    repos = e.where("user_id < 40").select(S.normalize_url(F.concat(F.lit("git@git.example.com:r"), F.col("user_id").cast("string"))).alias("key")).distinct()
    kept = pushes.where(~S.is_tag(F.col("ref")) & ~S.is_deletion(F.col("after"))).withColumn("key", S.normalize_url(F.col("url")))
    task = S.webhook_task_id(F.col("url"), S.branch_of(F.col("ref")), F.col("after"))
    return kept.join(repos, "key", "left_semi").groupBy(task.alias("task_id")).agg(F.min("event_id").alias("event_id"))


@query("sm19_session_titles", f"WITH $chat, {_TEN}, u AS (SELECT session, first(text ORDER BY pos) AS text FROM s WHERE role = 'user' GROUP BY session) SELECT session, CASE WHEN length(text) > 20 THEN left(text, 20) || '...' ELSE text END AS title FROM u")
def _(t):
    return C.titles(_sessions(t))
