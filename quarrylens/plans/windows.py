"""Ranks, running budgets, ranges and streaks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylens.operators import listing as L
from quarrylens.operators import sessions as C
from quarrylens.operators import windows as W
from quarrylens.plans.registry import query

_TEN = "s AS (SELECT conv_id % 10 AS session, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) AS pos, role, text FROM chat)"


def _sessions(t):
    """Ten sessions, each of many conversations one after another."""
    pos = F.row_number().over(Window.partitionBy("session").orderBy("conv_id", "turn"))
    return t.chat.withColumn("session", F.col("conv_id") % 10).withColumn("pos", pos.cast("long")).select("session", "pos", "role", "text")


@query("wn01_last_n", f"WITH $chat, {_TEN} SELECT session, pos, role, text FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos DESC) <= 12")
def _(t):
    return L.last_n(_sessions(t), ["session"], "pos", 12)


@query("wn02_rollup_split", f"WITH $chat, {_TEN}, c AS (SELECT *, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY pos DESC) AS back FROM s) SELECT session, pos, n > 20 AND back > 12 AS overflow FROM c")
def _(t):
    return C.rollup_split(_sessions(t), trigger=20, keep=12).select("session", "pos", "overflow")


@query("wn03_context_prefix", "WITH $docs, r AS (SELECT id, module_name, octet_length(encode(summary)) AS b, sum(octet_length(encode(summary))) OVER (PARTITION BY module_name ORDER BY id) AS used FROM active) SELECT module_name, id, CAST(used AS BIGINT) AS used FROM r WHERE used <= 6000")
def _(t):
    sized = t.marked(t.sources.select("module_name", "id", F.octet_length("summary").cast("long").alias("bytes")))
    return W.prefix_budget(sized, ["module_name"], "id", "bytes", 6000).select("module_name", "id", "used")


@query("wn04_budget", "WITH $tasks, r AS (SELECT task_id, event_id, status <> 2 AS wants, sum(CASE WHEN status <> 2 THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent FROM tasks) SELECT task_id, event_id, CASE WHEN coalesce(spent, 0) >= 5 THEN 'skipped' WHEN wants THEN 'call' ELSE 'hit' END AS action FROM r")
def _(t):
    return W.call_budget(t.tasks.withColumn("wants", F.col("status") != 2), ["task_id"], "event_id", "wants", 5).select("task_id", "event_id", "action")


@query("wn08_range_rate", "WITH $calls SELECT event_id, model, count(*) OVER w AS requests, CAST(sum(tokens) OVER w AS BIGINT) AS tokens_in_window FROM calls WINDOW w AS (PARTITION BY model ORDER BY \"at\" RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)")
def _(t):
    return W.range_rate(t.calls, "model", "at", "tokens", 3600).select("event_id", "model", "requests", "tokens_in_window")


@query("wn09_failure_streak", "WITH $calls, i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY model ORDER BY \"at\", event_id) AS island FROM calls) SELECT event_id, model, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY model, island ORDER BY \"at\", event_id) AS BIGINT) AS streak FROM i")
def _(t):
    return W.failure_streak(t.calls, "model", ["at", "event_id"], "failed").select("event_id", "model", "streak")


@query("wn10_newest_doc", "WITH $docs SELECT module_name, repo_id, max(id) AS id FROM active GROUP BY ALL")
def _(t):
    return L.last_n(t.slim, ["module_name", "repo_id"], "id", 1).select("module_name", "repo_id", "id")


@query("wn11_topk_per_module", "WITH $docs SELECT module_name, id FROM active QUALIFY row_number() OVER (PARTITION BY module_name ORDER BY id DESC) <= 5")
def _(t):
    return L.last_n(t.slim, ["module_name"], "id", 5).select("module_name", "id")
