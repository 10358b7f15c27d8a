"""Counts, reports and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import scalars as S
from quarrylens.operators import graph as G
from quarrylens.operators import pool as P
from quarrylens.operators import secrets as X
from quarrylens.plans.registry import query


@query("ag01_count", "WITH $docs SELECT count(*) AS n FROM active WHERE repo_id = 1 AND content_source = 2")
def _(t):
    return t.slim.where("repo_id = 1 and content_source = 2").agg(F.count("*").alias("n"))


@query("ag02_report", """WITH $docs SELECT repo_id, count(*) AS docs, count(*) FILTER (content_source = 2) AS manual, count(*) FILTER (content_source = 1) AS auto,
count(*) FILTER (source_code_changed = 1) AS pending, count(DISTINCT module_name) AS modules FROM active GROUP BY repo_id""")
def _(t):
    one = lambda c: F.count_if(F.expr(c))
    return t.slim.groupBy("repo_id").agg(
        F.count("*").alias("docs"), one("content_source = 2").alias("manual"), one("content_source = 1").alias("auto"), one("source_code_changed = 1").alias("pending"), F.countDistinct("module_name").alias("modules")
    )


@query("ag03_page_total", "WITH $docs SELECT module_name, count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM active GROUP BY module_name")
def _(t):
    return t.slim.groupBy("module_name").agg(F.count("*").alias("total")).withColumn("pages", S.page_count(F.col("total"), F.lit(20)).cast("long"))


@query("ag04_exists", "WITH $tasks SELECT EXISTS (SELECT 1 FROM tasks WHERE task_id = 7) AS known, EXISTS (SELECT 1 FROM tasks WHERE task_id = -7) AS other")
def _(t):
    some = lambda i: t.tasks.where(F.col("task_id") == i).select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("e"))
    return some(7).select(F.col("e").alias("known")).crossJoin(some(-7).select(F.col("e").alias("other")))


@query("ag05_distinct_modules", "WITH $docs SELECT DISTINCT module_name FROM active WHERE risk_point ILIKE '%license%' OR summary ILIKE '%license%'")
def _(t):
    return t.active.where(F.col("risk_point").ilike("%license%") | F.col("summary").ilike("%license%")).select("module_name").distinct()


@query("ag06_module_relations", "WITH $edges SELECT DISTINCT caller_module AS from_module, callee_module AS to_module FROM edges WHERE call_kind = 2 AND caller_module <> callee_module")
def _(t):
    return G.module_relations(t.edges)


@query("ag07_module_set", "WITH $docs SELECT module_name AS module FROM active WHERE repo_id = 3 UNION SELECT * FROM (VALUES ('billing'), ('src1'))")
def _(t):
    return t.slim.where("repo_id = 3").select(F.col("module_name").alias("module")).union(t.rows("module string", ("billing",), ("src1",))).distinct()


@query("ag08_ordered_distinct", r"WITH $docs, w AS (SELECT id, list_filter(list_transform(string_split(summary, '.'), lambda x: trim(x)), lambda x: x <> '') AS xs FROM active) SELECT id, array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i), '|') AS parts FROM w")
def _(t):
    parts = F.filter(F.transform(F.split("summary", r"\."), lambda x: F.trim(x)), lambda x: x != "")
    return t.active.select("id", F.array_join(F.array_distinct(parts), "|").alias("parts"))


@query("ag10_pipeline_stats", """WITH $tasks SELECT task_id, count(*) AS total, count(*) FILTER (status = 2) AS hits, count(*) FILTER (status = 1) AS calls, count(*) FILTER (status = 0) AS skipped,
CASE WHEN count(*) > 0 THEN round(count(*) FILTER (status = 2) * 100.0 / count(*), 4) ELSE 0 END AS hit_rate FROM tasks GROUP BY task_id""")
def _(t):
    one = lambda s: F.count_if(F.col("status") == s)
    counted = t.tasks.groupBy("task_id").agg(F.count("*").alias("total"), one(2).alias("hits"), one(1).alias("calls"), one(0).alias("skipped"))
    return counted.withColumn("hit_rate", F.when(F.col("total") > 0, F.round(F.col("hits") * 100.0 / F.col("total"), 4)).otherwise(0.0))


@query("ag11_messages_per_session", "WITH $chat SELECT conv_id, count(*) AS n FROM chat GROUP BY conv_id")
def _(t):
    return t.chat.groupBy("conv_id").agg(F.count("*").alias("n"))


@query("ag15_listagg_neighbours", "WITH $edges SELECT caller_func, string_agg(callee_func, ',' ORDER BY callee_func) AS callees FROM edges WHERE caller_module = 'nation' AND callee_module = 'customer' GROUP BY caller_func")
def _(t):
    own = t.edges.where("caller_module = 'nation' and callee_module = 'customer'")
    return own.groupBy("caller_func").agg(F.array_join(F.array_sort(F.collect_list("callee_func")), ",").alias("callees"))


@query("ag17_cost", """WITH $calls, $models, r AS (SELECT *, CASE model WHEN 'click' THEN 'alpha' WHEN 'view' THEN 'beta' ELSE 'gamma' END AS name FROM calls)
SELECT r.name, count(*) AS calls, round(sum(round((tokens * price_in + tokens * price_out) / 1000, 6)), 4) AS cost FROM r JOIN models m ON m.name = r.name GROUP BY r.name""")
def _(t):
    name = F.when(F.col("model") == "click", "alpha").when(F.col("model") == "view", "beta").otherwise("gamma")
    priced = t.calls.withColumn("name", name).join(F.broadcast(t.models.select("name", "price_in", "price_out")), "name")
    cost = S.call_cost(F.col("tokens"), F.col("tokens"), F.col("price_in"), F.col("price_out"))
    return priced.groupBy("name").agg(F.count("*").alias("calls"), F.round(F.sum(cost), 4).alias("cost"))


@query("ag17_cost_by_version", """WITH $tasks, e AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS name FROM tasks),
v AS (SELECT name, us AS valid_from, max(value) / 100000 AS price_in FROM e WHERE event_type = 'signup' GROUP BY ALL), c AS (SELECT name, event_id, us, CAST(floor(value * 10) AS BIGINT) AS tokens FROM e WHERE event_type <> 'signup')
SELECT event_id, valid_from AS version, round((tokens * price_in + tokens * 2 * price_in) / 1000, 6) AS cost FROM c ASOF LEFT JOIN v ON c.name = v.name AND c.us >= v.valid_from""")
def _(t):
    """Each call by the prices in force at its time; a signup changes those of its model."""
    e = t.tasks.withColumn("name", F.when(F.col("event_id") % 3 == 0, "alpha").when(F.col("event_id") % 3 == 1, "beta").otherwise("gamma"))
    price = F.max("value") / 100000
    versions = e.where("event_type = 'signup'").groupBy("name", F.col("us").alias("valid_from")).agg(price.alias("price_in")).withColumns({"price_out": 2 * F.col("price_in"), "enabled": F.lit(True)})
    tokens = F.floor(F.col("value") * 10)
    calls = e.where("event_type <> 'signup'").select("name", "event_id", F.col("us").alias("at"), tokens.alias("tokens_in"), tokens.alias("tokens_out"))
    return P.priced(calls, versions, 86_400_000_000).select("event_id", "version", "cost")


_RULE_ROWS = ", ".join(f"('{n}', '{r}', '{p}')" for n, r, p in X.RULES)
_FINDINGS = rf"""rules(rule, risk, pattern) AS (VALUES {_RULE_ROWS}),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
findings AS (SELECT doc_id, line_no, rule, risk, regexp_extract(line, pattern) AS hit FROM lines, rules WHERE regexp_matches(line, pattern))"""
_MASK = "CASE WHEN length(hit) <= 8 THEN repeat('*', length(hit)) ELSE left(hit, 4) || '****' || right(hit, 4) END"


@query("sec1_secret_scan", f"WITH {_FINDINGS} SELECT doc_id, line_no, rule, risk, {_MASK} AS masked FROM findings")
def _(t):
    return X.scan(t.raw("documents"), "doc_id", "text").select("doc_id", "line_no", "rule", "risk", "masked")


@query("ag14_scan_summary", f"WITH {_FINDINGS} SELECT count(DISTINCT doc_id) AS files, count(*) FILTER (risk = 'high') AS high, count(*) FILTER (risk = 'medium') AS medium, count(*) FILTER (risk = 'low') AS low, count(*) AS total FROM findings")
def _(t):
    return X.summary(X.scan(t.raw("documents"), "doc_id", "text"))


@query("pf19_finding_list", f"WITH {_FINDINGS} SELECT doc_id, line_no, rule FROM findings WHERE risk = 'low' ORDER BY doc_id DESC, line_no, rule LIMIT 20")
def _(t):
    return X.scan(t.raw("documents"), "doc_id", "text").where("risk = 'low'").orderBy(F.desc("doc_id"), "line_no", "rule").limit(20).select("doc_id", "line_no", "rule")


@query("sk24_stale_findings", f"""WITH {_FINDINGS}, old(doc_id, rule, status) AS (SELECT doc_id, 'email', 'open' FROM documents WHERE n_chars < 600),
cur AS (SELECT DISTINCT doc_id, rule FROM findings WHERE rule = 'email')
SELECT coalesce(o.doc_id, c.doc_id) AS doc_id, coalesce(o.rule, c.rule) AS rule, CASE WHEN o.rule IS NULL THEN 'open' WHEN c.rule IS NULL AND o.status = 'open' THEN 'fixed' ELSE o.status END AS status
FROM old o FULL JOIN cur c ON o.doc_id = c.doc_id AND o.rule = c.rule""")
def _(t):
    old = t.raw("documents").where("n_chars < 600").select("doc_id", F.lit("email").alias("rule"), F.lit("open").alias("status"))
    current = X.scan(t.raw("documents"), "doc_id", "text").where("rule = 'email'").select("doc_id", "rule").distinct()
    return X.merge_findings(old, current, ["doc_id", "rule"])
