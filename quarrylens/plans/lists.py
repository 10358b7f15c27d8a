"""Scans, lists, pages and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import scalars as S
from quarrylens.operators import listing as L
from quarrylens.plans.registry import query

_SLIM = "id, repo_id, module_name, file_path, func_name, func_line, content_source, source_code_changed"
_COLS = _SLIM.split(", ")


@query("sc02_point_lookup", f"WITH $docs SELECT {_SLIM} FROM active WHERE id = 1")
def _(t):
    return L.by_key(t.slim, id=1).select(*_COLS)


@query("sc04_doc_page", f"WITH $docs SELECT {_SLIM}, count(*) OVER () AS total FROM active WHERE repo_id = 1 ORDER BY id DESC LIMIT 20 OFFSET 20")
def _(t):
    return L.page(L.matching(t.slim, repo_id=1), 2, 20, F.desc("id")).select(*_COLS, "total")


@query("sc05_task_page", "WITH $tasks SELECT event_id, task_id, status FROM tasks WHERE task_id = 7 ORDER BY us DESC, event_id DESC LIMIT 20")
def _(t):
    return t.tasks.where("task_id = 7").orderBy(F.desc("us"), F.desc("event_id")).limit(20).select("event_id", "task_id", "status")


@query("sc06_composite_lookup", f"WITH $docs SELECT {_SLIM} FROM active WHERE repo_id = 1 AND file_path = 'src1/en/1.go' AND func_name = 'F1'")
def _(t):
    return L.by_key(t.slim, repo_id=1, file_path="src1/en/1.go", func_name="F1").select(*_COLS)


@query("sc08_docs_by_module", f"WITH $docs SELECT {_SLIM} FROM active WHERE repo_id = 1 AND module_name = 'src3' ORDER BY id DESC LIMIT 20")
def _(t):
    return L.matching(t.slim, repo_id=1, module_name="src3").orderBy(F.desc("id")).limit(20).select(*_COLS)


@query("sc09_docs_by_modules_limit", f"WITH $docs SELECT {_SLIM} FROM active WHERE repo_id = 1 AND module_name IN ('src1', 'src2', 'src3') ORDER BY id DESC LIMIT 15")
def _(t):
    return L.in_modules(t.slim.where("repo_id = 1"), ["src1", "src2", "src3"], 15).select(*_COLS)


@query("sc10_manual_docs", f"WITH $docs SELECT {_SLIM} FROM active WHERE repo_id = 1 AND content_source = 2 ORDER BY id DESC")
def _(t):
    return L.matching(t.slim, repo_id=1, content_source=2).orderBy(F.desc_nulls_last("id")).select(*_COLS)


@query("sc11_pending_review", f"WITH $docs SELECT {_SLIM} FROM active WHERE repo_id = 1 AND source_code_changed = 1")
def _(t):
    return L.matching(t.slim, repo_id=1, source_code_changed=1).select(*_COLS)


_REPOS = "repos(id, name, status) AS (VALUES (1, 'en', 1), (2, 'fr', 1), (3, 'de', 2), (4, 'es', 1))"


def _repos(t):
    return t.rows("id int, name string, status int", (1, "en", 1), (2, "fr", 1), (3, "de", 2), (4, "es", 1))


@query("sc13_managed_repos", f"WITH {_REPOS}, $docs SELECT r.id, r.name, r.status, count(DISTINCT d.module_name) AS modules FROM repos r LEFT JOIN active d ON d.repo_id = r.id GROUP BY ALL")
def _(t):
    return _repos(t).join(t.slim.groupBy(F.col("repo_id").cast("int").alias("id")).agg(F.countDistinct("module_name").alias("modules")), "id", "left").select("id", "name", "status", F.coalesce("modules", F.lit(0).cast("long")).alias("modules"))


@query("sc15_log_by_doc", "WITH $tasks SELECT task_id, event_id, event_type FROM tasks WHERE task_id = 3 ORDER BY event_id DESC")
def _(t):
    return t.tasks.where("task_id = 3").orderBy(F.desc("event_id")).select("task_id", "event_id", "event_type")


@query("sc16_changed_files", """WITH $code, o AS (SELECT file, string_agg(func || signature, ';' ORDER BY pos) AS c FROM old_code GROUP BY file), n AS (SELECT file, string_agg(func || signature, ';' ORDER BY pos) AS c FROM new_code GROUP BY file)
SELECT coalesce(o.file, n.file) AS file, CASE WHEN o.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.file = n.file WHERE o.c IS DISTINCT FROM n.c""")
def _(t):
    return L.changed_files(t.old_code, t.new_code)


@query("sc23_doc_source", """WITH $docs SELECT d.id, file_path, CASE WHEN trim(source_code) <> '' THEN source_code ELSE p.html END AS source, trim(source_code) = '' AS fetched
FROM active d LEFT JOIN pages p ON p.page_id = d.id WHERE repo_id = 4""")
def _(t):
    pages = t.raw("pages").select(F.col("page_id").alias("id"), "html")
    blank = F.trim("source_code") == ""
    return t.active.where("repo_id = 4").join(pages, "id", "left").select("id", "file_path", F.when(~blank, F.col("source_code")).otherwise(F.col("html")).alias("source"), blank.alias("fetched"))


@query("sc24_last_n_messages", "WITH $chat SELECT conv_id, turn, role, text FROM chat QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def _(t):
    return L.last_n(t.chat, ["conv_id"], "turn", 4).select("conv_id", "turn", "role", "text")


@query("pf02_equality_map", f"WITH $docs SELECT {_SLIM} FROM active WHERE repo_id = 2 AND content_source = 1 AND source_code_changed = 0")
def _(t):
    return L.matching(t.slim, repo_id=2, content_source=1, source_code_changed=0).select(*_COLS)


_EIGHT = ("module_name", "func_name", "file_path", "summary", "process_flow", "risk_point")
_LIKE = " OR ".join(f"{c} ILIKE '%idiot%'" for c in _EIGHT)


@query("pf03_keyword_or_like", f"WITH $docs SELECT id, module_name, file_path FROM active WHERE repo_id = 1 AND ({_LIKE}) ORDER BY id LIMIT 10")
def _(t):
    return L.keyword(t.active.where("repo_id = 1"), "idiot", _EIGHT).orderBy("id").limit(10).select("id", "module_name", "file_path")


@query("pf04_table_mention", "WITH $docs SELECT DISTINCT module_name FROM active WHERE process_flow ILIKE '%token%' OR summary ILIKE '%token%' OR risk_point ILIKE '%token%'")
def _(t):
    return L.keyword(t.active, "token", ("process_flow", "summary", "risk_point")).select("module_name").distinct()


@query("pf05_relations_in_or", "WITH $relations SELECT * FROM relations WHERE from_module IN ('src1', 'src2') OR to_module IN ('src1', 'src2') ORDER BY relation_type, id")
def _(t):
    return t.relations.where(F.col("from_module").isin("src1", "src2") | F.col("to_module").isin("src1", "src2")).orderBy("relation_type", "id")


@query("pf07_unexpired", "WITH $tasks SELECT task_id, count(*) AS n FROM tasks WHERE us > 1705000000000000 GROUP BY task_id")
def _(t):
    return t.tasks.where("us > 1705000000000000").groupBy("task_id").agg(F.count("*").alias("n"))


@query("pf08_vector_filter", "WITH $docs SELECT vec_id AS id, module_name FROM embeddings e JOIN active d ON d.id = e.vec_id WHERE repo_id = 1 AND module_name = 'src3'")
def _(t):
    return t.vectors.select("id").join(t.slim.where("repo_id = 1 and module_name = 'src3'"), "id").select("id", "module_name")


@query("pf09_file_filter_reason", r"""WITH $files SELECT id, path, CASE WHEN trim(path) = '' THEN 'blank' WHEN lower(regexp_extract(path, '\.([^.]+)$', 1)) NOT IN ('go', 'php') THEN 'extension'
WHEN list_has_any(string_split(path, '/'), ['vendor', 'node_modules', 'mock', 'fixture']) THEN 'directory' WHEN regexp_matches(path, '_test\.go$') THEN 'pattern' ELSE '' END AS reason FROM files""")
def _(t):
    return t.files.select("id", "path", L.skip_reason(F.col("path")).alias("reason"))


_TERMS = "list_distinct(list_filter(list_transform(regexp_extract_all(q, '[A-Za-z][A-Za-z0-9_]{2,}'), lambda w: lower(w)), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + ")))"
_QUERY = "The thonea that is stupid and token password reader"


@query("pf10_term_relevance", f"""WITH $docs, terms AS (SELECT {_TERMS} AS ts FROM (SELECT '{_QUERY}' AS q)),
b AS (SELECT id, lower(concat_ws(' ', module_name, func_name, file_path, summary, process_flow, risk_point)) AS body FROM active)
SELECT id, CAST(len(list_filter(ts, lambda w: contains(body, w))) AS BIGINT) AS hits FROM b, terms WHERE len(list_filter(ts, lambda w: contains(body, w))) >= 2""")
def _(t):
    return L.relevant(t.active, _QUERY).select("id", "hits")


@query("ag16_term_hits", f"""WITH $docs, terms AS (SELECT {_TERMS} AS ts FROM (SELECT '{_QUERY}' AS q)),
b AS (SELECT module_name, lower(concat_ws(' ', module_name, func_name, file_path, summary, process_flow, risk_point)) AS body FROM active)
SELECT module_name, CAST(sum(len(list_filter(ts, lambda w: contains(body, w)))) AS BIGINT) AS hits FROM b, terms GROUP BY module_name""")
def _(t):
    hits = t.marked(L.term_hits(t.sources, _QUERY).select("id", "module_name", "hits"))
    return hits.groupBy("module_name").agg(F.sum("hits").alias("hits"))


@query("pf12_model_candidates", "WITH $offers SELECT name, max_context FROM offers WHERE enabled AND (max_context <= 0 OR max_context >= 50000) AND (price_in + price_out) / 2 >= 0.0004")
def _(t):
    return L.candidate_models(t.offers, estimated_tokens=50000, least_price=0.0004).select("name", "max_context")


@query("pf15_deny_list", "WITH $edges SELECT callee_module, count(*) AS n FROM edges WHERE callee_module NOT IN ('region', 'nation') GROUP BY 1")
def _(t):
    return t.edges.where(~F.col("callee_module").isin("region", "nation")).groupBy("callee_module").agg(F.count("*").alias("n"))


@query("pf17_history_projection", "WITH $tasks SELECT event_id, task_id, event_type FROM tasks WHERE task_id = 5 ORDER BY event_id DESC")
def _(t):
    return t.tasks.where("task_id = 5").select("event_id", "task_id", "event_type").orderBy(F.desc("event_id"))


@query("pf18_status_labels", "WITH $tasks SELECT status, CASE status WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'success' WHEN 3 THEN 'failed' ELSE 'unknown' END AS label, count(*) AS n FROM tasks GROUP BY 1, 2")
def _(t):
    return t.tasks.groupBy("status", L.status_label(F.col("status")).alias("label")).agg(F.count("*").alias("n"))


@query("pf21_owned_log", "WITH $tasks SELECT event_id, event_type FROM tasks WHERE event_id = 8 AND task_id = (SELECT task_id FROM tasks WHERE event_id = 8)")
def _(t):
    return t.tasks.where("event_id = 8").join(t.tasks.where("event_id = 8").select("task_id"), "task_id", "left_semi").select("event_id", "event_type")


@query("pf23_enabled_repo", f"WITH {_REPOS}, $docs SELECT repo_id, count(*) AS n FROM active WHERE repo_id IN (SELECT id FROM repos WHERE status = 1) GROUP BY repo_id")
def _(t):
    enabled = _repos(t).where("status = 1").select(F.col("id").cast("long").alias("repo_id"))
    return t.slim.join(F.broadcast(enabled), "repo_id", "left_semi").groupBy("repo_id").agg(F.count("*").alias("n"))


@query("st01_multi_key_sort", "WITH $relations SELECT relation_type, id, from_module FROM relations ORDER BY relation_type, id")
def _(t):
    return t.relations.select("relation_type", "id", "from_module").orderBy("relation_type", "id")


@query("st02_page", f"WITH $docs SELECT {_SLIM} FROM active ORDER BY id LIMIT 100 OFFSET 300")
def _(t):
    return L.page(t.slim, 4, 500, F.asc("id")).select(*_COLS)


@query("st05_sessions_desc", "WITH $chat SELECT conv_id, max(turn) AS updated, count(*) AS n FROM chat GROUP BY conv_id ORDER BY updated DESC, conv_id LIMIT 50")
def _(t):
    return t.chat.groupBy("conv_id").agg(F.max("turn").alias("updated"), F.count("*").alias("n")).orderBy(F.desc("updated"), "conv_id").limit(50)


@query("st06_cheapest_model", "WITH $offers SELECT name, row_number() OVER (ORDER BY (price_in + price_out) / 2, name) AS pos FROM offers WHERE enabled")
def _(t):
    return L.by_price(L.candidate_models(t.offers)).select("name", "pos")


@query("st07_seed_cap", "WITH $docs SELECT id, func_name FROM active WHERE repo_id = 1 ORDER BY id LIMIT 8")
def _(t):
    return t.slim.where("repo_id = 1").orderBy("id").limit(8).select("id", "func_name")
