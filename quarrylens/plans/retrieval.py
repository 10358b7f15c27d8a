"""Hybrid retrieval and what is built on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import scalars as S
from quarrylens.operators import listing as L
from quarrylens.operators import prompts as M
from quarrylens.operators import retrieval as R
from quarrylens.operators import sessions as C
from quarrylens.plans.registry import query

_LIKE = " OR ".join(f"{c} ILIKE '%stupid%'" for c in R.KEYWORD_COLUMNS)
_RECALL = f"""$docs, $relations, d1 AS (SELECT * FROM active WHERE repo_id = 1),
near AS (SELECT vec_id AS id, list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS distance FROM embeddings WHERE vec_id IN (SELECT id FROM d1)),
a AS (SELECT id, row_number() OVER (ORDER BY distance, id) - 1 AS pos FROM near QUALIFY pos < 10),
b AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM d1 WHERE {_LIKE} QUALIFY pos < 5),
u AS (SELECT 0 AS channel, pos, id FROM a WHERE id > 0 UNION ALL SELECT 1, pos, id FROM b WHERE id > 0),
ids AS (SELECT id, channel, row_number() OVER (ORDER BY channel, pos) - 1 AS pos FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY channel, pos) = 1))"""
_EXPAND = """got AS (SELECT d1.*, ids.pos, 0 AS grp FROM ids JOIN d1 USING (id)), have AS (SELECT DISTINCT module_name AS m FROM got),
rel AS (SELECT to_module AS m FROM relations WHERE from_module IN (SELECT m FROM have) UNION SELECT from_module FROM relations WHERE to_module IN (SELECT m FROM have)),
want AS (SELECT m FROM rel WHERE m NOT IN (SELECT m FROM have)),
more AS (SELECT d1.*, row_number() OVER (ORDER BY id DESC) - 1 AS pos, 1 AS grp FROM d1 WHERE module_name IN (SELECT m FROM want) QUALIFY pos < 5 * (SELECT count(*) FROM want)),
hybrid AS (SELECT * EXCLUDE (pos), row_number() OVER (ORDER BY grp, pos) - 1 AS pos FROM (SELECT * FROM got UNION ALL SELECT * FROM more))"""
_FIELD = "CASE WHEN length({0}) > 300 THEN left({0}, 300) || '...' ELSE {0} END"
_ENTRY = (
    "'[' || (pos + 1) || '] 模块:' || module_name || ' 函数:' || func_name || ' 文件:' || file_path || ':' || func_line || chr(10) || '摘要:' || "
    + _FIELD.format("summary") + " || chr(10) || '流程:' || " + _FIELD.format("process_flow") + " || chr(10) || '风险:' || " + _FIELD.format("risk_point") + " || chr(10)"
)
_CONTEXT = f"entries AS (SELECT pos, id, e, sum(octet_length(encode(e))) OVER (ORDER BY pos) AS used FROM (SELECT pos, id, {_ENTRY} AS e FROM hybrid))"


def _parts(t):
    docs = t.active.where("repo_id = 1").drop("source_code")
    return docs, t.vectors, t.vectors.where("id = 0")


def _hybrid(t):
    return R.hybrid(*_parts(t), "stupid", t.relations)


@query("rt01_hybrid_retrieval", f"WITH {_RECALL}, {_EXPAND} SELECT pos, id, module_name, func_name, CAST(grp AS INTEGER) AS grp FROM hybrid")
def _(t):
    return _hybrid(t).select(F.col("pos").cast("long").alias("pos"), "id", "module_name", "func_name", "grp")


@query("rt02_vector_only", f"WITH {_RECALL} SELECT a.pos, id, module_name FROM a JOIN d1 USING (id)")
def _(t):
    docs, vectors, wanted = _parts(t)
    near = R.ranked(R.vector_top_k(vectors.join(docs.select("id"), "id", "left_semi"), wanted, R.VECTOR_K), F.col("distance"), F.col("id"))
    return R.load_in_order(near.select("id", "pos"), docs).select(F.col("pos").cast("long").alias("pos"), "id", "module_name")


@query("rt03_hybrid_no_expand", f"WITH {_RECALL} SELECT ids.pos, id, module_name FROM ids JOIN d1 USING (id)")
def _(t):
    docs, vectors, wanted = _parts(t)
    return R.load_in_order(R.recall(docs, vectors, wanted, "stupid").select("id", "pos"), docs).select(F.col("pos").cast("long").alias("pos"), "id", "module_name")


@query("rt04_context_assembly", f"WITH {_RECALL}, {_EXPAND}, {_CONTEXT} SELECT pos, id, e AS entry, CAST(used AS BIGINT) AS used FROM entries WHERE used <= 6000")
def _(t):
    return R.context_entries(_hybrid(t)).select(F.col("pos").cast("long").alias("pos"), "id", "entry", "used")


@query("rt05_related_functions", f"WITH {_RECALL}, {_EXPAND} SELECT module_name AS module, func_name AS func, CASE WHEN length(summary) > 100 THEN left(summary, 100) || '...' ELSE summary END AS summary FROM hybrid")
def _(t):
    return _hybrid(t).select(F.col("module_name").alias("module"), F.col("func_name").alias("func"), S.truncate(F.col("summary"), 100).alias("summary"))


@query("rt06_degraded_result", f"WITH {_RECALL}, words(word) AS (VALUES ('stupid'), ('zzzzqq')), r AS (SELECT word, (SELECT count(*) FROM d1 WHERE {_LIKE.replace(chr(39) + '%stupid%' + chr(39), chr(39) + '%' + chr(39) + ' || word || ' + chr(39) + '%' + chr(39))}) AS n FROM words) SELECT word, n, n = 0 AS knowledge_missing FROM r")
def _(t):
    docs = t.active.where("repo_id = 1").drop("source_code")
    parts = [docs.agg(F.count_if(_any_like(w)).alias("n")).select(F.lit(w).alias("word"), "n", (F.col("n") == 0).alias("knowledge_missing")) for w in ("stupid", "zzzzqq")]
    return parts[0].union(parts[1])


@query("rt06_fallback_answer", f"""WITH $docs, r AS (SELECT DISTINCT source AS request FROM documents UNION SELECT 'none'),
k AS (SELECT module_name AS request, id, func_name, CASE WHEN length(summary) > 100 THEN left(summary, 100) || '...' ELSE summary END AS said FROM active QUALIFY row_number() OVER (PARTITION BY module_name ORDER BY id DESC) <= 5),
f AS (SELECT request, string_agg(func_name, ',' ORDER BY id DESC) AS functions, md5(string_agg(said, chr(10) ORDER BY id DESC)) AS said_md5, count(*) AS n FROM k GROUP BY request)
SELECT request, CASE WHEN n > 0 THEN request ELSE '' END AS modules, coalesce(functions, '') AS functions, coalesce(said_md5, md5('')) AS said_md5, CASE WHEN n > 0 THEN '{R._UNREAD}' ELSE '{R._NO_DOCUMENTS}' END AS analysis, n IS NULL AS knowledge_missing FROM r LEFT JOIN f USING (request)""")
def _(t):
    """Requests for each module, and one that recalls nothing, whose answers could not be read."""
    newest = L.last_n(t.marked(t.sources.select("id", "module_name", "file_path", "func_name", "summary")), ["module_name"], "id", 5)
    recalled = newest.withColumn("request", F.col("module_name")).withColumn("pos", -F.col("id"))
    requests = t.raw("documents").select(F.col("source").alias("request")).distinct().union(t.rows("request string", ("none",)))
    out = R.fallback(requests, recalled)
    said = F.array_join(F.transform("related_functions", lambda f: f["summary"]), "\n")
    names = F.array_join(F.transform("related_functions", lambda f: f["func_name"]), ",")
    return out.select("request", F.array_join("related_modules", ",").alias("modules"), names.alias("functions"), F.md5(said.cast("binary")).alias("said_md5"), "analysis", "knowledge_missing")


def _any_like(word):
    out = F.lit(False)
    for c in R.KEYWORD_COLUMNS:
        out = out | F.col(c).ilike(f"%{word}%")
    return out


@query("rt07_chat_context", r"""WITH $chat, m AS (SELECT conv_id AS session, turn AS pos, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM chat)
SELECT session, '[历史对话摘要]' || chr(10) || '（无）' || chr(10) || CASE WHEN count(*) FILTER (back > 1 AND back <= 12) > 0 THEN chr(10) || '[最近对话]' || chr(10) ||
string_agg(role || ': ' || CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END || chr(10), '' ORDER BY pos) FILTER (back > 1 AND back <= 12) ELSE '' END ||
chr(10) || '[当前问题]' || chr(10) || max(text) FILTER (back = 1) || chr(10) AS prompt FROM m GROUP BY session""")
def _(t):
    return C.prompts(t.chat.select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "role", "text"))


@query("df05_query_seeds", f"WITH {_RECALL}, t AS (SELECT ids.pos, id, func_name, lower(concat_ws(' ', module_name, func_name, file_path, summary, process_flow, risk_point)) AS body FROM ids JOIN d1 USING (id)) SELECT id, func_name FROM t WHERE CAST(contains(body, 'stupid') AS INT) + CAST(contains(body, 'the') AS INT) + CAST(contains(body, 'src') AS INT) >= 2 ORDER BY pos LIMIT 8")
def _(t):
    docs, vectors, wanted = _parts(t)
    got = R.load_in_order(R.recall(docs, vectors, wanted, "stupid").select("id", "pos"), docs)
    body = F.concat_ws(" ", *R.KEYWORD_COLUMNS[:1], "func_name", "file_path", "summary", "process_flow", "risk_point")
    return got.where(L.hits_of(body, ["stupid", "the", "src"]) >= 2).orderBy("pos").limit(8).select("id", "func_name")


_IMPACT = f"""i AS (SELECT module_name AS request, ['{M.CHANGED}', '{M.UPSTREAM}', '{M.DOWNSTREAM}'][id % 3 + 1] AS kind, module_name AS module, func_name AS func, file_path AS file, left(summary, 40) AS summary, id % 2 + 1 AS depth,
CASE id % 3 WHEN 1 THEN module_name || '.' || func_name || '{M._CALLS}' || module_name || '.F' || (id - 1) WHEN 2 THEN module_name || '.F' || (id - 2) || '{M._CALLS}' || module_name || '.' || func_name END AS edge FROM docs),
f AS (SELECT *, row_number() OVER (PARTITION BY request, kind ORDER BY depth, module, func, coalesce(edge, '')) AS place FROM i QUALIFY place <= 5)"""


def _impact(t):
    """Documents of each module as an impact: a third changed, a third calls the one before, a third is called by the one before that."""
    n, name = F.col("id"), S.function_key(F.col("module_name"), F.col("func_name"))
    near = lambda back: F.concat("module_name", F.lit(".F"), (n - back).cast("string"))
    kind = F.when(n % 3 == 0, M.CHANGED).when(n % 3 == 1, M.UPSTREAM).otherwise(M.DOWNSTREAM)
    edge = F.when(n % 3 == 1, M.edge_text(name, near(1))).when(n % 3 == 2, M.edge_text(near(2), name))
    return t.sources.select(
        F.col("module_name").alias("request"), kind.alias("kind"), F.col("module_name").alias("module"), F.col("func_name").alias("func"), F.col("file_path").alias("file"), F.left("summary", F.lit(40)).alias("summary"),
        (n % 2 + 1).alias("depth"), edge.alias("edge"),
    )


@query("fn21_impact_prompts", f"""WITH $docs, {_IMPACT}, l AS (SELECT request, kind, place, CASE kind WHEN 'changed' THEN '- ' || module || '.' || func || ' (文件 ' || coalesce(file, '') || ')' ELSE '- [深度' || depth || '] ' || module || '.' || func || ' ' || edge END || chr(10) || '  摘要: ' || summary || chr(10) AS line FROM f),
s AS (SELECT request, coalesce(string_agg(line, '' ORDER BY place) FILTER (kind = 'changed'), '') AS c, coalesce(string_agg(line, '' ORDER BY place) FILTER (kind = 'upstream'), '') AS u, coalesce(string_agg(line, '' ORDER BY place) FILTER (kind = 'downstream'), '') AS d FROM l GROUP BY request)
SELECT request, '{M._IMPACT_HEAD}' || '{M._SECTIONS[M.CHANGED]}' || c || CASE WHEN u <> '' THEN '{M._SECTIONS[M.UPSTREAM]}' || u ELSE '' END || CASE WHEN d <> '' THEN '{M._SECTIONS[M.DOWNSTREAM]}' || d ELSE '' END || '{M._IMPACT_END}' AS prompt FROM s""")
def _(t):
    return M.impact_prompts(_impact(t), 5)


@query("fn21_change_prompts", f"""WITH $docs, {_IMPACT}, a AS (SELECT request, kind, place, CASE kind WHEN 'upstream' THEN split_part(edge, '{M._CALLS}', 2) ELSE split_part(edge, '{M._CALLS}', 1) END AS name, CASE kind WHEN 'upstream' THEN split_part(edge, '{M._CALLS}', 1) ELSE split_part(edge, '{M._CALLS}', 2) END || '(深度' || depth || ')' AS told FROM f WHERE kind <> 'changed'),
c AS (SELECT request, name, string_agg(told, '、' ORDER BY place) FILTER (kind = 'upstream') AS u, string_agg(told, '、' ORDER BY place) FILTER (kind = 'downstream') AS d FROM a GROUP BY request, name),
e AS (SELECT f.request, f.place, chr(10) || '【' || module || '.' || func || '】文件 ' || coalesce(file, '') || chr(10) || '  摘要: ' || summary || chr(10) || coalesce('  上游调用方: ' || u || chr(10), '') || coalesce('  下游依赖: ' || d || chr(10), '') AS entry FROM f LEFT JOIN c ON c.request = f.request AND c.name = module || '.' || func WHERE kind = 'changed')
SELECT request, '{M._CHANGE_HEAD}' || string_agg(entry, '' ORDER BY place) || '{M._CHANGE_END}' AS prompt FROM e GROUP BY request""")
def _(t):
    return M.change_prompts(_impact(t), 5)
