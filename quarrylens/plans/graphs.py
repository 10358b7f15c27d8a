"""Graph searches, snapshot differences, document merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import diff as D
from quarrylens.operators import graph as G
from quarrylens.operators import merge as M
from quarrylens.operators import retrieval as R
from quarrylens.plans.joins import _DIFF, _GHOSTS
from quarrylens.plans.registry import query
from quarrylens.sources.scratch import settle


def _bfs_sql(name: str, near: str, far: str, depth: int) -> str:
    return f"""{name}(module, func, depth) AS (SELECT 'part', '1', 0 UNION SELECT e.{far}_module, e.{far}_func, b.depth + 1 FROM {name} b JOIN edges e ON e.{near}_module = b.module AND e.{near}_func = b.func WHERE b.depth < {depth}),
{name}_all AS (SELECT module, func, min(depth) AS depth FROM {name} GROUP BY 1, 2), {name}_out AS (SELECT module, func, CAST(depth AS INTEGER) AS depth FROM {name}_all WHERE depth > 0)"""


_DOWN, _UP = _bfs_sql("down", "caller", "callee", 2), _bfs_sql("up", "callee", "caller", 2)


def _seeds(t):
    return t.rows("module string, func string", ("part", "1"))


@query("gr02_bfs_down", f"WITH RECURSIVE $edges, {_bfs_sql('down', 'caller', 'callee', 3)} SELECT * FROM down_out")
def _(t):
    return G.bfs(t.edge_table, _seeds(t), 3).select("module", "func", "depth")


@query("gr02_bfs_up", f"WITH RECURSIVE $edges, {_bfs_sql('up', 'callee', 'caller', 3)} SELECT * FROM up_out")
def _(t):
    return G.bfs(t.edge_table, _seeds(t), 3, reverse=True).select("module", "func", "depth")


_BOTH = f"WITH RECURSIVE $edges, {_DOWN}, {_UP}, impacted AS (SELECT *, 'reverse' AS kind FROM up_out UNION ALL SELECT *, 'forward' FROM down_out)"


@query("gr03_impact_both", f"{_BOTH} SELECT * FROM impacted")
def _(t):
    return G.impact(t.edge_table, _seeds(t)).select("module", "func", "depth", "kind")


_NODES = """nodes AS (SELECT module, func, kind FROM (SELECT 'part' AS module, '1' AS func, 0 AS rk, 'changed' AS kind UNION ALL SELECT module, func, CASE kind WHEN 'reverse' THEN 1 ELSE 2 END, kind FROM impacted)
QUALIFY row_number() OVER (PARTITION BY module, func ORDER BY rk) = 1)"""


@query("gr04_impact_subgraph", f"""{_BOTH}, {_NODES} SELECT a.kind AS from_kind, b.kind AS to_kind, caller_module, caller_func, callee_module, callee_func FROM edges e
JOIN nodes a ON a.module = e.caller_module AND a.func = e.caller_func JOIN nodes b ON b.module = e.callee_module AND b.func = e.callee_func""")
def _(t):
    seeds = _seeds(t)
    nodes = settle(G.impact_nodes(seeds, G.impact(t.edge_table, seeds)), "impact-nodes")  # read by both joins
    a = nodes.select(F.col("module").alias("caller_module"), F.col("func").alias("caller_func"), F.col("kind").alias("from_kind"))
    b = nodes.select(F.col("module").alias("callee_module"), F.col("func").alias("callee_func"), F.col("kind").alias("to_kind"))
    return t.edge_table.join(a, ["caller_module", "caller_func"]).join(b, ["callee_module", "callee_func"]).select("from_kind", "to_kind", "caller_module", "caller_func", "callee_module", "callee_func")


@query("gr05_ego_graph", """WITH $edges SELECT 'self' AS side, 'supplier' AS module, '3' AS func UNION ALL SELECT 'callee', callee_module, callee_func FROM edges WHERE caller_module = 'supplier' AND caller_func = '3'
UNION ALL SELECT 'caller', caller_module, caller_func FROM edges WHERE callee_module = 'supplier' AND callee_func = '3'""")
def _(t):
    return t.rows("side string, module string, func string", ("self", "supplier", "3")).union(G.one_hop(t.edges, "supplier", "3"))


@query("gr06_module_neighbours", "WITH $relations SELECT 'out' AS side, to_module AS module, relation_type FROM relations WHERE from_module = 'src4' UNION ALL SELECT 'in', from_module, relation_type FROM relations WHERE to_module = 'src4'")
def _(t):
    out = t.relations.where("from_module = 'src4'").select(F.lit("out").alias("side"), F.col("to_module").alias("module"), "relation_type")
    return out.union(t.relations.where("to_module = 'src4'").select(F.lit("in"), "from_module", "relation_type"))


@query("gr07_module_expand", """WITH $docs, $relations, rel AS (SELECT to_module AS m FROM relations WHERE from_module IN ('src1', 'src2') UNION SELECT from_module FROM relations WHERE to_module IN ('src1', 'src2')),
want AS (SELECT m FROM rel WHERE m NOT IN ('src1', 'src2')) SELECT id, module_name FROM active WHERE module_name IN (SELECT m FROM want) QUALIFY row_number() OVER (ORDER BY id DESC) <= 5 * (SELECT count(*) FROM want)""")
def _(t):
    recalled = t.rows("module_name string", ("src1",), ("src2",))
    return R.expand(recalled, t.slim, t.relations).select("id", "module_name")


@query("gr08_call_edges", """WITH $docs SELECT module_name AS caller_module, func_name AS caller_func, module_name AS callee_module, 'f' || id % 7 AS callee_func, 1 AS call_kind FROM docs
UNION ALL SELECT module_name, func_name, 'm' || id % 3, 'G' || id, 2 FROM docs WHERE id % 3 < 2""")
def _(t):
    """Calls as parsed from documents' functions: one of the module twice, a builtin, one of an import if there is such an import, one of a standard import, one of no import."""
    number = F.col("id").cast("string")
    own = F.concat(F.lit("f"), (F.col("id") % 7).cast("string"))
    simple = F.array(own, F.lit("make"), own)
    calls = F.array(F.concat(F.lit("m"), (F.col("id") % 3).cast("string"), F.lit(".G"), number), F.lit("fmt.Println"), F.lit("r.Context"))
    imports = F.create_map(*map(F.lit, ("m0", "lib/m0/", "m1", "shop/m1", "fmt", "fmt")))
    parsed = t.sources.select(F.col("file_path").alias("path"), "func_name", simple.alias("callee_simple"), calls.alias("callee"), imports.alias("imports"))
    return M.call_edges(parsed).select("caller_module", "caller_func", "callee_module", "callee_func", "call_kind")


@query("df01_api_diff", f"WITH $code, x AS (WITH {_DIFF}) SELECT file, change, count(*) AS n FROM x GROUP BY ALL")
def _(t):
    return D.signature_diff(t.old_code, t.new_code).groupBy("file", "change").agg(F.count("*").alias("n"))


_SQL_FILES = [
    ("a.sql", "CREATE TABLE IF NOT EXISTS `shop.orders` (id int); create table items (id int);"),
    ("b.SQL", "alter table token add x int; drop table old_one;"),
    ("c.sql", "rename table password to license; create table z (a int)"),
    ("d.sql", "DROP TABLE IF EXISTS gone"),
    ("e.sql", "select 1"),
    ("f.go", "create table nope"),
]


@query("df02_schema_change", """WITH $docs, c(file, change, name) AS (VALUES ('a.sql', 'create', 'shop.orders'), ('a.sql', 'create', 'items'), ('b.SQL', 'alter', 'token'), ('c.sql', 'rename', 'password'), ('c.sql', 'rename', 'license'), ('d.sql', 'drop', 'gone'))
SELECT file, change, name, (SELECT count(DISTINCT module_name) FROM active WHERE process_flow ILIKE '%' || name || '%' OR summary ILIKE '%' || name || '%' OR risk_point ILIKE '%' || name || '%') AS modules FROM c""")
def _(t):
    files = t.rows("file string, content string", *_SQL_FILES).where(F.lower("file").endswith(".sql"))
    changes = files.withColumn("s", D.schema_change(F.col("content"))).where("s is not null").select("file", "s.change", F.explode("s.tables").alias("name"))
    names = [r[0] for r in changes.select("name").distinct().collect()]  # table names of the changed files
    found = D.mentions(t.active, names, ("process_flow", "summary", "risk_point")).groupBy("name").agg(F.countDistinct("module_name").alias("modules"))
    return changes.join(found, "name", "left").select("file", "change", "name", F.coalesce("modules", F.lit(0).cast("long")).alias("modules"))


@query("df03_test_selection", r"""WITH $docs, m AS (SELECT file_path AS file, list_sort(list_distinct(regexp_extract_all(source_code, '\b(the|und|les|para)\b'))) AS fs FROM active) SELECT file, array_to_string(fs, ',') AS funcs FROM m WHERE len(fs) > 0""")
def _(t):
    hit = D.test_selection(t.active.select(F.col("file_path").alias("file"), F.col("source_code").alias("content")), ["the", "und", "les", "para"])
    return hit.select("file", F.array_join(F.array_sort("funcs"), ",").alias("funcs"))


@query("df04_branch_seeds", "WITH $code, changed AS (SELECT DISTINCT n.file FROM new_code n JOIN old_code o ON o.pos = n.pos WHERE o.signature <> n.signature) SELECT file, func FROM new_code WHERE file IN (SELECT file FROM changed) AND file LIKE '%.go' AND file NOT LIKE '%_test.go' QUALIFY row_number() OVER (PARTITION BY file, func ORDER BY pos) = 1")
def _(t):
    changed = t.new_code.join(t.old_code.select("pos", F.col("signature").alias("was")), "pos").where("signature <> was").select("file").distinct()
    own = t.new_code.join(changed, "file", "left_semi").where(F.col("file").endswith(".go") & ~F.col("file").endswith("_test.go"))
    return own.groupBy("file", "func").agg(F.min("pos")).select("file", "func")


_EXISTING = """existing AS (SELECT id, repo_id, file_path, func_name, source_code, content_source, source_code_changed FROM active),
parsed AS (SELECT repo_id, file_path, func_name, func_line + 1 + 500 * k AS func_line, k, CASE WHEN n_chars % 7 = 0 THEN source_code || '!' ELSE ' ' || source_code END || CASE WHEN k > 0 THEN '#' ELSE '' END AS code
  FROM (SELECT *, unnest(CASE WHEN id % 6 = 0 THEN [0, 1, 2] WHEN id % 6 = 1 THEN [0, 1] ELSE [0] END) AS k FROM docs JOIN documents ON doc_id = id))"""
_ACTION = """CASE WHEN e.content_source = 2 THEN 'flag' WHEN e.id IS NULL AND p.k = 0 THEN 'insert' WHEN p.k = 2 THEN 'hit' WHEN p.k = 1 THEN 'overwrite'
WHEN e.source_code_changed = 0 AND trim(e.source_code) = trim(p.code) THEN 'hit' ELSE 'overwrite' END"""


def _parsed(t, *more):
    """Functions as parsed; every sixth file holds its function's name three times, the last two alike, every other sixth twice."""
    code = F.when(F.col("n_chars") % 7 == 0, F.concat("source_code", F.lit("!"))).otherwise(F.concat(F.lit(" "), "source_code"))
    times = F.when(F.col("id") % 6 == 0, 3).when(F.col("id") % 6 == 1, 2).otherwise(1)
    each = t.sources.withColumn("k", F.explode(F.sequence(F.lit(0), times - 1)))
    return each.select("repo_id", "file_path", "func_name", (F.col("func_line") + 1 + 500 * F.col("k")).alias("func_line"), F.concat(code, F.when(F.col("k") > 0, "#").otherwise("")).alias("code"), *more)


@query("mg01_doc_merge", f"WITH $docs, {_EXISTING} SELECT p.file_path, p.func_name, p.func_line, {_ACTION} AS action FROM parsed p LEFT JOIN existing e ON e.repo_id = p.repo_id AND e.file_path = p.file_path AND e.func_name = p.func_name")
def _(t):
    return M.merge_actions(t.coded, _parsed(t)).select("file_path", "func_name", "func_line", "action")


@query("sk09_doc_merge", f"""WITH $docs, {_EXISTING}, had AS (SELECT a.*, NULL AS origin_auto_doc FROM active a),
p AS (SELECT d.repo_id, d.file_path, d.func_name, d.module_name || '!' AS module_name, x.func_line, x.code, x.k, split_part(x.code, chr(10), 2) AS summary, d.process_flow || '.' AS process_flow, d.risk_point FROM docs d JOIN parsed x ON x.repo_id = d.repo_id AND x.file_path = d.file_path AND x.func_name = d.func_name),
j AS (SELECT p.*, e.id, e.module_name AS m0, e.func_line AS l0, e.source_code AS c0, e.summary AS s0, e.process_flow AS f0, e.content_source AS t0, e.source_code_changed AS r0, {_ACTION} AS act FROM p LEFT JOIN had e ON e.repo_id = p.repo_id AND e.file_path = p.file_path AND e.func_name = p.func_name),
z AS (SELECT repo_id, file_path, func_name, arg_max(j, k) FILTER (act <> 'hit') AS w, arg_min(j, k) AS f, bool_or(act = 'insert') AS fresh FROM j GROUP BY ALL),
a AS (SELECT repo_id, file_path, func_name, coalesce(w, f) AS j, CASE WHEN w IS NULL THEN 'hit' ELSE w.act END AS act, fresh FROM z),
ids AS (SELECT *, row_number() OVER (PARTITION BY fresh ORDER BY repo_id, file_path, func_name) + (SELECT max(id) FROM had) AS new_id FROM a)
SELECT CASE WHEN fresh THEN new_id ELSE j.id END AS id, repo_id, file_path, func_name, CASE WHEN act IN ('insert', 'overwrite') THEN j.module_name ELSE j.m0 END AS module_name, CASE WHEN act = 'hit' THEN j.l0 ELSE j.func_line END AS func_line,
md5(CASE WHEN act = 'hit' THEN j.c0 ELSE j.code END) AS code_md5, md5(CASE WHEN act IN ('insert', 'overwrite') THEN j.summary || j.process_flow ELSE j.s0 || j.f0 END) AS doc_md5, CASE WHEN act IN ('insert', 'overwrite') THEN 1 ELSE j.t0 END AS content_source,
CASE act WHEN 'flag' THEN 1 WHEN 'hit' THEN j.r0 ELSE 0 END AS source_code_changed, fresh AS has_origin FROM ids""")
def _(t):
    more = F.concat("module_name", F.lit("!")).alias("module_name"), F.concat("process_flow", F.lit(".")).alias("process_flow"), "risk_point"
    parsed = _parsed(t, *more).where("file_path is not null").withColumn("summary", F.split_part("code", F.lit("\n"), F.lit(2)))
    after = M.apply_merge(t.active.withColumn("origin_auto_doc", F.lit(None).cast("string")), parsed)
    return after.select(
        "id", "repo_id", "file_path", "func_name", "module_name", "func_line", F.md5(F.col("source_code").cast("binary")).alias("code_md5"), F.md5(F.concat("summary", "process_flow").cast("binary")).alias("doc_md5"),
        "content_source", "source_code_changed", F.col("origin_auto_doc").isNotNull().alias("has_origin"),
    )


@query("mg02_ghost_retire", f"WITH $code, g AS ({_GHOSTS}) SELECT file, func, 3 AS operate_type, true AS delete_vector FROM g")
def _(t):
    retired, log, vectors = M.retire_ghosts(t.old_code, t.new_code)
    return log.join(vectors, ["file", "func"]).select("file", "func", "operate_type", F.lit(True).alias("delete_vector"))


@query("mg03_change_text", """WITH $edges, f AS (SELECT DISTINCT callee_func AS func FROM edges WHERE callee_module = 'region'),
up AS (SELECT callee_func AS func, string_agg(caller_module || '.' || caller_func, '、' ORDER BY caller_module || '.' || caller_func) AS ups FROM edges WHERE callee_module = 'region' GROUP BY 1)
SELECT f.func, '本轮迭代修改 region.' || f.func AS change_summary, '修改 region.' || f.func || '。' || CASE WHEN ups IS NOT NULL THEN ' 上游调用方：' || ups || '。' ELSE '' END AS impact, '建议回归 region.' || f.func || ' 及其调用链。' AS attention FROM f LEFT JOIN up USING (func)""")
def _(t):
    changed = t.edges.where("callee_module = 'region'").select(F.col("callee_module").alias("module"), F.col("callee_func").alias("func")).distinct()
    return M.change_text(changed, t.edges).select("func", "change_summary", "impact", "attention")
