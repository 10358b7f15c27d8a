"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylens.functions import scalars as S
from quarrylens.operators import diff as D
from quarrylens.operators import graph as G
from quarrylens.operators import retrieval as R
from quarrylens.operators import textindex as X
from quarrylens.plans.registry import query


@query("jn01_ids_to_docs", "WITH $docs, ids(pos, id) AS (VALUES (0, 42), (1, 7), (2, 99999999), (3, 19), (4, 3)) SELECT pos, d.id, func_name FROM ids JOIN active d USING (id) WHERE repo_id = 1")
def _(t):
    ids = t.rows("pos int, id long", (0, 42), (1, 7), (2, 99999999), (3, 19), (4, 3))
    return R.load_in_order(ids, t.slim.where("repo_id = 1")).select("pos", "id", "func_name")


@query("jn02_left_first_doc", """WITH $docs, $edges, c AS (SELECT callee_module AS module, count(*) AS calls FROM edges GROUP BY 1), f AS (SELECT DISTINCT module_name FROM active),
n AS (SELECT module_name, max(id) AS id FROM active GROUP BY 1) SELECT f.module_name, n.id AS newest, coalesce(c.calls, 0) AS calls FROM f LEFT JOIN n USING (module_name) LEFT JOIN c ON c.module = f.module_name""")
def _(t):
    calls = t.edges.groupBy(F.col("callee_module").alias("module_name")).agg(F.count("*").alias("calls"))
    newest = R.newest_by(t.slim, "module_name").select("module_name", F.col("id").alias("newest"))
    return t.slim.select("module_name").distinct().join(newest, "module_name", "left").join(calls, "module_name", "left").select("module_name", "newest", F.coalesce("calls", F.lit(0).cast("long")).alias("calls"))


@query("jn03_changed_docs", "WITH $docs, $code SELECT DISTINCT d.id, d.func_name FROM new_code n JOIN active d ON d.id = n.pos JOIN old_code o ON o.pos = n.pos WHERE o.signature <> n.signature")
def _(t):
    changed = t.new_code.join(t.old_code.select("pos", F.col("signature").alias("was")), "pos").where("signature <> was")
    return changed.select(F.col("pos").alias("id")).join(t.slim, "id").dropDuplicates(["id"]).select("id", "func_name")


@query("jn04_override_coalesce", "WITH $docs SELECT id, coalesce(nullif(trim(b.text), ''), d.summary) AS summary FROM active d LEFT JOIN benchmark b ON b.item_id = d.id")
def _(t):
    override = t.raw("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("own"))
    return t.active.join(override, "id", "left").select("id", F.coalesce(F.nullif(F.trim("own"), F.lit("")), "summary").alias("summary"))


@query("jn05_related_modules", """WITH $relations, recalled(m) AS (VALUES ('src1'), ('src5'))
SELECT to_module AS module FROM relations JOIN recalled ON from_module = m UNION SELECT from_module FROM relations JOIN recalled ON to_module = m""")
def _(t):
    return R.related_modules(t.rows("module string", ("src1",), ("src5",)), t.relations)


_SET = "impacted AS (SELECT 'nation' AS module, CAST(n_nationkey AS VARCHAR) AS func FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR) FROM region UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier)"


def _impacted(t):
    n, r, s = t.raw("nation"), t.raw("region"), t.raw("supplier")
    pick = lambda df, m, c: df.select(F.lit(m).alias("module"), F.col(c).cast("string").alias("func"))
    return pick(n, "nation", "n_nationkey").union(pick(r, "region", "r_regionkey")).union(pick(s, "supplier", "s_suppkey"))


_INDUCED = f"""WITH $edges, {_SET} SELECT caller_module, caller_func, callee_module, callee_func FROM edges e WHERE EXISTS (SELECT 1 FROM impacted i WHERE i.module = e.caller_module AND i.func = e.caller_func)
AND EXISTS (SELECT 1 FROM impacted i WHERE i.module = e.callee_module AND i.func = e.callee_func)"""


@query("jn07_induced_edges", _INDUCED)
def _(t):
    return G.induced_edges(t.edges, _impacted(t)).select("caller_module", "caller_func", "callee_module", "callee_func")


@query("so07_intersect_edges", f"WITH x AS ({_INDUCED}) SELECT caller_module, callee_module, count(*) AS n FROM x GROUP BY ALL")
def _(t):
    return G.induced_edges(t.edges, _impacted(t)).groupBy("caller_module", "callee_module").agg(F.count("*").alias("n"))


@query("jn08_nodes_doc_id", f"WITH $docs, {_SET} SELECT module, func, d.id AS doc_id FROM impacted LEFT JOIN active d ON d.func_name = 'F' || func AND repo_id = 1")
def _(t):
    ids = t.slim.where("repo_id = 1").select(F.col("func_name").alias("key"), F.col("id").alias("doc_id"))
    return _impacted(t).withColumn("key", F.concat(F.lit("F"), "func")).join(ids, "key", "left").select("module", "func", "doc_id")


_ONE_HOP = """SELECT 'callee' AS side, callee_module AS module, callee_func AS func FROM edges WHERE caller_module = 'part' AND caller_func = '1'
UNION ALL SELECT 'caller', caller_module, caller_func FROM edges WHERE callee_module = 'part' AND callee_func = '1'"""


@query("jn09_one_hop", f"WITH $edges {_ONE_HOP}")
def _(t):
    return G.one_hop(t.edges, "part", "1")


@query("jn10_alias_map", """SELECT doc_id AS id, 'm' || doc_id % 4 || CASE WHEN doc_id % 4 < 3 THEN '.F' || doc_id ELSE '' END AS call, CASE WHEN doc_id % 4 IN (0, 1) THEN source || '/m' || doc_id % 4 WHEN doc_id % 4 = 3 THEN 'plain' END AS path,
CASE WHEN doc_id % 4 < 3 THEN 'F' || doc_id ELSE '' END AS rest FROM documents""")
def _(t):
    """Calls of documents through the imports of their files; some aliases are not imported, some calls name no function."""
    n = F.col("id") % 4
    call = F.concat(F.lit("m"), n.cast("string"), F.when(n < 3, F.concat(F.lit("."), "func_name")).otherwise(""))
    imports = F.create_map(*(x for m in ("m0", "m1") for x in (F.lit(m), F.concat("module_name", F.lit(f"/{m}")))), F.lit("m3"), F.lit("plain"))
    calls = t.sources.select("id", call.alias("call"), imports.alias("imports"))
    return calls.select("id", "call", F.try_element_at("imports", S.selector_alias(F.col("call"))).alias("path"), S.selector_rest(F.col("call")).alias("rest"))


_DIFF = """o AS (SELECT * FROM old_code QUALIFY row_number() OVER (PARTITION BY file, func ORDER BY pos DESC) = 1), f AS (SELECT DISTINCT file FROM old_code),
n AS (SELECT * FROM new_code WHERE file IN (SELECT file FROM f)), nf AS (SELECT DISTINCT file FROM new_code)
SELECT coalesce(o.file, n.file) AS file, coalesce(o.func, n.func) AS func, o.signature AS old_signature, n.signature AS new_signature,
CASE WHEN o.func IS NULL THEN 'added' WHEN n.func IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM (SELECT * FROM o WHERE file IN (SELECT file FROM nf)) o FULL JOIN n ON o.file = n.file AND o.func = n.func WHERE o.func IS NULL OR n.func IS NULL OR trim(o.signature) <> trim(n.signature)"""


@query("jn11_signature_full_outer", f"WITH $code, {_DIFF}")
def _(t):
    return D.signature_diff(t.old_code, t.new_code)


_GHOSTS = "SELECT o.file, o.func FROM old_code o WHERE NOT EXISTS (SELECT 1 FROM new_code n WHERE n.file = o.file AND n.func = o.func)"


@query("jn12_ghost_anti", f"WITH $code {_GHOSTS}")
def _(t):
    return t.old_code.join(t.new_code, ["file", "func"], "left_anti").select("file", "func")


_MODULE_EDGES = "SELECT DISTINCT caller_module AS from_module, callee_module AS to_module FROM edges WHERE call_kind = 2 AND caller_module <> callee_module"


@query("jn13_not_exists", f"WITH $edges, known(from_module, to_module) AS (VALUES ('part', 'supplier'), ('nation', 'region')) SELECT * FROM ({_MODULE_EDGES}) e WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.from_module = e.from_module AND k.to_module = e.to_module)")
def _(t):
    known = t.rows("from_module string, to_module string", ("part", "supplier"), ("nation", "region"))
    return G.module_relations(t.edges).join(known, ["from_module", "to_module"], "left_anti")


@query("jn14_token_user", "SELECT c_custkey, count(*) AS tokens FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > TIMESTAMP '1998-01-01' AND c_acctbal > 0 GROUP BY c_custkey")
def _(t):
    live = t.raw("orders").where("o_orderdate > timestamp_ntz'1998-01-01'").select("o_custkey")
    users = t.raw("customer").where("c_acctbal > 0").select("c_custkey")
    return live.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("tokens")).join(users, "c_custkey")


_NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '/$', ''), '\.git$', ''), '^(https|http|ssh)://', ''), '^git@', ''), '^([^:]*):', '\1/')"
_URLS = ["https://git.example.com/a/b.git", "git@git.example.com:a/b.git", "ssh://git@git.example.com/a/b/", " http://git.example.com/c ", "git.example.com/d.git"]
_URL_ROWS = ", ".join(f"('{u}')" for u in _URLS)


@query("jn15_normalized_url", f"WITH u(url) AS (VALUES {_URL_ROWS}), k AS (SELECT url, {_NORM} AS key FROM u) SELECT a.url, b.url AS other FROM k a JOIN k b ON a.key = b.key AND a.url < b.url")
def _(t):
    k = t.rows("url string", *((u,) for u in _URLS)).withColumn("key", S.normalize_url(F.col("url")))
    return k.join(k.select("key", F.col("url").alias("other")), "key").where("url < other").select("url", "other")


@query("jn16_like_theta", "WITH $docs, tables(name) AS (VALUES ('password'), ('token'), ('license'), ('table')) SELECT t.name, module_name, count(*) AS n FROM tables t JOIN active d ON d.process_flow ILIKE '%' || t.name || '%' OR d.summary ILIKE '%' || t.name || '%' GROUP BY ALL")
def _(t):
    names = ["password", "token", "license", "table"]
    return D.mentions(t.active, names, ("process_flow", "summary")).groupBy("name", "module_name").agg(F.count("*").alias("n"))


@query("jn16_many_names", r"""WITH $docs, n AS (SELECT DISTINCT lower(regexp_extract(summary, '[A-Za-z]{5,}')) AS name FROM docs UNION SELECT DISTINCT lower(source) FROM documents), k AS (SELECT * FROM n WHERE name <> '')
SELECT k.name, count(*) AS n FROM k JOIN docs d ON contains(lower(d.source_code), k.name) GROUP BY k.name""")
def _(t):
    """How many documents mention each of many names: the first long word of every document, and every module."""
    word = F.regexp_extract("summary", "[A-Za-z]{5,}", 0)
    names = t.sources.select(word.alias("name")).union(t.raw("documents").select("source"))
    return X.contained(t.sources.select("id", "source_code"), names, "id", "source_code", "name").groupBy("name").agg(F.count("*").alias("n"))


@query("jn17_regex_theta", r"WITH $docs SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(source_code, '\b(token|password|License|stupid)\b'))), ',') AS funcs FROM active WHERE regexp_matches(source_code, '\b(token|password|License|stupid)\b')")
def _(t):
    return D.test_selection(t.active.select("id", F.col("source_code").alias("content")), ["token", "password", "License", "stupid"]).select("id", F.array_join(F.array_sort("funcs"), ",").alias("funcs"))


_TOPK = "SELECT id, round(far, 6) AS distance FROM (SELECT id, list_distance(CAST(v AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS far FROM vs)"


@query("jn19_vector_topk", f"WITH $docs, vs AS (SELECT vec_id AS id, embedding AS v FROM embeddings e JOIN active d ON d.id = e.vec_id WHERE repo_id = 1) {_TOPK} ORDER BY far, id LIMIT 10")
def _(t):
    return R.vector_top_k(t.vectors.join(t.slim.where("repo_id = 1").select("id"), "id", "left_semi"), t.vectors.where("id = 0"), 10).withColumn("distance", F.round("distance", 6))


@query("jn20_repo_name", "WITH $docs, repos(repo_id, name) AS (VALUES (1, 'en'), (2, 'fr')) SELECT d.id, coalesce(r.name, '') AS repo_name FROM active d LEFT JOIN repos r USING (repo_id)")
def _(t):
    repos = t.rows("repo_id long, name string", (1, "en"), (2, "fr"))
    return t.slim.join(F.broadcast(repos), "repo_id", "left").select("id", F.coalesce("name", F.lit("")).alias("repo_name"))


@query("so01_ordered_union", "WITH a(pos, id) AS (VALUES (0, 5), (1, 3), (2, -1), (3, 9)), b(pos, id) AS (VALUES (0, 3), (1, 8), (2, 5)), u AS (SELECT 0 AS ch, pos, id FROM a UNION ALL SELECT 1, pos, id FROM b), f AS (SELECT * FROM u WHERE id > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ch, pos) = 1) SELECT id, row_number() OVER (ORDER BY ch, pos) - 1 AS pos FROM f")
def _(t):
    a = t.rows("pos int, id int", (0, 5), (1, 3), (2, -1), (3, 9))
    b = t.rows("pos int, id int", (0, 3), (1, 8), (2, 5))
    return R.ordered_union(a, b).select("id", F.col("pos").cast("long").alias("pos"))


@query("so03_except", "WITH $relations, r AS (SELECT to_module AS module FROM relations WHERE from_module IN ('src1', 'src2') UNION SELECT from_module FROM relations WHERE to_module IN ('src1', 'src2')) SELECT module FROM r WHERE module NOT IN ('src1', 'src2')")
def _(t):
    recalled = t.rows("module string", ("src1",), ("src2",))
    return R.related_modules(recalled, t.relations).join(recalled, "module", "left_anti")


@query("so04_union_all", "WITH $docs SELECT id, 0 AS grp FROM active WHERE module_name = 'src1' UNION ALL SELECT id, 1 FROM active WHERE module_name = 'src2'")
def _(t):
    return t.slim.where("module_name = 'src1'").select("id", F.lit(0).alias("grp")).unionByName(t.slim.where("module_name = 'src2'").select("id", F.lit(1).alias("grp")))


@query("so08_union_distinct", "WITH $code SELECT func FROM old_code UNION SELECT func FROM new_code")
def _(t):
    return t.old_code.select("func").union(t.new_code.select("func")).distinct()


@query("ag09_first_wins", "WITH $code, u AS (SELECT 0 AS turn, * FROM new_code UNION ALL SELECT 1, * FROM old_code) SELECT file, func, signature FROM u QUALIFY row_number() OVER (PARTITION BY file, func ORDER BY turn, pos) = 1")
def _(t):
    both = t.new_code.withColumn("turn", F.lit(0)).unionByName(t.old_code.withColumn("turn", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("file", "func").orderBy("turn", "pos"))
    return both.withColumn("r", first).where("r = 1").select("file", "func", "signature")
